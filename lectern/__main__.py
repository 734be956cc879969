"""python -m lectern PAGES OUT: chunk a table of parsed pages and put chunks, figures and manuals into the store."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import ingest as I
from .sources import corpus as SC
from .sources import store as S

LOG = logging.getLogger("lectern")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lectern", description="Chunk a table of parsed pages and put the chunks into the store.")
    p.add_argument("pages", help="parsed pages as the parser gives them, sources.corpus.PAGES, or with native, ocr_text and ocr_status for text (Parquet)")
    p.add_argument("out", help="the store's folder; versions that are there already are replaced")
    p.add_argument("--version", default="v1.0")
    p.add_argument("--model")
    p.add_argument("--firmware")
    p.add_argument("--pages-only", type=int, nargs="*", metavar="N", help="only these pages")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    pages = spark.read.parquet(a.pages).withColumn("doc_id", F.col("doc_id").cast("string"))
    if a.pages_only:
        pages = pages.where(F.col("page").isin(a.pages_only))
    said = [F.lit(x).cast("string").alias(c) for c, x in (("version", a.version), ("model", a.model), ("firmware", a.firmware), ("source_path", a.pages))]
    chunks, images, manuals = I.ingest(pages, pages.select("doc_id").distinct().select("doc_id", *said))
    S.write_versions(chunks.withColumn("image_ids", F.to_json("image_ids")), f"{a.out}/chunks")
    S.write_versions(images, f"{a.out}/images")
    S.write_versions(manuals, f"{a.out}/manuals")
    kept = S.read_versions(spark, f"{a.out}/chunks")
    LOG.info("ready: %s, chunks: %d, figures: %d", SC.ready(kept), kept.count(), spark.read.schema(images.schema).parquet(f"{a.out}/images").count())


if __name__ == "__main__":
    main()
