"""Cuts a table of manuals' pages into headed sections: python -m jobs.manual_sections CONFIG

Pages are numbered within their manual, lines that recur on its pages and lone page numbers go, headers begin sections, and a page
that begins without one goes on under the last title before it. Sections are written under manual and version, replacing those of the
manuals and version that this run has; other manuals and versions stay, so a rerun leaves the same files' content. A second table
says what became of each manual.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import run_from_command_line
from lectern import constants as K
from lectern.operators import ingest as I
from lectern.settings import SETTINGS
from lectern.sources import store as S

LOG = logging.getLogger("jobs.manual_sections")
SECTIONS = "page int, seg int, title string, body string, is_continuation boolean, doc_id string, version string"
RECORDS = "n_pages long, n_sections long, n_titles long, n_boilerplate_lines long, doc_id string, version string"


def run(spark: SparkSession, source: str, out: str, version: str, manual_column: str = "doc_id", order_column: str = "page", text_column: str = "text", header: str = K.SECTION_HEADER, boilerplate_share: float = SETTINGS.boilerplate_share) -> dict[str, int]:
    """source: Parquet rows of pages, with the manual that each belongs to, an order of pages within it, and text. out: gets
    sections/doc_id=.../version=... and manuals/doc_id=.../version=.... Gives the numbers of manuals, pages and sections, and logs them.

    Null or empty text is a page of one empty section. Pages without a manual are one manual, whose
    doc_id reads back as null, as an empty one does; rows without a place in the order are left out."""
    given = spark.read.parquet(source).select(F.coalesce(F.col(manual_column).cast("string"), F.lit("")).alias("doc_id"), F.col(order_column).alias("_order"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    n_rows = given.count()
    LOG.info("read %d pages from %s", n_rows, source)
    pages = I.numbered_pages(given, "_order")
    placed = given.where("_order is not null")
    repeated = I.boilerplate(placed, boilerplate_share)
    sections = I.carry_titles(I.headers(I.strip_lines(pages, repeated), header)).withColumn("version", F.lit(version))
    # Small manuals share tasks and a large one is split; a manual gets few files.
    S.write_versions(sections.select("page", "seg", "title", "body", "is_continuation", "doc_id", "version").hint("rebalance", "doc_id"), f"{out}/sections")

    done = read_sections(spark, out).where(F.col("version") == version)
    told = done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.count("title").alias("n_titles"))
    record = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages")).join(repeated.groupBy(F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).alias("n_boilerplate_lines")), F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")
    record = record.join(told.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left").select(
        F.col("n_pages"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_sections", "n_titles", "n_boilerplate_lines")], "doc_id", F.lit(version).alias("version")
    )
    S.write_versions(record.coalesce(1) if n_rows < 1_000_000 else record, f"{out}/manuals")
    wrote = record_totals(read_records(spark, out).where(F.col("version") == version))
    LOG.info("wrote %(sections)d sections of %(manuals)d manuals with %(pages)d pages", wrote)
    return wrote


def record_totals(records: DataFrame) -> dict[str, int]:
    r = records.agg(F.count(F.lit(1)), F.sum("n_pages"), F.sum("n_sections")).first()
    return {"manuals": r[0], "pages": r[1] or 0, "sections": r[2] or 0}


def read_sections(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SECTIONS).parquet(f"{out}/sections")


def read_records(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(f"{out}/manuals")


if __name__ == "__main__":
    run_from_command_line(run, "manual_sections", __doc__.splitlines()[0])
