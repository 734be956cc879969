"""Scans: chunk corpus, audit log, evaluation set, lexicons, pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CORPUS = "text string, metadata struct<chunk_id:string, doc_id:string, page_start:int, page_end:int, section_title:string, image_ids:string, version:string, model:string, firmware:string, source_path:string, ocr_used:boolean, is_continuation:boolean>"
AUDIT = "timestamp string, query string, query_corrected string, corrections array<array<string>>, matched_terms array<string>, fallback boolean, off_topic boolean, ambiguous_models array<string>, n_steps int, n_images int, retrieved_chunk_ids array<string>, retrieved_docs array<string>, retrieved_versions array<string>, ocr_sourced_citations int, time_to_first_token_ms int, retrieval_ms int, latency_ms int, request_id string"
EVAL = "query string, kind string, expected_fallback boolean, expected_doc_id string, expected_pages array<int>, expected_image_count int, domain string, off_topic boolean, note string"
PAGES = "doc_id string, page int, text string, ocr_used boolean, ocr_attempted boolean, ocr_failed boolean, ocr_empty boolean, ocr_error string, text_lines array<struct<y:double, text:string>>, images array<struct<image_id:string, x0:double, y0:double, x1:double, y1:double>>"


def scan_json(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped. A missing path is an empty table. Malformed lines are an error or,
    if tolerant, left out."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def corpus(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """The chunk corpus as flat columns, image_ids as an array, section_title null where empty."""
    c = scan_json(spark, path, CORPUS, tolerant)
    return c.select("text", "metadata.*").withColumn("image_ids", T.decode_ids(F.col("image_ids"))).withColumn("section_title", F.nullif("section_title", F.lit("")))


def to_corpus(chunks: DataFrame) -> DataFrame:
    """Chunks as the corpus stores them: nested metadata without nulls, image_ids as JSON text, section_title empty for null."""
    fields = [F.col(c) for c in chunks.columns if c not in ("text", "image_ids", "section_title")]
    return chunks.select("text", F.struct(*fields, F.coalesce("section_title", F.lit("")).alias("section_title"), F.to_json("image_ids").alias("image_ids")).alias("metadata"))


def ready(chunks: DataFrame) -> bool:
    """Whether an index can be searched: it can be read and has a row."""
    try:
        return not chunks.isEmpty()
    except Exception:  # any failure to read means not ready
        return False


def scan_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], page_shift: int = 1) -> DataFrame:
    """Pages of binary documents: `parse` gives a document's pages as dicts in the columns of PAGES but doc_id and page; pages are
    numbered from page_shift. The parser is passed in, as it needs a library for the format."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in ("doc_id page text ocr_used ocr_attempted ocr_failed ocr_empty ocr_error text_lines images").split()]
        for b in batches:
            rows = [{"doc_id": d, "page": n + page_shift, **page} for d, c in zip(b["doc_id"], b["content"], strict=True) for n, page in enumerate(parse(c))]
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, PAGES)


def flat_images(pages: DataFrame, least_area: float = 100.0) -> DataFrame:
    """doc_id, page, pos, image_id, box and area of the pages' images; numbered before those under an area are left out."""
    each = pages.select("doc_id", "page", F.posexplode("images").alias("pos", "i")).select("doc_id", "page", "pos", "i.*")
    return each.withColumn("area", T.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).where(F.col("area") >= least_area)


def language_words(words: DataFrame, most: int = 300_000, least_zipf: float = 1.0) -> DataFrame:
    """word, freq: the most common words of letters of a lexicon (word, zipf), from a frequency on."""
    fit = words.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("zipf") >= least_zipf))
    return fit.orderBy(F.desc("zipf"), "word").limit(most).select("word", F.col("zipf").alias("freq"))
