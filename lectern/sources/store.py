"""The store: chunks, vectors, manuals and figures as Parquet, replaced by (doc_id, version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANUALS = "doc_id string, version string, source_path string, model string, firmware string, ingested_at string, n_chunks int, n_pages int, n_ocr_pages int, n_ocr_failed_pages int"
IMAGES = "image_id string, doc_id string, version string, page int, x0 double, y0 double, x1 double, y1 double, area double"
KEY = ["doc_id", "version"]


def replace(existing: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """existing without the rows whose keys `new` has, then new; `pos` keeps the order of both."""
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    if "pos" not in existing.columns:
        return kept.unionByName(new)
    last = kept.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
    return kept.unionByName(new.join(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("_last") + 1).drop("_last"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: that of `new` where it has one, the last by `pos` if it has several."""
    if "pos" in new.columns:
        new = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos")))).where("_k = 1").drop("_k")
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def write_versions(df: DataFrame, path: str) -> None:
    """Write df under doc_id and version; partitions that df has are replaced, others stay."""
    df.write.partitionBy(*KEY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_versions(spark: SparkSession, path: str, doc_id: str | None = None, version: str | None = None) -> DataFrame:
    """The rows of a document or version; only their partitions are read."""
    out = spark.read.parquet(path)
    if doc_id is not None:
        out = out.where(F.col("doc_id") == doc_id)
    return out if version is None else out.where(F.col("version") == version)


def image_records(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of wanted figures (doc_id, image_id), of several versions the latest (parts: numbers of the version)."""
    found = images.join(wanted.select("doc_id", "image_id").distinct(), ["doc_id", "image_id"], "left_semi")
    order = Window.partitionBy("doc_id", "image_id").orderBy(F.desc("parts"), "version")
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL with named parameters."""
    return spark.sql(sql, args=args)
