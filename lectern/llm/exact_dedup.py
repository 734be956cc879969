"""Exact deduplication by sorting contents.

Rows are dealt to range partitions by sampled splitters over (start of the normalised text, its SHA-256, identifier),
each partition is sorted externally by the same key with the whole text between digest and identifier, and each text is
compared in full with its neighbour. Since the identifier is part of the splitters, a group of any size spreads over
as many partitions as it needs; runs that touch across partition borders are joined afterwards from two rows for each
partition. The samples sent to the driver hold a text's start and digest only, never whole texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, as_bytes, batched, cut_lineage

PREFIX_CHARS = 48
MARKS = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("pid", pa.int32()), ("run", pa.int64()), ("keep", pa.int64()), ("size", pa.int64()), ("first", pa.bool_()), ("edge", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the run of equal texts it stands in; the texts of the partition's first and last run.

    Of a run, only the identifiers (8 bytes each) are held until its end.
    """
    pid = TaskContext.get().partitionId()

    def flush(run: int, text: bytes, sha: str, ids: array, nulls: int, edge: bool) -> Iterator[tuple]:
        size, keep = len(ids) + nulls, ids[0] if ids else None
        for k in range(size):
            yield ids[k] if k < len(ids) else None, sha, pid, run, keep, size, k == 0, text if edge and k == 0 else None

    def rows() -> Iterator[tuple]:
        run, text, sha, ids, nulls = -1, None, "", array("q"), 0
        for batch in batches:
            for i, t, s in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if t != text:
                    if text is not None:
                        yield from flush(run, text, sha, ids, nulls, run == 0)
                    run, text, sha, ids, nulls = run + 1, t, s, array("q"), 0
                if i is None:
                    nulls += 1
                else:
                    ids.append(i)
        if text is not None:
            yield from flush(run, text, sha, ids, nulls, True)

    return batched(rows(), MARKS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of a group the row with the
    smallest identifier stays (keep="max": the largest); a null identifier stays only if the group has no other.
    Texts of any length are compared as wholes; a task holds two at a time. Repeated rows, identifier included, are members like any other: one row of the group stays.
    Returns a row per input row: id_col, keep_id (null only if all identifiers of the group are), group_size, kept,
    text_sha256 (hex, of the normalised text). Other columns of the input are ignored. An empty table gives no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    order = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    src = docs.select(F.col(id_col).cast("long").alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    src = src.select("_id", "_text", F.sha2("_text", 256).alias("_sha"), F.substring("_text", 1, PREFIX_CHARS).alias("_start"))
    dealt = src.repartitionByRange(F.col("_start"), F.col("_sha"), order).sortWithinPartitions("_start", "_sha", "_text", order)
    marks = cut_lineage(dealt.select("_id", "_text", "_sha").mapInArrow(_runs, "id long, sha string, pid int, run long, keep long, size long, first boolean, edge binary"))
    # Two rows for each partition at most: the runs at its borders.
    line = Window.orderBy("pid", "run")
    goes_on = (F.lag("edge").over(line) == F.col("edge")) & (F.lag("pid").over(line) != F.col("pid"))
    edges = marks.where(F.col("edge").isNotNull()).select("pid", "run", "keep", "size", F.coalesce(goes_on, F.lit(False)).alias("goes_on"))
    edges = edges.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(line))
    chain = Window.partitionBy("chain").orderBy("pid", "run")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("pid", "run", F.first("keep", ignorenulls=True).over(whole).alias("c_keep"), F.sum("size").over(whole).alias("c_size"), (F.row_number().over(chain) == 1).alias("c_first"))
    out = marks.join(F.broadcast(edges), ["pid", "run"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("c_size").isNull(), F.col("keep")).otherwise(F.col("c_keep")).alias("keep_id"),
        F.coalesce("c_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce("c_first", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
