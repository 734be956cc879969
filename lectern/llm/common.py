"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import gc
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path as new_path
from ..sources.scratch import shared_dir

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def fresh(*names: str) -> list[str]:
    """Column names that no input has."""
    return [f"_{x}_{uuid.uuid4().hex}" for x in names]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Like cut_lineage, as compressed columns; for wide rows."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver notice which shuffles are done with, so that their files go before the next step writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by written() that nothing will read again."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(conf).delete(path, True)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which is faster for short arrays."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that only few texts are Python objects at a time."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 8192, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded rows and bytes from tuples."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(out) >= most or size >= most_bytes:
            yield rows_to_batch(out, schema)
            out, size = [], 0
    if out:
        yield rows_to_batch(out, schema)
    del out
    trim()


#: glibc's way to return freed memory; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Return freed memory at a task's end: Spark keeps idle Python workers beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: The cache in use in this worker.
_HELD: list[dict] = [{}]


def hold(cache: dict) -> None:
    """Of several operators' caches a worker holds one: the one before is emptied when another is used."""
    if _HELD[0] is not cache:
        _HELD[0].clear()
        _HELD[0] = cache


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Stable 64-bit hashes of words (bytes); a bounded cache, as most words come again and again."""

    MOST = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        hold(self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache for all operators of a worker.
WORDS = WordHashes()


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` word hashes, in order; empty if there are fewer."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers as Spark's longs."""
    return np.ascontiguousarray(x).view(np.int64)
