"""Substring deduplication over windows of words, with a count-min prefilter.

First pass: a count-min sketch of all windows, built in partitions and merged (count_min.py). Second pass: only windows
estimated repeated are grouped exactly, by 96 bits of hash, to find the smallest identifier of a document in which each
starts. Before anything is shuffled, each task settles its own windows: of the documents that hold a window, all but the one
with the smallest identifier are known to lose it, so a window that a third of all documents share costs each task one entry.
Entries travel as compressed arrays, a row for each task's share of a hash range; ranges grow in number with the input, and each
has a task of its own, so what a task reads stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import count_min
from .common import WORDS, as_bytes, batched, release, slices, window_hashes

NULL_ID = np.iinfo(np.int64).max
SEED1, SEED2 = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179
AT_ONCE = 1 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed block of byte planes."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(4, "little"), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 1
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 8], "little")
        at += 8
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def remove_repeated(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 29, n_bytes: int | None = None) -> DataFrame:
    """A row per input row: id_col, n_words, n_removed, kept_text (the words that stay, joined by one space).

    Words are runs of characters other than space and tab to carriage return, unchanged. A word is removed if a window of
    `width` consecutive words of its document covers it whose words also start in a document with a smaller identifier;
    windows are judged on the input. Null text has no words. A null identifier counts as larger than all others, and null
    identifiers (like the rows of a repeated identifier) don't remove each other's words. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("x")).withColumn("k", F.xxhash64("x"))
    n_bytes = n_bytes if n_bytes is not None else src.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    bits = count_min.row_bits(n_bytes // 6, most_bits)

    def all_windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data in (x for b in slices(iter([batch])) for x in as_bytes(b.column(0))):
            h = window_hashes(WORDS.of(data.split()), width, SEED1)
            if len(h):
                yield h

    sent = spark.sparkContext.broadcast(count_min.frequent_bits(src.select("x"), all_windows, bits))
    release(spark)
    n_ranges = max(16, n_bytes // (24 << 20))
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("part", pa.binary())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(sent.value, np.uint8)

        def flush(held: list[tuple]) -> Iterator[tuple]:
            ids = np.array([x[0] for x in held], np.int64)
            keys = np.array([x[1] for x in held], np.int64)
            n = np.array([len(x[2]) for x in held])
            h1, h2, pos = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
            doc = np.repeat(np.arange(len(held), dtype=np.uint32), n)
            order = np.lexsort((ids[doc], h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            least = np.empty(len(order), np.int64)
            least[order] = ids[doc[order]][np.flatnonzero(new)[np.cumsum(new) - 1]]
            lost = least < ids[doc]
            yield from found(doc[lost], pos[lost], ids, keys)
            h1, h2, pos, doc = h1[~lost], h2[~lost], pos[~lost], doc[~lost]
            share = (h1 >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
            order = np.argsort(share, kind="stable")
            cut = np.searchsorted(share[order], np.arange(n_ranges + 1, dtype=np.uint64))
            for r in range(n_ranges):
                at = order[cut[r] : cut[r + 1]]
                if len(at):
                    own, inner = np.unique(doc[at], return_inverse=True)
                    yield r, 0, pack(ids[own], keys[own], h1[at], h2[at], np.diff(inner.astype(np.int32), prepend=np.int32(0)), np.diff(pos[at].astype(np.int32), prepend=np.int32(0)))

        def found(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
            """Lost windows, a row for each few documents."""
            if len(doc):
                own, inner = np.unique(doc, return_inverse=True)
                order = np.lexsort((pos, inner))
                yield int(keys[own[0]]), 1, pack(ids[own], keys[own], np.diff(inner[order].astype(np.int32), prepend=np.int32(0)), np.diff(pos[order].astype(np.int32), prepend=np.int32(0)))

        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for batch in slices(batches):
                for i, data, key in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    words = WORDS.of(data.split())
                    h = window_hashes(words, width, SEED1)
                    at = np.flatnonzero(count_min.estimated_frequent(sketch, h, bits))
                    if len(at):
                        second = (window_hashes(words, width, SEED2)[at] >> np.uint64(32)).astype(np.uint32)
                        held.append((NULL_ID if i is None else i, key, h[at], second, at.astype(np.uint32)))
                        size += len(at)
                    if size >= AT_ONCE:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)

        return batched(rows(), schema)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Settle each hash range; pass on what was settled before. Rows: document, text key, starts of lost windows."""
        out = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("starts", pa.binary())])

        def by_doc(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
            order = np.lexsort((pos, doc))
            doc, pos = doc[order], pos[order]
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
                d = doc[a]
                # Only rows with one text may share an identifier and a key, so a start is listed once.
                yield int(ids[d]), int(keys[d]), np.diff(np.unique(pos[a:b]), prepend=0).astype("<u4").tobytes()

        def settled(parts: list[list[np.ndarray]]) -> Iterator[tuple]:
            n = np.array([len(p[0]) for p in parts])
            ids, keys, h1, h2 = (np.concatenate([p[k] for p in parts]) for k in range(4))
            doc = np.concatenate([np.cumsum(p[4], dtype=np.int64) + a for p, a in zip(parts, np.cumsum(n) - n, strict=True)])
            pos = np.concatenate([np.cumsum(p[5], dtype=np.int64) for p in parts])
            order = np.lexsort((ids[doc], h2, h1))
            h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
            new = np.ones(len(order), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lost = ids[doc][np.flatnonzero(new)[np.cumsum(new) - 1]] < ids[doc]
            if lost.any():
                yield from by_doc(ids, keys, doc[lost], pos[lost])

        def rows() -> Iterator[tuple]:
            last, held = None, []
            for batch in batches:
                for key, kind, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    p = unpack(part)
                    if kind == 1:
                        yield from by_doc(p[0], p[1], np.cumsum(p[2], dtype=np.int64), np.cumsum(p[3], dtype=np.int64))
                        continue
                    if key != last and held:
                        yield from settled(held)
                        held = []
                    last = key
                    held.append(p)
            if held:
                yield from settled(held)

        return batched(rows(), out)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("i", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                for i, data, lists in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    words = data.split()
                    n = len(words)
                    if lists:
                        edge = np.zeros(n + 1, np.int64)
                        for x in lists:
                            at = np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + width, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    yield i, n, n - len(words), b" ".join(words).decode("utf-8", "replace")

        return batched(rows(), out)

    parts = src.mapInArrow(settle, "key long, kind int, part binary").repartitionById(n_ranges, F.pmod("key", F.lit(n_ranges)).cast("int")).sortWithinPartitions("kind", "key")
    lost = parts.mapInArrow(group, "d long, k long, starts binary").groupBy("d", "k").agg(F.collect_list("starts").alias("lists"))
    with_lost = src.withColumn("d", F.coalesce("i", F.lit(int(NULL_ID)))).join(lost, ["d", "k"], "left").select("i", "x", "lists")
    out = with_lost.mapInArrow(keep, "i long, n_words long, n_removed long, kept_text string")
    return out.select(F.col("i").alias(id_col), "n_words", "n_removed", "kept_text")

