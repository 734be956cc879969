"""Substring deduplication over bytes by suffix sorting (suffix_sort.py).

A suffix array of everything wouldn't be distributed, so suffixes are dealt by content first, losing no match. Of the hashes
of all SEED_BYTES-long strings within a window of `length` bytes, the least one names the window's anchor; equal windows have
equal anchors at one place within them. The windows that share an anchor in a text form a segment. Segments meet in the
hash range of their anchor:

- equal segments, compared by 128-bit digest, are repeated as a whole, and one of them stands for all;
- a segment whose anchor no other one has holds no repeated window;
- the others are cut to what any other segment with their anchor shares with them around it, equal ones again stand
  for each other, and of the distinct rest a suffix array is built. Neighbours in it that agree on `length` bytes are repeated.

Suffixes are sorted over tokens, cut where a rule on two adjacent bytes says so, which makes the array several times shorter.
The order of windows that begin within a token follows from the token's rest and the rank of the suffix behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, discard, mix64, release, slices, written
from .substring_dedup import pack, unpack
from .suffix_sort import suffix_array

SEED_BYTES = 64
AT_ONCE = 1 << 20
#: Bytes whose suffixes are sorted together.
SORTED_AT_ONCE = 1 << 18
NO_ID = -(1 << 63)
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Token boundaries: about one pair of bytes in ten.
BOUNDARY = _RNG.random((256, 256)) < 0.1
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers((1 << 16) + 1, int(BASE)), _powers((1 << 16) + 1, pow(int(BASE), -1, 1 << 64))


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for hashes of any substring, and the inverse powers that make them independent of the place."""
    global _POWERS, _INVERSE
    if len(data) >= len(_POWERS):
        _POWERS, _INVERSE = _powers(2 * len(data), int(BASE)), _powers(2 * len(data), pow(int(BASE), -1, 1 << 64))
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _POWERS[: len(data)], out=p[1:])
    return p, _INVERSE[: len(data) + 1]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width`-byte substring."""
    p, inverse = _prefix(data)
    return mix64((p[width:] - p[:-width]) * inverse[: len(data) - width + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` adjacent values, from least values of blocks forward and backward."""
    n = len(x)
    k = -(-n // width)
    padded = np.full(k * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(k, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first window, last window, anchor place) of a text's windows, in order; long texts in overlapping parts."""
    q = min(SEED_BYTES, length)
    for base in range(0, max(len(data) - length + 1, 0), AT_ONCE):
        part = np.frombuffer(data, np.uint8, min(AT_ONCE + length - 1, len(data) - base), base)
        h = rolling(part, q)
        key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(key, length - q + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        yield from zip(h[at[first]].tolist(), (first + base).tolist(), (last + base).tolist(), (at[first] + base).tolist(), strict=True)


def tokens_of(text: np.ndarray) -> np.ndarray:
    """Where tokens begin, the first and the end of the text included."""
    return np.concatenate([[0], np.flatnonzero(BOUNDARY[text[:-1], text[1:]]) + 1, [len(text)]])


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of `length` bytes start anywhere else in the texts, itself included."""
    ends = np.cumsum([len(t) for t in texts])
    if not len(ends) or not ends[-1]:
        return [np.zeros(0, bool) for _ in texts]
    all_bytes = b"".join(texts)
    data = np.frombuffer(all_bytes, np.uint8)
    # Tokens over all texts: a token ends where the rule says or where its text ends.
    cut = np.unique(np.concatenate([tokens_of(data), ends]))
    begins, stops = cut[:-1].tolist(), cut[1:].tolist()
    words = [all_bytes[a:b] for a, b in zip(begins, stops, strict=True)]
    rank_of = {w: k for k, w in enumerate(sorted(set(words)), len(texts) + 1)}
    # Each text is ended by a symbol of its own, below all tokens; the last one is the least of all.
    symbols, where, last = [], [], 0
    for k, e in enumerate(ends.tolist()):
        to = int(np.searchsorted(cut, e))
        symbols += [rank_of[w] for w in words[last:to]]
        where += begins[last:to]
        symbols.append(len(texts) - 1 - k)
        where.append(-1)
        last = to
    order = np.array(suffix_array(symbols))
    at = np.array(where)[order]
    rank = np.zeros(len(data) + 1, np.int64)  # of the suffix at each token's beginning
    rank[at[at >= 0]] = np.flatnonzero(at >= 0) + 1
    # Windows: the hash of what is left of their token, then the rank of the suffix behind it.
    text_of = np.searchsorted(ends, np.arange(len(data)), side="right")
    starts = np.flatnonzero(np.arange(len(data)) + length <= ends[text_of])
    if not len(starts):
        return [np.zeros(max(len(t) - length + 1, 0), bool) for t in texts]
    # A boundary at a window's start depends on the byte ahead of it, so the token's rest goes on to the next one.
    behind = cut[np.searchsorted(cut, starts, side="right")]
    behind = np.minimum(behind, starts + length)
    p, inverse = _prefix(data)
    tail = (p[behind] - p[starts]) * inverse[starts] + (behind - starts).astype(np.uint64)
    order = np.lexsort((np.where(behind - starts < length, rank[behind], 0), tail))
    s = starts[order]
    whole = (p[s + length] - p[s]) * inverse[s]
    like = np.flatnonzero(whole[1:] == whole[:-1])
    same = np.zeros(len(s), bool)
    for a in range(0, len(like), 1 << 15):  # equal hashes are compared byte by byte
        k = like[a : a + (1 << 15)]
        span = np.arange(length)
        equal = (data[s[k][:, None] + span] == data[s[k + 1][:, None] + span]).all(axis=1)
        same[k[equal]] = True
        same[k[equal] + 1] = True
    found = np.zeros(len(data), bool)
    found[s[same]] = True
    return [found[e - len(t) : max(e - length + 1, e - len(t))] for t, e in zip(texts, ends.tolist(), strict=True)]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def trim(group: list[tuple[bytes, int]], length: int) -> list[tuple[int, int] | None]:
    """For each (bytes, anchor place) of one anchor, the part around it in which it agrees with some other one; None if too short."""
    reach = []
    for side in (lambda x, a: x[:a][::-1], lambda x, a: x[a:]):
        keys = [side(x, a) for x, a in group]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        most = [0] * len(keys)
        for u, v in zip(order, order[1:], strict=False):
            c = _common(keys[u], keys[v])
            most[u], most[v] = max(most[u], c), max(most[v], c)
        reach.append(most)
    return [(a - left, a + right) if left + right >= length else None for (_, a), left, right in zip(group, *reach, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def settle(groups: list[list[tuple]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(d, k, first, last) of repeated windows in groups of (d, k, first window, anchor, whole, bytes) with one anchor each.

    whole: the segment was found repeated before and only stands for others to be compared with."""
    texts: list[bytes] = []
    members: list[list[tuple]] = []
    size = 0

    def flush() -> Iterator[tuple[int, int, int, int]]:
        for own, found in zip(members, repeated_windows(texts, length), strict=True):
            runs = _runs(found)
            for d, k, first in own:
                for a, b in runs:
                    yield d, k, first + a, first + b

    for group in groups:
        parts = trim([(x[5], x[3] - x[2]) for x in group], length)
        distinct: dict[bytes, list[tuple]] = {}
        for (d, k, first, _, whole, data), part in zip(group, parts, strict=True):
            if part:
                distinct.setdefault(data[part[0] : part[1]], []).append((d, k, first + part[0], whole))
        for data, own in distinct.items():
            if len(own) > 1:
                for d, k, first, whole in own:
                    if not whole:
                        yield d, k, first, first + len(data) - length
        if len(distinct) > 1:
            for data, own in distinct.items():
                texts.append(data)
                members.append([x[:3] for x in own if len(own) == 1 and not x[3]])
                size += len(data)
        if size >= SORTED_AT_ONCE:
            yield from flush()
            texts, members, size = [], [], 0
    if texts:
        yield from flush()


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    A byte is removed if a string of `length` bytes covers it that also starts anywhere else, in the same text too; strings
    are judged on the input and never cross texts. Null counts as empty. Repeated rows repeat each other's strings; null
    identifiers are texts like any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    src = src.select("i", "x", F.coalesce("i", F.lit(NO_ID)).alias("d"), F.xxhash64("x").alias("k"))
    n_bytes = src.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    n_ranges = max(16, n_bytes // (16 << 20))
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("part", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> Iterator[tuple]:
            d, k = (np.array([x[j] for x in held], np.int64) for j in (0, 1))
            n = [len(x[2]) for x in held]
            doc = np.repeat(np.arange(len(held), dtype=np.uint32), n)
            h = np.array([s[0] for x in held for s in x[2]], np.uint64)
            lo, hi, at = (np.array([s[j] for x in held for s in x[2]], np.int64) for j in (1, 2, 3))
            dig = np.frombuffer(b"".join(x[3] for x in held), "<u8").reshape(-1, 2)
            # Equal segments within the task: all are repeated, and one is sent for them.
            order = np.lexsort((dig[:, 1], dig[:, 0], h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (dig[order][1:] != dig[order][:-1]).any(axis=1)
            first = np.flatnonzero(new)
            many = np.diff(first, append=len(order)) > 1
            whole = np.zeros(len(order), bool)
            whole[order] = np.repeat(many, np.diff(first, append=len(order)))
            for a in np.array_split(np.flatnonzero(whole), max(1, int(whole.sum()) >> 16)):
                if len(a):
                    yield int(k[doc[a[0]]]), 1, pack(d[doc[a]], k[doc[a]], lo[a], hi[a])
            sent = order[first]
            share = mix64(h[sent]) % np.uint64(n_ranges)  # anchors are least hashes, so they aren't spread evenly themselves
            by = np.argsort(share, kind="stable")
            cut = np.searchsorted(share[by], np.arange(n_ranges + 1, dtype=np.uint64))
            for r in range(n_ranges):
                a = sent[by[cut[r] : cut[r + 1]]]
                if len(a):
                    own, inner = np.unique(doc[a], return_inverse=True)
                    yield r, 0, pack(d[own], k[own], inner.astype(np.uint32), h[a], dig[a, 0], dig[a, 1], lo[a].astype("<u4"), (hi[a] - lo[a]).astype("<u4"), (at[a] - lo[a]).astype("<u4"), whole[a].astype(np.uint8))

        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for b in slices(batches):
                for data, d, k in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if len(data) < length:
                        continue
                    found = list(segments(data, length))
                    held.append((d, k, found, b"".join(hashlib.blake2b(data[lo : hi + length], digest_size=16).digest() for _, lo, hi, _ in found)))
                    size += len(found)
                    if size >= 1 << 16:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)

        return batched(rows(), schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 1: windows known as repeated, by text. kind 0: segments whose bytes are wanted, by text."""

        def matched(parts: list[list[np.ndarray]]) -> Iterator[tuple]:
            d, k = (np.concatenate([p[j][p[2]] for p in parts]) for j in (0, 1))
            h, d0, d1, lo, hi, at, whole = (np.concatenate([p[j] for p in parts]) for j in range(3, 10))
            order = np.lexsort((d1, d0, h))
            d, k, h, d0, d1, whole = (x[order] for x in (d, k, h, d0, d1, whole.astype(bool)))
            lo, hi, at = (x[order].astype(np.int64) for x in (lo, hi, at))
            hi, at = lo + hi, lo + at
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_h | np.concatenate([[True], (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1])])
            first = np.flatnonzero(new)
            many = np.diff(first, append=len(h)) > 1
            of = np.cumsum(new) - 1
            lost = np.flatnonzero(many[of] & ~whole)
            if len(lost):
                yield int(k[lost[0]]), 1, pack(d[lost], k[lost], lo[lost], hi[lost])
            # Anchors with two distinct segments or more: one of each.
            group = np.cumsum(new_h) - 1
            kinds = np.bincount(group[first])
            pick = first[kinds[group[first]] > 1]
            if len(pick):
                yield 0, 0, pack(d[pick], k[pick], h[pick], lo[pick], hi[pick], at[pick], (whole[pick] | many[of[pick]]).astype(np.uint8))

        def rows() -> Iterator[tuple]:
            last, held = None, []
            for b in batches:
                for key, kind, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind == 1:
                        yield key, kind, part
                        continue
                    if key != last and held:
                        yield from matched(held)
                        held = []
                    last = key
                    held.append(unpack(part))
            if held:
                yield from matched(held)

        return batched(rows(), schema)

    ddl = "key long, kind int, part binary"
    dealt = src.select("x", "d", "k").mapInArrow(deal, ddl).repartition("key", "kind").sortWithinPartitions("kind", "key")
    met = written(dealt.mapInArrow(meet, ddl), "segments")
    release(spark)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text: its wanted segments."""
        for b in batches:
            for part in b.column(0).to_pylist():
                d, k, h, lo, hi, at, whole = unpack(part)
                order = np.lexsort((lo, k, d))
                d, k, h, lo, hi, at, whole = (x[order] for x in (d, k, h, lo, hi, at, whole))
                cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
                parts = [pack(h[a:z], lo[a:z], hi[a:z], at[a:z], whole[a:z]) for a, z in zip(cut, [*cut[1:], len(d)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(k[cut]), pa.array(parts, pa.binary())], names=["d", "k", "part"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("k", pa.int64()), ("lo", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("bytes", pa.binary())])

        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                for d, k, data, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                    for part in lists:
                        h, lo, hi, at, whole = unpack(part)
                        for n, (a, z) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                            yield int(h[n].astype(np.int64)), d, k, a, int(at[n]), bool(whole[n]), data[a : z + length]

        return batched(rows(), out)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("part", pa.binary())])

        def by_text(found: list[tuple]) -> Iterator[tuple]:
            if not found:
                return
            x = np.array(found, np.int64)
            x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
            cut = np.flatnonzero(np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(axis=1)]))
            for a, z in zip(cut, [*cut[1:], len(x)], strict=True):
                yield int(x[a, 0]), int(x[a, 1]), pack(x[a:z, 2], x[a:z, 3])

        def rows() -> Iterator[tuple]:
            groups, group, last, size = [], [], None, 0
            for b in slices(batches):
                for h, d, k, lo, at, whole, data in zip(*(b.column(j).to_pylist() for j in range(7)), strict=True):
                    if h != last and group:
                        if len(group) > 1:
                            groups.append(group)
                        group = []
                        if size >= 4 * SORTED_AT_ONCE:
                            yield from by_text(list(settle(groups, length)))
                            groups, size = [], 0
                    last = h
                    group.append((d, k, lo, at, whole, data))
                    size += len(data)
            if len(group) > 1:
                groups.append(group)
            if groups:
                yield from by_text(list(settle(groups, length)))

        return batched(rows(), out)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                d, k, lo, hi = unpack(part)
                order = np.lexsort((lo, k, d))
                d, k, lo, hi = d[order], k[order], lo[order], hi[order]
                cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
                parts = [pack(lo[a:z], hi[a:z]) for a, z in zip(cut, [*cut[1:], len(d)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(k[cut]), pa.array(parts, pa.binary())], names=["d", "k", "part"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("i", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                for i, data, lists in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                    if not lists:
                        yield i, len(data), 0, 0, data
                        continue
                    edge = np.zeros(len(data) + 1, np.int32)
                    for part in lists:
                        lo, hi = unpack(part)
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, hi + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    yield i, len(data), int(gone.sum()), len(_runs(gone)), np.frombuffer(data, np.uint8)[~gone].tobytes()

        return batched(rows(), out)

    lists = lambda df: df.groupBy("d", "k").agg(F.collect_list("part").alias("parts"))
    want = lists(met.where("kind = 0").select("part").mapInArrow(wanted, "d long, k long, part binary"))
    fetched = src.select("d", "k", "x").join(want, ["d", "k"]).mapInArrow(fetch, "h long, d long, k long, lo long, at long, whole boolean, bytes binary")
    met_again = fetched.repartition("h").sortWithinPartitions("h").select("h", "d", "k", "lo", "at", "whole", "bytes")
    lost = met_again.mapInArrow(sort, "d long, k long, part binary").unionByName(met.where("kind = 1").select("part").mapInArrow(known, "d long, k long, part binary"))
    lost = written(lost, "repeated")
    discard(met)
    release(spark)
    out = src.join(lists(lost), ["d", "k"], "left").select("i", "x", "parts").mapInArrow(keep, "i long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.col("i").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
