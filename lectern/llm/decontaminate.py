"""Benchmark decontamination by SimHash over windows of the size of each benchmark item.

A document's windows of an item's size get a 64-bit SimHash of their word shingles. Items are indexed by the blocks of their
fingerprints: within `RADIUS` bits of each other, two fingerprints have a block within RADIUS // BLOCKS bits of each
other, so looking up all near block values finds every item within the radius. Each find is verified by the exact
similarity of the two bags of shingles. A window without any shingle of the benchmark has similarity 0 with every item, so
fingerprints are made only around such shingles.

A document of fewer shingles than an item is the one window, held against the items by itself: bags of two sizes have no
fingerprint radius, so items come from the shingles they share with it, and the similarity takes both sizes as they are.

The radius: at similarity 0.75 the cosine of two bags of one size is 6/7, their fingerprints differ in 11 of 64 bits on
average with a standard deviation of 3, and in more than 23 about three times in 100,000.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batched, mix64, window_hashes

WIDTH = 5
RADIUS, BLOCKS = 23, 8
SEED = 0x082EFA98EC4E6C89
_ASCII = str.maketrans({c: " " for c in map(chr, range(128)) if c not in string.ascii_letters + string.digits})
_WORD = re.compile(r"[^\W_]+")
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class TextHashes(WordHashes):
    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)
        return h


_HASHES = TextHashes()


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    text = text.lower()
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the `size` shingles from each start; a shingle weighs as often as it occurs."""
    bits = np.unpackbits(np.ascontiguousarray(mix64(shingles)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    return np.packbits(total[starts + size] - total[starts] > 0, axis=1)


class Matcher:
    """An index of benchmark items that finds them in texts."""

    def __init__(self, items: list[tuple[int | None, str]], percent: int = 75):
        self.percent = percent
        self.whole: dict[tuple[str, ...], list[int | None]] = {}  # items under WIDTH words: only as a whole document
        self.sizes: dict[int, dict] = {}
        self.places: list[tuple[int, int]] = []  # of each item with shingles: its size and its place in the group of that size
        every = []
        for item, text in items:
            w = words(text)
            if not w:
                continue
            if len(w) < WIDTH:
                self.whole.setdefault(tuple(w), []).append(item)
                continue
            s = window_hashes(_HASHES.of(w), WIDTH, SEED)
            every.append(s)
            group = self.sizes.setdefault(len(s), {"items": [], "bags": [], "prints": []})
            group["items"].append(item)
            group["bags"].append(Counter(s.tolist()))
            group["prints"].append(fingerprints(s, np.zeros(1, np.int64), len(s))[0])
            self.places.append((len(s), len(group["items"]) - 1))
        self.known = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        # The items of each known shingle, one after another: those of known[k] are owners[owned[k] : owned[k + 1]].
        has = [np.searchsorted(self.known, np.unique(s)) for s in every]
        self.owners = np.repeat(np.arange(len(every)), [len(x) for x in has])[np.argsort(np.concatenate(has), kind="stable")] if every else np.empty(0, np.int64)
        self.owned = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(has), minlength=len(self.known)))]) if every else np.zeros(1, np.int64)
        self.item_sizes = np.array([size for size, _ in self.places], np.int64)
        self.most = max(self.sizes, default=0)
        self.first = np.zeros(1 << 20, bool)
        self.first[(self.known >> np.uint64(44)).astype(np.int64)] = True
        for group in self.sizes.values():
            group["prints"] = np.array(group["prints"])
            group["near"] = _POPCOUNT[np.arange(256, dtype=np.uint8)[:, None, None] ^ group["prints"][None]] <= RADIUS // BLOCKS  # value x item x block

    def find(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, first word, words) of each item in the text, at the place where it is most similar."""
        w = words(text or "")
        if len(w) < WIDTH:
            return [(item, 1.0, 0, len(w)) for item in self.whole.get(tuple(w), ())] if w else []
        s = window_hashes(_HASHES.of(w), WIDTH, SEED)
        maybe = np.flatnonzero(self.first[(s >> np.uint64(44)).astype(np.int64)])
        at = maybe
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
            same = self.known[at] == s[maybe]
            maybe, at = maybe[same], at[same]
        hits = maybe
        if not len(hits):
            return []
        out = self.longer(s, at, len(w))
        for size, group in self.sizes.items():
            if size > len(s):
                continue
            edge = np.zeros(len(s) + 2, np.int32)
            np.add.at(edge, np.maximum(hits - size + 1, 0), 1)
            np.add.at(edge, hits + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[: len(s) - size + 1]) > 0)
            # An item's bag and a window's are of one size, so similar ones share 2p / (100 + p) of it at least.
            known = np.concatenate([[0], np.cumsum(np.bincount(hits, minlength=len(s)))])
            starts = starts[(known[starts + size] - known[starts]) * (100 + self.percent) >= 2 * self.percent * size]
            best: dict[int, tuple] = {}
            for a in range(0, len(starts), 4096):
                at = starts[a : a + 4096]
                lo = at[0]
                prints = fingerprints(s[lo : at[-1] + size], at - lo, size)
                near = np.zeros((len(at), len(group["items"])), bool)
                for b in range(BLOCKS):
                    near |= group["near"][prints[:, b], :, b]
                rows, items = np.nonzero(near)
                within = _POPCOUNT[prints[rows] ^ group["prints"][items]].sum(axis=1) <= RADIUS
                for k, item in zip(rows[within].tolist(), items[within].tolist(), strict=True):
                    start = int(at[k])
                    both = sum((group["bags"][item] & Counter(s[start : start + size].tolist())).values())
                    if 100 * both >= self.percent * (2 * size - both):
                        best[item] = max(best.get(item, (0.0, 0)), (both / (2 * size - both), -start))
            out += [(group["items"][k], sim, -start, size + WIDTH - 1) for k, (sim, start) in best.items()]
        return out

    def longer(self, s: np.ndarray, at: np.ndarray, n_words: int) -> list[tuple[int | None, float, int, int]]:
        """What find returns for the items of more shingles than the text, whose shingles are s, with those of the benchmark
        at places `at` of the known ones."""
        if len(s) * 100 < self.percent * (len(s) + 1) or len(s) >= self.most:
            return []
        # An item's share of the text's shingles bounds what both have; it has to reach p / (100 + p) of the two sizes.
        counts = np.zeros(len(self.places), np.int64)
        for k, n in zip(*np.unique(at, return_counts=True), strict=True):
            counts[self.owners[self.owned[k] : self.owned[k + 1]]] += n
        sizes = self.item_sizes
        out, own = [], Counter(s.tolist())
        for k in np.flatnonzero((sizes > len(s)) & (counts * (100 + self.percent) >= self.percent * (len(s) + sizes))).tolist():
            size, place = self.places[k]
            group = self.sizes[size]
            both = sum((group["bags"][place] & own).values())
            if 100 * both >= self.percent * (len(s) + size - both):
                out.append((group["items"][place], both / (len(s) + size - both), 0, n_words))
        return out


def matchers(benchmark: DataFrame, item_col: str, text_col: str, percent: int, block_bytes: int) -> Iterator[Matcher]:
    """The benchmark as indexes of bounded size, block by block; each is broadcast by itself."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    n = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = -(-n // block_bytes)
    for b in range(blocks):
        yield Matcher([(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()], percent)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75, block_bytes: int = 1 << 20) -> DataFrame:
    """The benchmark items that documents hold: id_col, item_col, similarity, start_word, n_words (counted in lower-cased
    runs of letters and digits), a row for each row of docs and item at the most similar window. A document shorter than an
    item is one window, at its whole length.

    Null or empty texts hold and are nothing; an item under five words is found only where it is a whole document. Null
    identifiers are carried on; a text of any length is searched as a whole, in one task; repeated rows of either table give rows of their own. Other columns are ignored. A
    benchmark beyond `block_bytes` is searched for in blocks, one pass over the documents each.
    """
    schema = pa.schema([("d", pa.int64()), ("i", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
    ddl = "d long, i long, similarity double, start_word long, n_words long"
    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    out = None
    for matcher in matchers(benchmark, item_col, item_text_col, percent, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return batched(((d.as_py(), *m) for b in batches for d, t in zip(b.column(0), b.column(1), strict=True) for m in sent.value.find(t.as_py())), schema)

        found = src.mapInArrow(run, ddl)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], ddl)
    return out.select(F.col("d").alias(id_col), F.col("i").alias(item_col), "similarity", "start_word", "n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 75, block_bytes: int = 1 << 20) -> DataFrame:
    """docs, all columns, less the rows whose text holds a benchmark item as find_leaks sees it. No shuffle."""
    for matcher in matchers(benchmark, item_col, item_text_col, percent, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(matcher)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.find(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
