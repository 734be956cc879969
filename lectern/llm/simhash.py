"""Near duplicates by SimHash, found through an inverted index over byte positions.

A fingerprint of 64 bits is eight positional bytes. Two that differ in at most `radius` bits differ in at most as many bytes, so
they share 8 - radius positional bytes or more: the guaranteed minimum of matches. Lists of one positional byte each would hold a
256th of the corpus, and tallying pairs from them would cost its square; so the index posts a fingerprint under every choice of
that many positional bytes (56 of five, at radius 3). A pair meets in a list exactly if its tally reaches the minimum; where it
meets, its shared bytes are counted and its differing bits verified.

Equal fingerprints are one node from the start, so copies are never paired. Members of a list differ in `radius` bytes only, hence
a list has at most 2 ** (8 * radius) members whatever the corpus, and a member has no more than 2,324 possible neighbours there
(radius 3), which are looked up when the list is longer. A list yields a forest of its links, fewer than it has members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, cut_lineage, slices
from .ngram_join import components

SEED = 42
BYTES = 8
#: Words of a text that are hashed at a time.
PIECE = 1 << 16


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined runs of `width` words, repeats included, in pieces; of the whole sequence if there are fewer words."""
    if len(words) < width:
        if words:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    for a in range(0, len(words) - width + 1, PIECE):
        part = words[a : a + PIECE + width - 1]
        joined = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size + 1) - 1
        spans = map(slice, (end - size)[: len(part) - width + 1].tolist(), end[width - 1 :].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), itertools.repeat(SEED)), np.uint64, len(part) - width + 1)


def fingerprint(data: bytes, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words. A-Z are lower-cased."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(data.lower().split(), width):
        n += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i (identifier), f (fingerprint, as a signed long), a row per input row."""
    schema = pa.schema([("i", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                for i, data in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    f = fingerprint(data, width)
                    yield i, f - (f >> 63 << 64)

        return batched(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("x")).mapInArrow(run, "i long, f long")


def choices(radius: int) -> list[np.uint64]:
    """Masks of the positional bytes that a list is named by, 8 - radius of them."""
    return [np.uint64(sum(0xFF << 8 * p for p in at)) for at in itertools.combinations(range(BYTES), BYTES - radius)]


def neighbours(mask: np.uint64, radius: int) -> np.ndarray:
    """What a member of a list under `mask` may differ by from another: up to `radius` bits outside the mask."""
    free = [1 << k for k in range(64) if not int(mask) >> k & 1]
    return np.array([sum(bits) for r in range(1, radius + 1) for bits in itertools.combinations(free, r)], np.uint64)


def alike(rest: np.ndarray, f: np.uint64, radius: int) -> np.ndarray:
    """Which of `rest` share the minimum of positional bytes with f (count filter) and then differ in few enough bits (verification)."""
    differ = rest ^ f
    near = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - radius
    near[near] = np.bitwise_count(differ[near]) <= radius
    return near


def forest(members: np.ndarray, mask: np.uint64, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what the list's links connect: from each member reached, those not yet reached that are alike. members:
    distinct and sorted."""
    flips = None
    waiting = np.ones(len(members), bool)
    for k in range(len(members)):
        if not waiting[k]:
            continue
        waiting[k] = False
        reached = [k]
        while reached:
            f = members[at := reached.pop()]
            if len(members) <= 4096:
                rest = np.flatnonzero(waiting)
                found = rest[alike(members[rest], f, radius)]
            else:
                flips = neighbours(mask, radius) if flips is None else flips
                want = f ^ flips
                place = np.minimum(np.searchsorted(members, want), len(members) - 1)
                found = place[members[place] == want]
                found = found[waiting[found]]
            waiting[found] = False
            reached += found.tolist()
            yield from ((int(members[at].view(np.int64)), int(x)) for x in members[found].view(np.int64))


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: links among the distinct fingerprints f of `nodes` that connect what all links within the radius connect."""
    masks = choices(radius)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(j: np.ndarray, f: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int]]:
            """Whole lists, sorted; most have one member."""
            first = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (key[1:] != key[:-1])]))
            size = np.diff(first, append=len(j))
            two = first[size == 2]
            a, b = f[two], f[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            yield from zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist(), strict=True)
            for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                yield from forest(np.sort(f[at : at + n]), masks[j[at]], radius)

        def rows() -> Iterator[tuple]:
            every, held = np.array(masks), None
            for b in batches:
                j, f = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy().view(np.uint64)
                if held is None:
                    held = [(j, f)]
                    continue
                before = held[-1]
                if len(j) and before[0][-1] == j[0] == j[-1] and (before[1][-1] & every[j[0]]) == (f[-1] & every[j[0]]):
                    held.append((j, f))  # one long list goes on
                    continue
                j, f = np.concatenate([x[0] for x in held] + [j]), np.concatenate([x[1] for x in held] + [f])
                key = f & every[j]
                last = len(j) - 1 - int(np.argmax(((j != j[-1]) | (key != key[-1]))[::-1])) if len(j) and ((j[0] != j[-1]) or (key[0] != key[-1])) else -1
                if last >= 0:
                    yield from closed(j[: last + 1], f[: last + 1], key[: last + 1])
                held = [(j[last + 1 :], f[last + 1 :])]
            if held:
                j, f = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                if len(j):
                    yield from closed(j, f, f & every[j])

        return batched(rows(), schema)

    keys = F.array(*[F.col("f").bitwiseAND(F.lit(int(m.view(np.int64)))) for m in masks])
    posted = nodes.select("f", F.posexplode(keys).alias("j", "key")).repartition("j", "key").sortWithinPartitions("j", "key", "f")
    return posted.select("j", "f").mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id_col, fingerprint (16 lowercase hex digits), component_id (the smallest identifier that links reach,
    itself included), where fingerprints link that differ in `radius` bits at most.

    Texts are taken whole, A-Z lower-cased, in words of anything but ASCII white space; a text of fewer words than `width` is one
    shingle; null counts as empty, and texts without words have the fingerprint zero, which links like any other. A null identifier
    takes part, but is a component_id only where the component has no other. Repeated rows link with each other. Very long texts are
    hashed in pieces; their words are held at once. Other columns are ignored. An empty table gives no rows.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius is 1 to 3: lists of a larger one have no useful bound")
    rows = cut_lineage(fingerprints(docs, width, id_col, text_col))
    nodes = cut_lineage(rows.groupBy("f").agg(F.min("i").alias("i")))
    labels = components(cut_lineage(links(nodes, radius)))
    linked = nodes.join(labels.withColumnRenamed("node", "f"), "f")
    least = linked.groupBy("label").agg(F.min("i").alias("least"))
    of = nodes.join(linked.select("f", "label").join(least, "label").select("f", "least"), "f", "left").select(F.col("f").alias("g"), F.coalesce("least", "i").alias("component_id"))
    # A fingerprint that very many rows share is split by the adaptive join; the other side has one row for it.
    return rows.join(of, rows["f"] == of["g"]).select(F.col("i").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
