"""Exact Jaccard similarity join of documents' word shingles, size-aware, and the components of its links.

Light sets (few shingles) are joined by enumerating their fixed-size subsets: two sets that are similar enough have one of
them in common. Heavy sets are joined by scanning inverted lists. Which sizes count as light is chosen by cost. A
list holds the sets that have its shingle among the few that any similar set must share one of (the prefix, under one
order of all shingles, those that are frequent by a count-min sketch last), with the place it has there, which bounds the
overlap of two members. Equal sets are one node from the start, so copies are never paired.

Links are needed up to connection, so within a list each member is first compared with one leader alone, whose near copies
this joins in linear time. Then every pair of list members that is still unconnected, and that sizes and places allow, is
compared exactly; nothing is capped. Where links are to be counted, every pair of list members is, connected or not. Comparisons move a text for each pair, to where the other's text is.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import count_min
from .common import WORDS, as_bytes, batched, cut_lineage, discard, fresh, mix64, release, signed, slices, sorted_distinct, window_hashes, written
from .substring_dedup import pack, unpack

SEED = 0x243F6A8885A308D3
MOST_LIGHT = 12
HOT = 48
PIECE = 1 << 19
#: Members of a list whose pairs one task tests at a time; longer lists are tested block against block.
LIST_BLOCK = 2048
NO_ID = -(1 << 63)


def shingles(data: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased; the whole sequence if there are fewer words."""
    words = WORDS.of(data.lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < width:
        return window_hashes(words, len(words), SEED ^ len(words))
    return sorted_distinct(window_hashes(words, width, SEED))


def needed(n: int, m: int, percent: int) -> int:
    """The least overlap of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set enumerates: for each size m that a smaller partner may have, what two such sets need."""
    return sorted({needed(m, m, percent) for m in range(-(-percent * n // 100), n + 1)})


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def light_cost(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def light_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the subsets that a light set enumerates."""
    out = []
    x = mix64(s ^ np.uint64(0x13198A2E03707344))
    for c in subset_sizes(len(s), percent):
        at = np.array(list(itertools.combinations(range(len(s)), c)))
        h = np.full(len(at), c, np.uint64)
        for j in range(c):  # s is sorted, so equal sets give equal keys
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x[at[:, j]])
        out.append(h)
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def light_boundary(sets: DataFrame, percent: int) -> int:
    """The largest size for which enumerating subsets costs no more than scanning the lists of the prefix.

    The cost of a scan is the mean length of the list that a small set's shingle meets, measured on all small sets."""
    small = sets.where(F.col("small").isNotNull())
    lists = small.select(F.explode("small").alias("h")).groupBy("h").count()
    r = lists.agg(F.sum(F.col("count") * F.col("count")).alias("pairs"), F.sum("count").alias("rows")).first()
    scan = 1 + (r["pairs"] or 0) / (r["rows"] or 1)
    best = 0
    for n in range(1, MOST_LIGHT + 1):
        if light_cost(n, percent) <= prefix_length(n, percent) * scan:
            best = n
    return best


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of each component of an edge list, by least labels of neighbours and pointer jumping."""
    both = cut_lineage(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = cut_lineage(lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), "was"))
        labels = step.select("node", "label")
        if step.where(F.col("label") != F.col("was")).isEmpty():
            return labels


def shingle_join(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """A row per input row: id_col, n_shingles, n_links (distinct other sets that link with its set), component_id (the
    smallest identifier among the rows that links connect, itself included). Counting compares all candidate pairs, as many
    as the square of a group of near copies; without count_links there is no n_links, and a group costs its size.

    Two rows link when 100 * intersection >= percent * union of their sets of `width`-word shingles. A text with fewer words
    is one shingle; null or without words, its set is empty and it links with nothing. A null identifier takes part, but is
    never a component_id unless the component has no other. Repeated rows link with each other. Other columns are ignored.
    Sets are compared by 64-bit hashes of their shingles, nodes are named by 64 bits of their set's digest.
    """
    sets, named = groups(docs, width, percent, id_col, text_col, count_links)
    n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    node = named.select("nid", "component_id", "n_links", F.lit(True).alias("some"))
    return sets.join(node, (sets["nid"] == node["nid"]) & (sets["n"] > 0), "left").select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"), *n_links, F.when(F.col("some"), F.col("component_id")).otherwise(F.col("i")).alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, less all but one row of each group that links connect: the one with the smallest identifier (a null
    one only if there is no other), of several such rows any one of those with the least hash of their text. Rows without
    words all stay."""
    _, named = groups(docs, width, percent, id_col, text_col)
    d, k, nth = fresh("d", "k", "n")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("i").isNull(), "i", "k")).alias("s")).select(F.coalesce("s.i", F.lit(NO_ID)).alias(d), F.col("s.k").alias(k))
    keyed = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), k: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    stay = keyed.where(has_words).join(first, [d, k], "left_semi")
    stay = stay.withColumn(nth, F.row_number().over(Window.partitionBy(d, k).orderBy(F.lit(1)))).where(F.col(nth) == 1)
    return stay.select(*docs.columns).unionByName(docs.where(~has_words))


def groups(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, count_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows (i, k: hash of the text, n: size of the set, nid: its node) and the nodes (nid, i, k of their first row,
    component, component_id, n_links: of the links found, which are all with count_links)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    n_bytes = src.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    n_ranges, n_blocks = max(16, n_bytes // (10 << 20)), max(16, n_bytes // (16 << 20))

    # 1. One pass for the sets' digests and for the count-min sketch of all shingles, whose cells are few for each item: only
    # counts far above the mean matter, to put frequent shingles last in the order.
    bits = count_min.row_bits(n_bytes // 6 // 32)
    first_schema = pa.schema([("i", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("nid", pa.int64()), ("small", pa.list_(pa.int64())), ("block", pa.int64()), ("part", pa.binary())])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for b in slices(batches):
                for i, data, k in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                    s = shingles(data, width)
                    yield i, k, len(s), node_id(s), signed(s).tolist() if 0 < len(s) <= MOST_LIGHT else None, None, None
                    held.append(s)
                    size += len(s)
                    if size >= count_min.FLUSH:
                        yield from ((None,) * 5 + x for x in count_min.parts(held, bits))
                        held, size = [], 0
            if size:
                yield from ((None,) * 5 + x for x in count_min.parts(held, bits))

        return batched(rows(), first_schema)

    both = written(src.select("i", "x", F.xxhash64("x").alias("k")).mapInArrow(first_pass, "i long, k long, n long, nid long, small array<long>, block long, part binary"), "sets")
    sets = both.where("block is null").select("i", "k", "n", "nid", "small")
    light = light_boundary(sets, percent)
    least_heavy = -(-percent * (light + 1) // 100)
    load = n_bytes / 6 / (1 << bits)
    hot = spark.sparkContext.broadcast(count_min.merged(both.where("block is not null").select("block", "part"), bits, int(min(255, HOT + 4 * load))))

    release(spark)
    # 3. Lists: entries travel as compressed arrays, a row for each task's share of a hash range.
    piece_schema = pa.schema([("r", pa.int64()), ("part", pa.binary())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(hot.value, np.uint8)

        def flush(held: list[tuple]) -> Iterator[tuple]:
            nid, n = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            rare = np.array([x[4] for x in held], np.int64)
            h, pos = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            doc = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
            share = mix64(h) % np.uint64(n_ranges)  # prefixes hold least hashes, so they aren't spread evenly themselves
            order = np.argsort(share, kind="stable")
            cut = np.searchsorted(share[order], np.arange(n_ranges + 1, dtype=np.uint64))
            for r in range(n_ranges):
                at = order[cut[r] : cut[r + 1]]
                if len(at):
                    own, inner = np.unique(doc[at], return_inverse=True)
                    yield r, pack(nid[own], n[own], rare[own], h[at], np.diff(inner.astype(np.int32), prepend=np.int32(0)), pos[at].astype(np.uint32))

        def rows() -> Iterator[tuple]:
            held, size, seen = [], 0, set()
            for b in slices(batches):
                for data in as_bytes(b.column(0)):
                    s = shingles(data, width)
                    nid = node_id(s)
                    if not len(s) or nid in seen:  # a copy within the task adds nothing
                        continue
                    if len(seen) > 50_000:
                        seen.clear()
                    seen.add(nid)
                    if len(s) <= light:
                        keys = light_keys(s, percent)
                        held.append((nid, len(s), keys, np.zeros(len(keys), np.int64), len(s)))
                        size += len(keys)
                    if len(s) >= least_heavy:
                        common = count_min.estimated_frequent(sketch, s, bits)
                        first = np.concatenate([s[~common], s[common]])[: prefix_length(len(s), percent)]
                        held.append((nid, len(s), first, np.arange(len(first)), int((~common).sum())))
                        size += len(first)
                    if size >= PIECE:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)

        return batched(rows(), piece_schema)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each hash range that have two members or more."""

        def lists(parts: list[list[np.ndarray]]) -> Iterator[tuple]:
            nid, n, rare = (np.concatenate([p[j][np.cumsum(p[4], dtype=np.int64)] for p in parts]) for j in range(3))
            h, pos = np.concatenate([p[3] for p in parts]), np.concatenate([p[5] for p in parts])
            order = np.lexsort((nid, h))
            h, nid, n, pos, rare = h[order], nid[order], n[order], pos[order], rare[order]
            once = np.ones(len(h), bool)  # copies from other tasks
            once[1:] = (h[1:] != h[:-1]) | (nid[1:] != nid[:-1])
            h, nid, n, pos, rare = h[once], nid[once], n[once], pos[once], rare[once]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(first, append=len(h))
            keep = np.repeat(size > 1, size)
            if keep.any():
                yield pack(h[keep], nid[keep], n[keep].astype(np.uint32), pos[keep].astype(np.uint32), rare[keep].astype(np.uint32), np.repeat(size, size)[keep].astype(np.uint32))

        def rows() -> Iterator[tuple]:
            last, held = None, []
            for b in batches:
                for r, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if r != last and held:
                        yield from ((x,) for x in lists(held))
                        held = []
                    last = r
                    held.append(unpack(part))
            if held:
                yield from ((x,) for x in lists(held))

        return batched(rows(), pa.schema([("part", pa.binary())]))

    posted = src.select("x").mapInArrow(post, "r long, part binary").repartitionById(n_ranges, F.col("r").cast("int")).sortWithinPartitions("r")
    lists = written(posted.mapInArrow(shared, "part binary"), "lists")

    release(spark)
    # 4. Each member of a list against the list's leader: of those of about its size, the one with the fewest rare shingles, as
    # what near copies were made from has none of its own.
    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("c", pa.int64())])

        def rows() -> Iterator[tuple]:
            for b in batches:
                for part in b.column(0).to_pylist():
                    h, nid, n, _, rare, _ = unpack(part)
                    about = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
                    order = np.lexsort((nid, rare, about, h))
                    h, nid, about, n = h[order], nid[order], about[order], n[order]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (about[1:] != about[:-1])])
                    v = nid[np.flatnonzero(new)[np.cumsum(new) - 1]]
                    pairs, c = np.unique(np.stack([nid[v != nid], v[v != nid]]), axis=1, return_counts=True)
                    yield from zip(pairs[0].tolist(), pairs[1].tolist(), c.tolist(), strict=True)

        return batched(rows(), schema)

    nodes = cut_lineage(sets.where("n > 0").groupBy("nid").agg(F.min(F.struct(F.col("i").isNull(), "i", "k", "n")).alias("s")).select("nid", "s.i", "s.k", "s.n"))
    star = lists.mapInArrow(leaders, "u long, v long, c long").groupBy("u", "v").agg(F.sum("c").alias("c"))
    star = star.groupBy("u").agg(F.max(F.struct("c", "v")).alias("b")).select("u", "b.v", "b.c")
    # Which are compared now is a matter of cost alone: those that share so few lists with their leader are left to step 6.
    size = lambda c: nodes.select(F.col("nid").alias(c), F.col("n").alias(f"n{c}"))
    star = star.join(size("u"), "u").join(size("v"), "v")
    likely = (100 + percent) * (F.col("c") + F.greatest("nu", "nv") * percent / 100) >= percent * (F.col("nu") + F.col("nv"))
    star = star.where(likely | (F.least("nu", "nv") <= 2 * MOST_LIGHT)).select("u", "v")
    star = star if count_links else cut_lineage(star)

    # 5. The texts of all nodes that are in some list, once.
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in b.column(0).to_pylist():
                held.append(sorted_distinct(unpack(part)[1]))
                size += len(held[-1])
                if size >= 1 << 20:
                    held = [sorted_distinct(np.concatenate(held))]
                    size = len(held[0])
                    if size >= 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0])], names=["nid"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(sorted_distinct(np.concatenate(held)))], names=["nid"])

    listed = lists.mapInArrow(members, "nid long").distinct()
    wanted = nodes.join(listed, "nid").select("nid", F.coalesce("i", F.lit(NO_ID)).alias("d"), "k")
    texts = src.select(F.coalesce("i", F.lit(NO_ID)).alias("d"), F.xxhash64("x").alias("k"), "x").join(wanted, ["d", "k"]).select("nid", "x")
    texts = written(texts, "texts")
    release(spark)

    every, labels = [], None
    if not count_links:
        links = cut_lineage(compare(star, texts, width, percent, tasks=n_blocks))
        every = [links]
        labels = components(links, "u", "v")

    release(spark)
    # 6. All pairs of list members that are not connected so far; to count links, all pairs.
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """List members with the pair of blocks (p <= q) that they are tested in, and their own block: a member of a list of n blocks
        is in n such pairs, so that every two members meet in one place."""
        for b in batches:
            for part in b.column(0).to_pylist():
                h, nid, n, pos, rare, size = unpack(part)
                blocks = -(-size.astype(np.int64) // LIST_BLOCK)
                block = (mix64(nid.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                first = np.cumsum(blocks) - blocks
                at = np.repeat(np.arange(len(h)), blocks)
                other = np.arange(len(at)) - first[at]
                p, q = np.minimum(block[at], other), np.maximum(block[at], other)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)[at]), *(pa.array(x.astype(np.int64)[at]) for x in (nid, n, pos, rare)), pa.array(p), pa.array(q), pa.array(block[at])], names=["h", "nid", "n", "pos", "rare", "p", "q", "block"])

    each = lists.mapInArrow(entries, "h long, nid long, n long, pos long, rare long, p long, q long, block long")
    each = each.withColumn("label", F.col("nid")) if count_links else each.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    part = each.select("h", "p", "q", "nid", "n", "pos", "rare", "label", "block").repartition(n_blocks, "h", "p", "q").sortWithinPartitions("h", "p", "q").mapInArrow(lambda x: unconnected(x, percent, n_blocks), "r long, part binary")
    pairs = cut_lineage(part.repartitionById(n_blocks, F.col("r").cast("int")).sortWithinPartitions("r").mapInArrow(lambda x: candidates(x, percent), "u long, v long, c long"))
    release(spark)
    # If there are many, comparing the likeliest partner of each node first connects most of what there is to connect.
    while not count_links and pairs.count() > 4 * nodes.count():
        best = cut_lineage(pairs.groupBy("u").agg(F.max_by("v", F.struct("c", "v")).alias("v")))
        found = cut_lineage(compare(best, texts, width, percent, tasks=n_blocks))
        if not found.isEmpty():
            every.append(found)
            to = components(union(every), "u", "v")
            of = lambda c, k: to.select(F.col("node").alias(c), F.col("label").alias(k))  # noqa: E731,B023
            pairs = pairs.join(of("u", "p"), "u", "left").join(of("v", "q"), "v", "left").where(F.coalesce("p", "u") != F.coalesce("q", "v"))
        pairs = cut_lineage(pairs.select("u", "v", "c").join(best, ["u", "v"], "left_anti"))
        if found.isEmpty():
            break
    every.append(cut_lineage(compare(pairs, texts, width, percent, tasks=n_blocks)))
    discard(texts)
    discard(lists)
    release(spark)

    # 7. Back to the rows.
    links = union(every)
    labels = components(links, "u", "v")
    degree = links.select(F.explode(F.array("u", "v")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("component", F.coalesce("label", "nid"))
    least = named.groupBy("component").agg(F.min("i").alias("component_id"))
    named = named.join(least, "component").join(degree, "nid", "left")
    return sets, named.select("nid", "i", "k", "component", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def may_link(x: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs, in the columns of counted(), may be similar enough by all that their lists say. Exact bounds:

    - of the set whose prefix ends first, only what follows its prefix can be shared besides the lists in common;
    - no common shingle comes before the first one met, in either set;
    - rare shingles come first, so what is shared is the rare ones in common, rare ones that follow a prefix, and frequent ones.

    Sets small enough for subsets share subsets, which says nothing of the kind."""
    _, _, n, m, rare_n, rare_m, lists, rare_lists, p, q = x
    need = percent * (n + m)  # of the overlap times 100 + percent
    prefix = [a - -(-percent * a // 100) + 1 for a in (n, m)]
    rest = np.maximum(n - prefix[0], m - prefix[1])
    rare_rest = np.maximum(np.maximum(rare_n - prefix[0], 0), np.maximum(rare_m - prefix[1], 0))
    most = np.minimum(lists + rest, np.minimum(np.minimum(n - p, m - q), rare_lists + rare_rest + np.minimum(n - rare_n, m - rare_m)))
    return (np.minimum(n, m) <= 2 * MOST_LIGHT) | ((100 + percent) * most >= need)


def counted(x: np.ndarray) -> np.ndarray:
    """Columns (u, v, n of u, n of v, rare of u, rare of v, lists, lists of rare shingles, first place in u, in v), those of one pair
    summed up."""
    x = x[:, np.lexsort((x[1], x[0]))]
    first = np.flatnonzero(np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])]))
    return np.stack([*x[:6, first], *(np.add.reduceat(x[k], first) for k in (6, 7)), *(np.minimum.reduceat(x[k], first) for k in (8, 9))])


def unconnected(batches: Iterator[pa.RecordBatch], percent: int, n_blocks: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Of sorted list entries (h, p, q, nid, n, pos, rare, label, block), the pairs of members (u above v), of the two blocks p and q if
    these differ, whose labels differ and whose sizes allow a link, counted up within the task in bounded pieces: for each block of pairs, compressed columns as in counted()."""

    def flush(held: list[np.ndarray]) -> Iterator[tuple]:
        x = counted(np.concatenate(held, axis=1))
        block = (mix64(x[0].view(np.uint64) ^ mix64(x[1].view(np.uint64))) % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(n_blocks + 1))
        for r in range(n_blocks):
            at = order[cut[r] : cut[r + 1]]
            if len(at):
                yield r, pack(*x[:2, at], *x[2:, at].astype(np.uint32))

    def of_list(p, q, nid, n, pos, rare, label, block) -> Iterator[np.ndarray]:
        order = np.argsort(nid)
        nid, n, pos, rare, label, block = nid[order], n[order], pos[order], rare[order], label[order], block[order]
        two = p[0] != q[0]
        step = max(1, most // len(nid))
        for a in range(1, len(nid), step):
            b = min(a + step, len(nid))
            fits = (label[a:b, None] != label[None, :b]) & (np.arange(a, b)[:, None] > np.arange(b)[None])
            if two:
                fits &= block[a:b, None] != block[None, :b]
            small, large = np.minimum(n[a:b, None], n[None, :b]), np.maximum(n[a:b, None], n[None, :b])
            u, v = np.nonzero(fits & (100 * small >= percent * large))
            if len(u):
                u = u + a
                yield np.stack([nid[u], nid[v], n[u], n[v], rare[u], rare[v], np.ones(len(u), np.int64), pos[u] < rare[u], pos[u], pos[v]])

    def lists() -> Iterator[list[np.ndarray]]:
        rest = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(9)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            h, p, q = cols[:3]
            if not len(h):
                continue
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            for a, b in zip(first, first[1:], strict=False):  # the last list may go on in the next batch
                yield [c[a:b] for c in cols[1:]]
            rest = [c[first[-1] :] for c in cols]
        if rest is not None:
            yield rest[1:]

    def rows() -> Iterator[tuple]:
        held, size = [], 0
        for own in lists():
            for x in of_list(*own):
                held.append(x)
                size += x.shape[1]
                if size >= most:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return batched(rows(), pa.schema([("r", pa.int64()), ("part", pa.binary())]))


def candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each block (rows of one block stand together) that may link by all that their lists say: u, v, lists."""

    def settled(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = counted(np.concatenate(parts, axis=1))
        x = x[:, may_link(x, percent)]
        if x.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for k in (0, 1, 6)], names=["u", "v", "c"])

    last, held, size = None, [], 0
    for b in batches:
        for r, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != last and held:
                yield from settled(held)
                held, size = [], 0
            last = r
            held.append(np.stack([x.astype(np.int64) for x in unpack(part)]))
            size += held[-1].shape[1]
            if size >= 1 << 19:
                held, size = [counted(np.concatenate(held, axis=1))], 0
    if held:
        yield from settled(held)


def node_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def compare(pairs: DataFrame, texts: DataFrame, width: int, percent: int, at_once: int = 256, tasks: int = 16) -> DataFrame:
    """The pairs (u, v) whose texts are similar. Each u's text is sent to v's; a v that many are compared with is in as many places as
    leave about `at_once` of them to each."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    many = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > at_once).select("v", F.ceil(F.col("n") / at_once).alias("places"))
    salted = pairs.join(many, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("places", F.lit(1))).alias("salt"))
    asks = salted.join(texts.withColumnRenamed("nid", "u"), "u").select("v", "salt", "u", "x")
    asked = salted.select("v", "salt").distinct().join(texts.withColumnRenamed("nid", "v"), "v").select("v", "salt", F.lit(None).cast("long").alias("u"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            own = None
            for b in slices(batches):
                for v, u, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                    s = shingles(data, width)
                    if u is None:
                        own = s
                    elif similar(own, s, percent):
                        yield u, v

        return batched(rows(), schema)

    dealt = asks.unionByName(asked).repartition(tasks, "v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())
    return dealt.select("v", "u", "x").mapInArrow(run, "u long, v long")
