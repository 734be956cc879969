"""The trie of conversations' prefixes, as preorder intervals.

A prefix is named by a sum, over its turns, of hashes of (place, turn): 128 bits that add up along a conversation by distributed
prefix sums, so that not even a conversation with a third of all turns is one task's. Nodes are the distinct prefixes.

Conversations are ranked lexicographically: by the branches they take, where a branch is a child of a node with several. (Between
branches a path has no choice, so nothing else needs sorting. A path with B branches has B other conversations beside it
that are as long as where they leave it, hence B is at most the square root of twice the turns, and usually a few.) Members of a
node are then an interval of ranks, and nodes ordered by (rank of the first member, depth) are in preorder. A node's subtree ends
where the next rank behind its interval begins; leaves and savings in it are the difference of two prefix sums over the preorder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, cut_lineage, written
from .prefix_sums import running

#: At most so many first turns are taken from the conversation ahead; blocks of identifiers that are joined before they are hashed.
MOST_SHARED, BLOCK = 8, 4096


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c, pos (from 1), k1 and k2 (128 bits of SHA-256 of role and text), bytes (of the text, in UTF-8)."""
    src = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x")).where("c is not null")
    sha = F.sha2(F.concat(F.length("r"), F.lit(":"), F.col("r"), F.col("x")), 256)
    src = src.select("c", "t", "r", "x", F.lit(1).cast("long").alias("one"), F.octet_length("x").cast("long").alias("bytes"), sha.alias("sha"))
    dealt = running(src, ["c", "t", "r", "x"], ["one"], "c", [F.col("c"), F.col("t"), F.col("r"), F.substring("x", 1, 48)], ["c", "one", "bytes", "sha"])
    half = lambda a: F.conv(F.substring("sha", a, 16), 16, -10).cast("long")
    return dealt.select("c", F.col("one_upto").alias("pos"), half(1).alias("k1"), half(17).alias("k2"), "bytes")


def shared_turns(c: Column) -> Column:
    """How many turns a conversation takes from the one its five begin with: from a hash of its identifier."""
    return F.crc32(c.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The conversations (c, n: turns once rebuilt) and their turns (c, pos, k1, k2, bytes). Conversation c is the first h turns of
    conversation c - c % 5 (the sign of the remainder is c's) and then its own less its first h."""
    own = cut_lineage(numbered_turns(turns, conv_col, turn_col, role_col, text_col))
    convs = own.groupBy("c").agg(F.max("pos").alias("n_own")).select("c", "n_own", shared_turns(F.col("c")).alias("h"), (F.col("c") - F.col("c") % 5).alias("base"))
    ahead = convs.select(F.col("c").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = cut_lineage(convs.join(ahead, "base", "left").select("c", "base", "h", taken.alias("b"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")))
    first = own.where((F.col("c") % 5 == 0) & (F.col("pos") <= MOST_SHARED)).withColumnRenamed("c", "base")
    lent = first.join(convs.select("c", "base", "b"), "base").where(F.col("pos") <= F.col("b")).select("c", "pos", "k1", "k2", "bytes")
    kept = own.where(F.col("pos") > shared_turns(F.col("c"))).join(convs.select("c", "b", "h"), "c").select("c", (F.col("pos") + F.col("b") - F.col("h")).alias("pos"), "k1", "k2", "bytes")
    return convs.select("c", "n"), lent.unionByName(kept)


def digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256 of the identifiers c of each node (p1, p2), ascending. Blocks of them are joined where they are; a digest
    is one sequence, so one task streams through a node's blocks, of which it holds one."""
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, sha = None, None
            for b in batches:
                for p1, p2, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (p1, p2) != node:
                        if node:
                            yield *node, sha.hexdigest()
                        node, sha = (p1, p2), hashlib.sha256()
                        sha.update(ids.encode())
                    else:
                        sha.update(b"," + ids.encode())
            if node:
                yield *node, sha.hexdigest()

        return batched(rows(), schema)

    blocks = ends.groupBy("p1", "p2", F.floor(F.col("c") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = blocks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "block")
    return dealt.select("p1", "p2", "ids").mapInArrow(run, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id (null: the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder (from 0) and subtree_end (preorder of the last node below).

    Null role or text counts as empty; turns are ordered by turn (null first), and those of equal turn by role and text, so repeated
    rows are turns like any other. Rows without an identifier belong to no conversation and are left out. An empty table has no
    nodes, not even a root. A conversation of any length spreads over tasks; texts are hashed where they are read, in one piece.
    Other columns are ignored. Prefixes are told apart by 128 bits.
    """
    convs, turns = rebuilt(turns, conv_col, turn_col, role_col, text_col)
    turns = turns.select("c", "pos", "bytes", F.xxhash64(F.lit(1), "pos", "k1", "k2").alias("p1"), F.xxhash64(F.lit(2), "pos", "k1", "k2").alias("p2"))
    path = running(turns, ["c", "pos"], ["p1", "p2"], "c").select(
        "c", F.col("pos").alias("depth"), "bytes", F.col("p1_upto").alias("p1"), F.col("p2_upto").alias("p2"), F.col("p1_before").alias("q1"), F.col("p2_before").alias("q2")
    )
    path = written(path, "paths")

    # Ranks of conversations by the branches they take. All first turns count as branches, which spares a join on the root.
    several = path.where("depth > 1").select("q1", "q2", "p1", "p2").distinct().groupBy("q1", "q2").count().where("count > 1")
    taken = path.where("depth > 1").join(several, ["q1", "q2"], "left_semi").unionByName(path.where("depth = 1")).select("c", F.struct("depth", "p1", "p2").alias("s"))
    taken = taken.groupBy("c").agg(F.sort_array(F.collect_list("s")).alias("branches"))
    ranks = convs.join(taken, "c", "left").select("c", "n", "branches", F.lit(1).cast("long").alias("one"))
    ranks = ranks.withColumn("branches", F.coalesce("branches", F.array().cast(ranks.schema["branches"].dataType)))
    ranks = cut_lineage(running(ranks, ["branches", "n", "c"], ["one"]).select("c", "n", F.col("one_before").alias("rank")))

    # Nodes, the root among them, and who ends there.
    root = ranks.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), *[F.lit(0).cast("long").alias(x) for x in ("p1", "p2", "q1", "q2")], "n", "rank")
    every = path.join(ranks, "c").select(*root.columns).unionByName(root)
    nodes = every.groupBy("p1", "p2", "depth").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("rank").alias("first"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("bytes").alias("bytes")
    )
    nodes = cut_lineage(nodes)
    ends = digests(every.where(F.col("depth") == F.col("n")).select("p1", "p2", "c"))
    above = nodes.where("depth > 0").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"q1": "p1", "q2": "p2"})
    whole = nodes.join(above, ["p1", "p2"], "left").join(ends, ["p1", "p2"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)),
        "leaf": F.when(F.col("n_children") > 0, 0).otherwise(1).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"), "one": F.lit(1).cast("long"),
    })

    # Prefix sums over the preorder; where each rank begins, and the end of all.
    ordered = cut_lineage(running(whole, ["first", "depth"], ["one", "leaf", "saved"]))
    starts = ordered.groupBy("first").agg(*[F.min(f"{x}_before").alias(f"{x}_end") for x in ("one", "leaf", "saved")])
    end = ordered.agg(F.max("n_convs").alias("first"), *[F.max(f"{x}_upto").alias(f"{x}_end") for x in ("one", "leaf", "saved")])
    behind = starts.unionByName(end).withColumnRenamed("first", "last")
    parent = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = ordered.withColumn("last", F.col("first") + F.col("n_convs")).join(behind, "last").join(parent, ["q1", "q2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaf_end") - F.col("leaf_before")).alias("n_leaves"), (F.col("saved_end") - F.col("saved_before")).alias("saved_tokens"), "ends_sha256",
        F.col("one_before").alias("preorder"), (F.col("one_end") - 1).alias("subtree_end"),
    )
