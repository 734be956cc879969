"""Mixing sources to target weights by hierarchical budgeting.

Documents stand in a tree of domain, language and source. A token budget goes down the tree in proportion to weights; a child
that can't use its part (it has no more tokens, `max_epochs` times over) leaves the rest to its siblings in proportion to
theirs, and only what all siblings together can't use goes to the parent's siblings. Each leaf's part is filled from its
seeded order of epoch after epoch, as the longest prefix of whole documents that fits.

Everything is DataFrame functions. A leaf isn't sorted as a whole: its order is cut into BUCKETS of a hash, whose sums locate
the one bucket where the budget runs out, and only that bucket's rows are ordered. What results is one cut a leaf; documents
are tested against it where they are, so that no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order's hash that name a bucket.
BUCKET_DIGITS = 3
MOST_BROADCAST_LEAVES = 100_000
# Parameters of the query and the pipeline: weights of domains and languages; others get OTHER.
DOMAIN_WEIGHTS = {"d0": 40, "d1": 30, "d2": 20, "d3": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
OTHER = 5
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """A source's domain: d0 to d3 by its trailing number modulo 4; `other` if it has none."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(n == "", F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(F.try_to_number(n, F.lit("999999999")).cast("long"), F.lit(4)).cast("string")))


def weight_of(column: Column, weights: dict[str, int], other: int = OTHER) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(column == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def pour(children: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, name: str) -> DataFrame:
    """children with a column `share`: each parent's budget dealt in proportion to weights and up to capacities.

    By increasing capacity for its weight, a child is full if its capacity is at most its part of what the children before it
    leave; the others part the rest, rounded down."""
    order = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), F.col(name))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    x = children.withColumn("_used", F.coalesce(F.sum(capacity).over(before), F.lit(0))).withColumn("_w", F.sum(weight).over(onward))
    x = x.withColumn("_full", F.col(capacity).cast("decimal(38,0)") * F.col("_w") <= (F.col(budget) - F.col("_used")).cast("decimal(38,0)") * F.col(weight))
    x = x.withColumn("_left", F.col(budget) - F.sum(F.when(F.col("_full"), F.col(capacity)).otherwise(0)).over(whole))
    x = x.withColumn("_parts", F.sum(F.when(~F.col("_full"), F.col(weight)).otherwise(0)).over(whole))
    share = F.when(F.col("_full"), F.col(capacity)).otherwise(F.expr(f"cast(cast(_left as decimal(38,0)) * {weight} div nullif(_parts, 0) as bigint)"))
    return x.withColumn("share", share).drop("_used", "_w", "_full", "_left", "_parts")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"), domain_of(F.col(source_col)).alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")
    )


def budgets(leaves: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """Leaf rows (LEAF and tokens) with `share`, the tokens each may have."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.expr(f"cast(coalesce(sum(tokens), 0) * {percent} div 100 as bigint)").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col("domain"), DOMAIN_WEIGHTS)).withColumn("root", F.lit(0))
    domains = pour(domains.join(F.broadcast(total)), ["root"], "budget", "weight", "capacity", "domain").select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col("lang"), LANG_WEIGHTS))
    langs = pour(langs.join(domains, "domain"), ["domain"], "budget", "weight", "capacity", "lang").select("domain", "lang", F.col("share").alias("budget"))
    sources = leaves.withColumn("weight", F.lit(1).cast("long")).join(langs, ["domain", "lang"])
    return pour(sources, ["domain", "lang"], "budget", "weight", "capacity", "source").select(*LEAF, "share")


def cuts(rows: DataFrame, percent: int, max_epochs: int, seed: int) -> DataFrame:
    """A row for each leaf: LEAF, cut_epoch and cut_key, cut_id: the last place in the leaf's order that is taken (null: nothing).

    The order is by epoch, hash and identifier; rows equal in these are taken together or not at all."""
    rows = cut_lineage(rows.where("n_tokens > 0"))  # narrow rows: words are counted once
    leaves = budgets(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), percent, max_epochs)
    each = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
    each = each.withColumn("key", order_key(seed, F.col("epoch"), F.col("id"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = each.groupBy(*LEAF, "epoch", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    line = Window.partitionBy(*LEAF).orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("tokens").over(line)).join(leaves, LEAF)
    # Whole buckets before the cut, and the bucket in which it lies.
    edge = sums.where((F.col("upto") > F.col("share")) & (F.col("upto") - F.col("tokens") <= F.col("share"))).select(*LEAF, "epoch", "bucket", (F.col("share") - F.col("upto") + F.col("tokens")).alias("room"))
    # The default frame: rows that stand at one place count together.
    within = Window.partitionBy(*LEAF, "epoch", "bucket").orderBy(F.struct("key", F.coalesce("id", F.lit(-(1 << 63)))))
    last = each.join(edge, [*LEAF, "epoch", "bucket"]).withColumn("upto", F.sum("n_tokens").over(within)).where("upto <= room")
    last = last.groupBy(*LEAF).agg(F.max(F.struct("epoch", "key", F.coalesce("id", F.lit(-(1 << 63))).alias("id"))).alias("last"))
    whole = sums.where(F.col("upto") <= F.col("share")).groupBy(*LEAF).agg(F.max(F.struct("epoch", "bucket")).alias("b"))
    # A key with "g" after the bucket's digits stands after all keys of that bucket.
    whole = whole.select(*LEAF, F.struct(F.col("b.epoch").alias("epoch"), F.concat("b.bucket", F.lit("g")).alias("key"), F.lit(0).cast("long").alias("id")).alias("last"))
    return last.unionByName(whole).groupBy(*LEAF).agg(F.max("last").alias("last")).select(*LEAF, F.col("last.epoch").alias("cut_epoch"), F.col("last.key").alias("cut_key"), F.col("last.id").alias("cut_id"))


def _taken(docs: DataFrame, percent: int, max_epochs: int, seed: int, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """docs, a row for each time a document is taken, and the names of the added columns: epoch, domain, tokens."""
    rows = prepared(docs, id_col, text_col, lang_col, source_col)
    epoch, domain, tokens, p_domain, p_lang, p_source, p_epoch, p_key, p_id = fresh("epoch", "domain", "tokens", *LEAF, "cut_epoch", "cut_key", "cut_id")
    plan = cuts(rows, percent, max_epochs, seed).toDF(p_domain, p_lang, p_source, p_epoch, p_key, p_id)
    plan = cut_lineage(plan)
    if plan.count() <= MOST_BROADCAST_LEAVES:
        plan = F.broadcast(plan)
    out = docs.withColumns({domain: domain_of(F.col(source_col)), tokens: F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")}).where(F.col(tokens) > 0)
    out = out.join(plan, (F.col(domain) == F.col(p_domain)) & (F.coalesce(F.col(lang_col), F.lit("")) == F.col(p_lang)) & (F.coalesce(F.col(source_col), F.lit("")) == F.col(p_source)))
    here = F.struct(F.col(p_epoch), order_key(seed, F.col(p_epoch), F.col(id_col)), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))) <= F.struct(p_epoch, p_key, p_id)
    times = F.col(p_epoch) + F.when(here, 1).otherwise(0)
    out = out.withColumn(epoch, F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return out, [epoch, domain, tokens]


ADDED = ("mix_epoch", "mix_domain", "mix_tokens")


def mix(docs: DataFrame, percent: int = 80, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs, all columns, a row for each time a document is taken, with added columns mix_epoch (from 0), mix_domain and
    mix_tokens (words, as runs of other characters than space and tab to carriage return). Columns of docs with these
    names give way to them; take() leaves them as they are.

    The budget is `percent` of all tokens. Null language or source: a leaf of its own, named ''. Documents without words are
    never taken. A text of any length counts by all its words, and is taken whole or not at all. Repeated rows, and rows without identifier, stand at one place of the order and are taken together.
    """
    out, own = _taken(docs, percent, max_epochs, seed, id_col, text_col, lang_col, source_col)
    return out.select(*[c for c in docs.columns if c not in ADDED], *[F.col(c).alias(name) for c, name in zip(own, ADDED, strict=True)])


def take(docs: DataFrame, percent: int = 80, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs as mix() takes them, a row for each time, with its own columns only."""
    return _taken(docs, percent, max_epochs, seed, id_col, text_col, lang_col, source_col)[0].select(*docs.columns)
