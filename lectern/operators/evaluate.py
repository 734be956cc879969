"""Metrics of the audit log, evaluation of retrieval, and calibration of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the value at place min(int(n * share), n - 1) of the sorted non-null values.

    Values are counted first, so what is ordered are distinct values, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*by).orderBy(value)
    counts = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    place = lambda s: F.least(F.floor(F.col("_n") * s), F.col("_n") - 1)
    return counts.groupBy(*by).agg(*[F.min(F.when(F.col("_to") > place(s), F.col(value))).alias(name) for name, s in shares.items()])


def share(condition: Column, of: Column | None = None) -> Column:
    """The share of rows that meet a condition, of those that meet `of`; 0 without any; 3 digits."""
    n = F.count(F.lit(1)) if of is None else F.count_if(of)
    met = F.count_if(condition if of is None else condition & of)
    return F.round(F.coalesce(met / F.nullif(n, F.lit(0)), F.lit(0.0)), 3)


def audit_metrics(log: DataFrame) -> DataFrame:
    """One row of figures over the log: n_queries, percentiles of latencies, budget and other rates."""
    on_topic = ~F.coalesce("off_topic", F.lit(False))
    rates = log.agg(
        F.count(F.lit(1)).alias("n_queries"),
        share(F.col("time_to_first_token_ms").isNotNull()).alias("ttft_measured_rate"),
        share(F.coalesce("retrieval_ms", F.lit(0)) < SETTINGS.retrieval_budget_ms, on_topic).alias("retrieval_within_budget_rate"),
        share(F.col("latency_ms") < SETTINGS.answer_budget_ms, on_topic).alias("e2e_within_budget_rate"),
        share(F.col("fallback")).alias("fallback_rate"),
        share(F.coalesce("off_topic", F.lit(False))).alias("off_topic_rate"),
        share(F.col("n_images") > 0).alias("images_attached_rate"),
        share(F.size("retrieved_chunk_ids") > 0).alias("hit_rate_any_chunk"),
        share(F.size(F.coalesce("corrections", F.array())) > 0).alias("typo_corrected_rate"),
    )
    out = rates
    one = log.withColumn("_all", F.lit(0)).withColumn("retrieval_ms", F.coalesce("retrieval_ms", F.lit(0)))
    for column, name in (("latency_ms", "latency_ms"), ("retrieval_ms", "retrieval_ms"), ("time_to_first_token_ms", "ttft_ms")):
        p = nearest_rank(one, ["_all"], column, {f"{name}_p50": 0.5, f"{name}_p95": 0.95}).drop("_all")
        out = out.join(F.broadcast(p), how="left")  # one row with one row
    zeros = {c: F.coalesce(c, F.lit(0)) for c in out.columns if c.endswith(("_p50", "_p95"))}
    return out.withColumns(zeros)


def decisions(rows: DataFrame) -> DataFrame:
    """kind (null: all), n, correct, accuracy of rows (kind, ok)."""
    return rows.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"), F.round(F.avg(F.col("ok").cast("int")), 3).alias("accuracy"))


def hits(ranked: DataFrame) -> DataFrame:
    """query_id, first: the rank of the first relevant result of ranked (query_id, rank, relevant); null without any."""
    return ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))


def hit_rates(first: DataFrame) -> DataFrame:
    """n, hit_1, hit_3, hit_5 and mrr over queries."""
    at = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    return first.agg(F.count(F.lit(1)).alias("n"), at(1), at(3), at(5), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def figures_found(rows: DataFrame) -> DataFrame:
    """found, expected over queries of rows (query_id, matches, expected): found counts up to what is expected."""
    per = rows.groupBy("query_id").agg(F.count_if("matches").alias("m"), F.max("expected").alias("e"))
    return per.agg(F.sum(F.least("m", "e")).alias("found"), F.sum("e").alias("expected"))


def thresholds(scores: DataFrame, answerable: str, near: str, largest_gap: Column) -> DataFrame:
    """Calibration from scores (kind, score): margin = 1.5 times the largest gap; the threshold lies a margin under the least
    answerable score, and not above the least near one. All rounded down to 4 digits."""
    f4 = lambda c: F.floor(c * 10000) / 10000
    out = scores.agg(F.min(F.when(F.col("kind") == answerable, F.col("score"))).alias("least_answerable"), F.min(F.when(F.col("kind") == near, F.col("score"))).alias("least_near"))
    out = out.withColumn("margin", f4(largest_gap * 1.5))
    return out.withColumn("threshold", F.least(f4(F.col("least_answerable") - F.col("margin")), f4(F.col("least_near"))))


def resampled_gaps(scores: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """draw, n_below, largest_gap over seeded halves of scores (id, score): how far the rest falls below each half's least score.

    The scores are a calibration set of a few dozen rows, each of which stands in every draw; what is broadcast are the draws,
    whose number is a parameter."""
    n = scores.count()
    each = scores.join(F.broadcast(scores.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.col("id").cast("string")).cast("binary"))
    each = each.withColumn("_k", F.row_number().over(Window.partitionBy("draw").orderBy(key, "id"))).withColumn("_in", F.col("_k") <= n // 2)
    least = F.min(F.when(F.col("_in"), F.col("score"))).over(Window.partitionBy("draw"))
    below = each.withColumn("gap", least - F.col("score")).where(~F.col("_in") & (F.col("gap") > 0))
    return below.groupBy("draw").agg(F.count(F.lit(1)).alias("n_below"), F.round(F.max("gap"), 6).alias("largest_gap"))


def sweep(pairs: DataFrame, limits: list[float]) -> DataFrame:
    """limit, kind, n, matched: for each threshold how many pairs (kind, ratio, promotes) match, with the guard against function words."""
    each = pairs.withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    return each.groupBy("limit", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("ratio") >= F.col("limit")) & ~F.col("promotes")).alias("matched"))


def typos(words: DataFrame) -> DataFrame:
    """word, kind, typo: a letter dropped, two swapped, one replaced by `e`, at a place from a hash of the word; words of 5 letters or more."""
    at = F.pmod(F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long"), F.length("word") - 1).cast("int") + 1
    w, n = F.col("word"), F.length("word")
    part = lambda a, k: F.substring(w, a, k)
    forms = F.array(
        F.struct(F.lit("drop").alias("kind"), F.concat(part(F.lit(1), at - 1), part(at + 1, n)).alias("typo")),
        F.struct(F.lit("swap").alias("kind"), F.concat(part(F.lit(1), at - 1), part(at + 1, F.lit(1)), part(at, F.lit(1)), part(at + 2, n)).alias("typo")),
        F.struct(F.lit("replace").alias("kind"), F.concat(part(F.lit(1), at - 1), F.lit("e"), part(at + 1, n)).alias("typo")),
    )
    return words.where(n >= 5).select("word", F.inline(forms)).where("typo != word")


def term_typos(terms: DataFrame) -> DataFrame:
    """term, typo: of each term (term) of two or three words those with one of its words of 5 letters or more mistyped as in typos()."""
    words = terms.select("term", F.split("term", " ").alias("w")).distinct().where(F.size("w").between(2, 3))
    each = words.select("term", "w", F.posexplode("w").alias("k", "word"))
    wrong = typos(each.select("word").distinct()).select("word", F.col("typo").alias("_typo"))
    said = F.array_join(F.transform("w", lambda x, i: F.when(i == F.col("k"), F.col("_typo")).otherwise(x)), " ")
    return each.join(wrong, "word").select("term", said.alias("typo")).distinct()


def calibrate(matched: DataFrame, typed: DataFrame, windows: DataFrame, limits: list[float]) -> DataFrame:
    """limit, n_typos, recovered, rewritten, rewritten_guarded: at each threshold, how many typos (term, typo) that correct text
    (windows: gram) doesn't hold find their term again, and how many windows of correct text would be rewritten as another term,
    by the threshold alone and with the guard against function words. matched (gram, term, ratio, promotes): the best term of
    each window and typo, at the least threshold and without the guard."""
    best = matched.select("gram", F.col("term").alias("found"), "ratio", "promotes")
    typo = typed.join(windows.select(F.col("gram").alias("typo")).distinct(), "typo", "left_anti").join(best, F.col("typo") == F.col("gram"), "left")
    typo = typo.select(F.lit(1).alias("typo"), F.when((F.col("found") == F.col("term")) & ~F.col("promotes"), F.col("ratio")).alias("ratio"), F.lit(False).alias("promotes"))
    text = windows.select("gram").distinct().join(best, "gram").where("found != gram").select(F.lit(0).alias("typo"), "ratio", "promotes")
    each = typo.unionByName(text).groupBy("typo", "ratio", "promotes").agg(F.count(F.lit(1)).alias("n"))  # few distinct ratios
    each = each.withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_typo, reached = F.col("typo") == 1, F.coalesce(F.col("ratio") >= F.col("limit"), F.lit(False))
    return each.groupBy("limit").agg(total(is_typo).alias("n_typos"), total(is_typo & reached).alias("recovered"), total(~is_typo & reached).alias("rewritten"), total(~is_typo & reached & ~F.col("promotes")).alias("rewritten_guarded"))
