"""State over batches and restarts, expiry, and the rank errors of sketches."""

import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.streaming import sessions as ST

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def store(spark):
    kept = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ST.STORE)
    yield
    spark.conf.unset(PROVIDER) if kept is None else spark.conf.set(PROVIDER, kept)


def run(spark, tmp_path, rows, forget_ms=None):
    spark.createDataFrame(rows, ST.TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
    out = ST.pending_questions(spark.readStream.schema(ST.TURNS).parquet(str(tmp_path / "turns")), forget_ms)
    out.writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return {(r.session, r.turn): (r.pending, r.query) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_pending_over_restarts(spark, tmp_path, store):
    run(spark, tmp_path, [("a", 1, "Which model?", True), ("b", 1, "Which one?", True), ("b", 2, "the second", False)])
    run(spark, tmp_path, [("c", 1, "How?", False)])
    got = run(spark, tmp_path, [("a", 2, "the X20", False), ("a", 3, "and now", False), ("b", 3, "more", False), ("c", 2, "so", False)])
    assert got["a", 2] == ("Which model?", "Which model — the X20") and got["a", 3][0] is None and got["b", 2][0] == "Which one?" and got["b", 3][0] is None and got["c", 2][0] is None
    assert len(got) == 8


def test_pending_is_forgotten(spark, tmp_path, store):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    run(spark, tmp_path, [("a", 1, "Which model?", True), ("b", 1, "Which one?", True)], 1000)
    time.sleep(2)
    got = run(spark, tmp_path, [("a", 2, "the X20", False)], 1000)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got["a", 2] == (None, "the X20")


class Slot:
    """A slot of state that counts its uses, each of which is a call to the JVM."""

    def __init__(self, value):
        self.value, self.uses = value, 0

    def exists(self):
        self.uses += 1
        return self.value is not None

    def get(self):
        self.uses += 1
        return self.value

    def update(self, value):
        self.uses, self.value = self.uses + 1, value

    def clear(self):
        self.uses, self.value = self.uses + 1, None


def test_the_slot_is_used_as_little_as_can_be():
    big = 2**53 + 1
    turns = [Row(session="a", turn=None, text="last", asks=False), Row(session="a", turn=big, text="so", asks=True), Row(session="a", turn=1, text="the X20", asks=False)]
    for held, rows, uses, left in ((None, turns, 1, None), (("Which?",), turns, 2, None), (None, turns[1:], 2, ("so",))):
        p = ST.Pending(None)
        p.slot = Slot(held)
        got = [(r.turn, r.pending) for r in p.handleInputRows(("a",), iter(rows), None)]
        assert got == [(1, held and held[0]), (big, None), (None, "so")][: len(rows)] and (p.slot.uses, p.slot.value) == (uses, left)


def test_percentiles_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {0: rng.permutation(20_000), 1: rng.integers(0, 50, 900), 2: np.array([7]), 9: np.array([1])}
    rows = [(f"2024-01-0{d + 1}T10:00:00.000000+00:00", int(v)) for d, x in values.items() if d < 9 for v in x] + [("2024-02-01T10:00:00.000000+00:00", 1), ("2024-01-01T11:00:00.000000+00:00", None)]
    spark.createDataFrame(rows, "timestamp string, latency_ms int").repartition(4).write.json(str(tmp_path / "log"))
    out = ST.windowed_percentiles(ST.audit_stream(spark, str(tmp_path / "log")).select("at", "latency_ms"), "latency_ms", {"p50": 0.5, "p95": 0.95}, "1 day", "1 day")
    stream = out.select(F.dayofmonth("window.start").alias("d"), F.month("window.start").alias("m"), "n", "p50", "p95").writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    stream.trigger(availableNow=True).start().awaitTermination()
    got = {r.d - 1: r for r in spark.read.parquet(str(tmp_path / "out")).where("m = 1").collect()}
    for d in (0, 1, 2):
        x = np.sort(values[d])
        assert got[d].n == len(x)
        for share, v in ((0.5, got[d].p50), (0.95, got[d].p95)):
            assert np.searchsorted(x, v, "left") <= (share + 0.01) * len(x) and np.searchsorted(x, v, "right") >= (share - 0.01) * len(x)
