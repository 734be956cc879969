"""Streaming forms: sessions with a pending question, and metrics and percentiles over the audit log as it grows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..sources.corpus import AUDIT

TURNS = "session string, turn long, text string, asks boolean"


class Pending(StatefulProcessor):
    """One slot for each session: the text that asked back last, forgotten after a time without a turn."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The store drops what has not been written for so long; timers would wake each session for nothing.
        self.slot = handle.getValueState("pending", "text string", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:  # noqa: N802
        # Each use of the slot is a call to the JVM, so none is made that changes nothing.
        held = self.slot.get()
        pending = held[0] if held else None
        for r in sorted(rows, key=lambda r: (r.turn is None, r.turn)):
            yield Row(session=key[0], turn=r.turn, text=r.text, pending=pending)
            pending = r.text if r.asks else None
        if pending is not None:
            self.slot.update((pending,))
        elif held:
            self.slot.clear()

    def close(self) -> None:
        pass


#: The state store that the processor needs, and the setting for it.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pending_questions(turns: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """A stream of turns (TURNS) with what was pending as each came, and the query to ask: one slot of state for each session, carried
    over batches and restarts, empty where nothing is pending.

    Turns of one batch are taken in their order; a turn that asks back leaves its text pending, any other clears it. With forget_ms a
    question is dropped that long (of processing time) after it was asked; Spark then goes on with batches without rows, so a stream that
    is to end (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled to be false. The processor needs the state store STORE, which is set in the
    session where another one is."""
    if turns.sparkSession.conf.get(PROVIDER, None) != STORE:
        turns.sparkSession.conf.set(PROVIDER, STORE)
    out = turns.groupBy("session").transformWithState(Pending(forget_ms), "session string, turn long, text string, pending string", "Append", "ProcessingTime" if forget_ms else "None")
    return out.withColumn("query", T.compose(F.col("pending"), F.col("text")))


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """The audit log as a stream of appended files, with event time."""
    return spark.readStream.schema(AUDIT).json(path).withColumn("at", F.to_timestamp("timestamp"))


def windowed_rates(log: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per window of event time: queries, fallbacks, off-topic ones, mean latency; late rows are taken for a while."""
    return log.withWatermark("at", late).groupBy(F.window("at", length)).agg(F.count(F.lit(1)).alias("n"), F.count_if("fallback").alias("n_fallback"), F.count_if("off_topic").alias("n_off_topic"), F.avg("latency_ms").alias("latency_ms"))


def windowed_percentiles(log: DataFrame, value: str, shares: dict[str, float], length: str = "5 minutes", late: str = "10 minutes", size: int = 1600) -> DataFrame:
    """Per window of event time: n, and for each name the value below which a share of the window's values lies, from a mergeable
    quantile sketch of `size` entries a level, which is the window's state whatever the number of rows. Rank errors are about
    2.3 / size; a window with fewer values than that is exact. Nulls are left out."""
    sketched = log.withWatermark("at", late).groupBy(F.window("at", length)).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("_s"))
    return sketched.where("n > 0").select("window", "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(share)).alias(name) for name, share in shares.items()])
