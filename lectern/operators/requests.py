"""A request from its query to its answer: generation by a model that is passed in, routes, and the times of its phases."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import SETTINGS
from . import answers as A
from . import retrieval as R


def last_partial(stream: Iterable, invoke: Callable[[], object], clock: Callable[[], float] = time.perf_counter) -> tuple[object, float | None]:
    """A model's last partial result and the clock's time at the first one; if the stream fails or is empty, what a blocking call
    gives, and no time."""
    first = result = None
    try:
        for result in stream:
            first = clock() if first is None else first
        if result is None:
            raise RuntimeError("empty stream")
    except Exception:  # any failure of the stream is one of streaming, not of the model
        return invoke(), None
    return result, first


def generate(prompts: DataFrame, stream: Callable[[str, str], Iterable[str]], invoke: Callable[[str, str], str]) -> DataFrame:
    """query_id, result, first_ms for prompts (query_id, text, context): a structured answer as JSON from a model given as two
    functions of query and context; first_ms is null where streaming failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                began = time.perf_counter()
                result, first = last_partial(_started(stream, r.text, r.context), lambda r=r: invoke(r.text, r.context))
                rows.append((r.query_id, result, None if first is None else int((first - began) * 1000)))
            yield pd.DataFrame(rows, columns=["query_id", "result", "first_ms"]).astype({"first_ms": "Int64"})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "text", "context").mapInPandas(run, f"query_id {kind}, result string, first_ms long")


def _started(stream: Callable[[str, str], Iterable[str]], text: str, context: str) -> Iterator[str]:
    yield from stream(text, context)


def phases(marks: DataFrame) -> DataFrame:
    """request_id, retrieval_ms, time_to_first_token_ms, latency_ms of marks (request_id, label: start, retrieved, first_token or
    done; at: seconds): whole milliseconds from a request's start, null where it has no such mark (latency then ends with
    retrieval)."""
    at = lambda label: F.min(F.when(F.col("label") == label, F.col("at")))
    out = marks.groupBy("request_id").agg(at("start").alias("s"), at("retrieved").alias("r"), at("first_token").alias("f"), at("done").alias("d"))
    ms = lambda c: F.floor((c - F.col("s")) * 1000).cast("long")
    return out.select("request_id", ms(F.col("r")).alias("retrieval_ms"), ms(F.col("f")).alias("time_to_first_token_ms"), ms(F.coalesce("d", "r")).alias("latency_ms"))


def answer(queries: DataFrame, dense: DataFrame, lexical: DataFrame, chunks: DataFrame, steps: DataFrame, logits: DataFrame | None = None, k: int = SETTINGS.top_k_final, gate: DataFrame | None = None) -> DataFrame:
    """The whole of it for queries (query_id) with their ranked lists (dense: query_id, chunk_id, similarity, rank; lexical: query_id,
    chunk_id, rank), chunks (chunk_id, text, section_title, ocr_used, model, doc_id, version) and answers that came from a model
    (steps: query_id, number, text, chunk_id): gate, fusion, re-ranking by logits (query_id, chunk_id, logit), ambiguity of models,
    grounding and citations.

    The gate looks at dense, or at another list of its form.

    query_id, route (off_topic, ambiguous, fallback or answer), relevance, retrieved (chunk_ids in order), candidate_models, n_steps,
    citations (chunk_ids in order of mention). A query that is off topic retrieves nothing; only `answer` has steps and citations."""
    gated = R.gate(queries, dense if gate is None else gate)
    fused = R.top_fused(R.fuse(dense, lexical), k).join(gated.where(~F.col("off_topic")).select("query_id"), "query_id", "left_semi")
    top = fused.join(chunks, "chunk_id")
    close = R.ambiguity(top.select("query_id", "model", "score"))
    ranked = top if logits is None else R.rerank(top.join(logits, ["query_id", "chunk_id"]), F.col("logit"))
    shown = ranked.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    said = steps.withColumnRenamed("query_id", "answer_id")
    kept, _, counts = A.ground(said, said.limit(0), ranked.select(F.col("query_id").alias("answer_id"), "chunk_id"))
    cited = A.citations(kept, chunks).groupBy("answer_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("cited"))
    counts = counts.select(F.col("answer_id").alias("query_id"), "n_kept", "fallback")
    # A query whose model said nothing falls back, too.
    ways = R.route(gated, close, queries.select("query_id").join(counts, "query_id", "left").withColumn("fallback", F.coalesce("fallback", F.lit(True))))
    out = ways.join(gated.select("query_id", "relevance"), "query_id")
    for part in (shown, close.select("query_id", "candidate_models"), counts.select("query_id", "n_kept"), cited.withColumnRenamed("answer_id", "query_id")):
        out = out.join(part, "query_id", "left")
    on = F.col("route") == "answer"
    ids = chunks.schema["chunk_id"].dataType.simpleString()
    none = F.array().cast(f"array<{ids}>")
    return out.select(
        "query_id", "route", "relevance", F.coalesce("retrieved", none).alias("retrieved"), F.when(F.col("route") == "ambiguous", F.col("candidate_models")).otherwise(F.array().cast("array<string>")).alias("candidate_models"),
        F.when(on, F.col("n_kept")).otherwise(F.lit(0)).cast("long").alias("n_steps"), F.when(on, F.coalesce("cited", none)).otherwise(none).alias("citations"),
    )
