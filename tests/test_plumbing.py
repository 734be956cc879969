"""Generation, caches, crops, logs, times and the command line, against small worked examples."""

import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern import __main__ as cli
from lectern.functions import text as T
from lectern.operators import ingest as I
from lectern.operators import requests as RQ
from lectern.operators import retrieval as R
from lectern.sources import cache, crops


def test_last_partial():
    ticks = iter(range(10, 99))
    clock = lambda: next(ticks)
    assert RQ.last_partial(["a", "ab", "abc"], lambda: "no", clock) == ("abc", 10)
    assert RQ.last_partial([], lambda: "whole", clock) == ("whole", None)

    def broken():
        yield "a"
        raise OSError

    assert RQ.last_partial(broken(), lambda: "whole", clock) == ("whole", None)
    with pytest.raises(ValueError):
        RQ.last_partial([], lambda: int("x"))


def test_generate(spark):
    prompts = spark.createDataFrame([(k, f"q{k}", "context") for k in range(6)], "query_id long, text string, context string")

    def stream(query, context):
        if query == "q5":
            raise OSError
        for n in range(1, int(query[1]) + 1):
            yield json.dumps({"steps": list(range(n)), "of": context})

    got = {r.query_id: r for r in RQ.generate(prompts, stream, lambda q, c: "called").collect()}
    assert [got[k].result for k in (0, 5)] == ["called", "called"] and got[0].first_ms is None and got[5].first_ms is None
    assert json.loads(got[3].result) == {"steps": [0, 1, 2], "of": "context"} and got[3].first_ms >= 0
    assert RQ.generate(prompts.limit(0), stream, lambda q, c: "").count() == 0


def test_routes_of_answers(spark):
    queries = spark.createDataFrame([(k,) for k in range(1, 6)], "query_id long")
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (2, 10, 0.5, 1), (3, 10, 0.9, 1), (3, 11, 0.9, 2), (4, 12, 0.95, 1)], "query_id long, chunk_id long, similarity double, rank int")
    lexical = spark.createDataFrame([(1, 12, 1), (2, 12, 1), (4, 10, 1)], "query_id long, chunk_id long, rank int")
    chunks = spark.createDataFrame([(10, "a", "", False, "M", "d", "v1"), (11, "b", "", False, "N", "d", "v1"), (12, "c", "", True, "M", "d", "v1")], "chunk_id long, text string, section_title string, ocr_used boolean, model string, doc_id string, version string")
    steps = spark.createDataFrame([(1, 1, "s", 12), (1, 2, "s", 10), (1, 3, "s", 11), (2, 1, "s", 10), (3, 1, "s", 10), (4, 1, "s", 99)], "query_id long, number int, text string, chunk_id long")
    got = {r.query_id: r for r in RQ.answer(queries, dense, lexical, chunks, steps).collect()}
    assert {k: r.route for k, r in got.items()} == {1: "answer", 2: "off_topic", 3: "ambiguous", 4: "fallback", 5: "off_topic"}
    assert got[1].n_steps == 2 and got[1].citations == [12, 10] and got[1].retrieved == [10, 12]
    assert got[3].candidate_models == ["M", "N"] and got[3].citations == [] and got[2].retrieved == [] and got[5].relevance == 0
    logits = spark.createDataFrame([(1, 10, -1.0), (1, 12, 1.0)], "query_id long, chunk_id long, logit double")
    assert RQ.answer(queries, dense, lexical, chunks, steps, logits).where("query_id = 1").first().retrieved == [12, 10]


def test_phases(spark):
    marks = spark.createDataFrame([("a", "start", 1.0), ("a", "retrieved", 1.25), ("a", "first_token", 2.0), ("a", "done", 3.5), ("b", "start", 1.0), ("b", "retrieved", 1.125)], "request_id string, label string, at double")
    assert {tuple(r) for r in RQ.phases(marks).collect()} == {("a", 250, 1000, 2500), ("b", 125, None, 125)}


@pytest.mark.parametrize("dim", [3, 32, 64, 128, 600])
def test_nearest_over_all_components(spark, dim):
    one = [[float(k == j) for k in range(dim)] for j in (0, dim - 1)]
    chunks = spark.createDataFrame([(1, one[0]), (2, one[1]), (3, None)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, one[1]), (8, None)], "query_id long, embedding array<double>")
    assert [tuple(r) for r in R.knn(chunks, queries, 2).orderBy("rank").collect()] == [(7, 2, 1.0, 1), (7, 1, 0.0, 2)]
    assert R.knn(chunks.limit(0), queries).count() == 0
    with pytest.raises(ValueError):
        R.knn(chunks, spark.createDataFrame([(7, [1.0])], queries.schema))


def test_nearest_by_slices_of_a_batch(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, [float(k % 13), float(k % 7 + 1)]) for k in range(100)], "chunk_id long, embedding array<double>").coalesce(1)
    queries = chunks.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    want = sorted(R.knn(chunks, queries, 5).collect())
    monkeypatch.setattr(R, "VECTORS_AT_ONCE", 3)
    assert len(want) == 50 and sorted(R.knn(chunks, queries, 5).collect()) == want


def test_postings(spark):
    d = spark.createDataFrame([(1, "b a b, B"), (2, ""), (3, None), (4, "x")], "chunk_id long, text string")
    assert {tuple(r) for r in R.postings(d).select("chunk_id", "dl", "term", "tf").collect()} == {(1, 4, "b", 3), (1, 4, "a", 1), (4, 1, "x", 1)}
    few = R.bm25(d, spark.createDataFrame([(1, "a x")], "query_id long, text string")).collect()
    R.MOST_BROADCAST_TERMS, kept = 0, R.MOST_BROADCAST_TERMS
    try:
        assert sorted(R.bm25(d, spark.createDataFrame([(1, "a x")], "query_id long, text string")).collect()) == sorted(few) and len(few) == 2
    finally:
        R.MOST_BROADCAST_TERMS = kept


def test_bm25_scores_where_chunks_are(spark, monkeypatch):
    """However chunks are dealt to tasks and slices of them, lists are those of a plain computation; ties go by chunk_id; text is not shuffled."""
    said = [(k, " ".join(f"w{k * j % 11}" for j in range(k % 9)) if k % 10 else "w1 w2 w3") for k in range(400)]
    asked = {1: "w1 w2 w2", 2: "w5 never", 3: "w3", 4: None, 5: "never"}
    d, q = spark.createDataFrame(said, "chunk_id long, text string"), spark.createDataFrame(list(asked.items()), "query_id long, text string")
    texts = {k: t.split() for k, t in said}
    average, df = sum(map(len, texts.values())) / len(texts), Counter(w for t in texts.values() for w in set(t))
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    weight = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = []
    for i, ask in asked.items():
        ws = [w for w in (ask or "").split() if w in df]
        scores = [(-round(sum(weight[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in ws), 6), k) for k, t in texts.items() if set(ws) & set(t)]
        want += [(i, k, -s, r) for r, (s, k) in enumerate(sorted(scores)[:8], 1)]
    for tasks, at_once in ((1, 1 << 21), (7, 1 << 21), (3, 40)):
        monkeypatch.setattr(R, "MOST_SCORES_AT_ONCE", at_once)
        got = R.bm25(d.repartition(tasks), q)
        assert sorted((r.query_id, r.chunk_id, round(r.score, 6), r.rank) for r in got.collect()) == sorted(want)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # lists are read, not made again for each use
    assert "Exchange" not in R.postings(d)._jdf.queryExecution().executedPlan().toString()


def test_best_of_many_equal_scores():
    """Of equal scores as many are held as a list has places, however many there are."""
    best = R.Best(1, 3, pa.int64())
    for a in range(0, 1000, 100):
        best.add(np.full((1, 100), 2.0), pa.array(range(999 - a, 899 - a, -1)))
    assert sorted(best.ids.to_pylist()) == [0, 1, 2]


def test_numbering(spark):
    rows = [(f"s{k % 7 % 3}" if k % 5 else None, k * 37 % 101) for k in range(101)]
    got = I.numbered(spark.createDataFrame(rows, "source string, doc_id long").repartition(5), "source", "doc_id", "page").collect()
    for s in {r[0] for r in rows}:
        mine = sorted((r.doc_id, r.page) for r in got if r.source == s)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1)) and len(mine) == sum(r[0] == s for r in rows)
    assert I.numbered(spark.createDataFrame([], "source string, doc_id long"), "source", "doc_id", "page").count() == 0


def test_corpus_cache(spark, tmp_path):
    path, loads = str(tmp_path / "corpus"), []

    def load():
        loads.append(1)
        return spark.read.parquet(path)

    c, held = cache.CorpusCache(), cache.Held(load)
    assert cache.fingerprint(spark, path) is None
    spark.range(5).write.parquet(path)
    assert [c.get(spark, path, load, 8).count() for _ in range(3)] == [5, 5, 5] and len(loads) == 1
    assert held.get().count() == 5
    spark.range(7).write.mode("overwrite").parquet(path)
    assert c.get(spark, path, load, 8).count() == 7 and len(loads) == 3
    c.get(spark, path, load, 9)
    assert len(loads) == 4
    assert held.get() is held.get() and held.renew().count() == 7


def test_crops(spark, tmp_path):
    figures = spark.createDataFrame([("m", 1, "a"), ("m", 1, "b"), ("m", 2, "bad"), ("n", 1, "c")], "doc_id string, page int, image_id string")
    folder = str(tmp_path)

    def render(what):
        if "bad" in what["image_ids"]:
            raise OSError
        return f"{what['doc_id']} {what['page']} {what['image_ids']}".encode()

    def write(name, data):
        with open(f"{folder}/{name}", "xb") as f:  # fails on a picture that is there
            f.write(data)

    def exists(name):
        import os

        return os.path.exists(f"{folder}/{name}")

    for _ in range(2):
        got = {(r.doc_id, r.page): r for r in crops.crop(figures, render, write, exists).collect()}
        assert got["m", 1].images == ["a", "b"] and got["m", 2].images == [] and got["m", 2].preview is None and got["n", 1].images == ["c"]
    assert open(f"{folder}/{got['m', 1].preview}").read() == "m 1 ['a', 'b']"


def test_labels(spark):
    rows = [("m", "v1", 3, "T", 0.5, 1.5, 2.5, 3.4), ("m", None, 3, "", 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "d string, v string, p int, s string, a double, b double, c double, e double")
    got = df.select(T.provenance(F.col("d"), F.col("v"), F.col("p"), F.col("s")), T.box_label(F.col("a"), F.col("b"), F.col("c"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("m v1 · p.3 · T", "bbox (0, 2) – (2, 3) pt"), ("m · p.3", "bbox (1, 2) – (3, 4) pt")]


def test_command_line(spark, tmp_path):
    pages = [("m", k, f"{k}. SECTION NUMBER {k}\nSome text that is long enough to be a chunk of page {k}.") for k in range(1, 5)]
    spark.createDataFrame(pages, "doc_id string, page int, text string").write.parquet(str(tmp_path / "pages"))
    for _ in range(2):
        cli.main([str(tmp_path / "pages"), str(tmp_path / "store"), "--version", "v2", "--pages-only", "1", "3"])
        assert {r.page_start for r in spark.read.parquet(str(tmp_path / "store/chunks")).collect()} == {1, 3}


def test_ingest_with_figures_and_reading_order(spark, tmp_path):
    """From parsed pages to the store by the command line: lines above the first title, figures by section, records."""
    body = "Some text that is long enough to be kept as a chunk, {}."
    pages = [
        ("m", 1, f"1. FIRST PART\n{body.format('one')}\nNote at the very top.", [(10.0, "Note at the very top."), (50.0, "1. FIRST PART"), (70.0, body.format("one"))], [("i0", 0.0, 5.0, 40.0, 20.0), ("i1", 0.0, 60.0, 40.0, 90.0), ("tiny", 0.0, 60.0, 1.0, 61.0)]),
        ("m", 2, body.format("two"), [(5.0, body.format("two"))], [("i2", 0.0, 30.0, 40.0, 90.0)]),
        ("m", 3, f"2. SECOND PART\n{body.format('three')}", [(20.0, "2. SECOND PART"), (40.0, body.format("three"))], [("i3", 0.0, 10.0, 40.0, 15.0), ("i4", 0.0, 30.0, 40.0, 90.0)]),
        ("n", 1, body.format("other"), None, None), ("n", 2, body.format("another"), None, None),
    ]
    schema = "doc_id string, page int, text string, text_lines array<struct<y:double,text:string>>, images array<struct<image_id:string,x0:double,y0:double,x1:double,y1:double>>"
    spark.createDataFrame(pages, schema).repartition(3).write.parquet(str(tmp_path / "pages"))
    for _ in range(2):
        cli.main([str(tmp_path / "pages"), str(tmp_path / "store"), "--version", "v1", "--model", "X"])
    chunks = {(r.doc_id, r.page_start): (r.section_title, json.loads(r.image_ids), r.text) for r in spark.read.parquet(str(tmp_path / "store/chunks")).collect()}
    assert chunks["m", 1][:2] == ("1. FIRST PART", ["i1", "i2", "i3"]) and chunks["m", 3][:2] == ("2. SECOND PART", ["i4"])
    assert chunks["m", 2][0] == "1. FIRST PART" and chunks["n", 1] == (None, [], body.format("other"))
    text, _, _ = I.ingest(spark.createDataFrame(pages, schema), spark.createDataFrame([("m", "v1", None, None, "p")], "doc_id string, version string, model string, firmware string, source_path string"))
    ordered = I.in_reading_order(spark.createDataFrame(pages, schema).select("doc_id", "page", "text"), I.page_lines(spark.createDataFrame(pages, schema)))
    assert {(r.doc_id, r.page): r.text for r in ordered.collect()}["m", 1].startswith("Note at the very top.\n1. FIRST PART")
    images = {r.image_id: (r.page, r.version) for r in spark.read.parquet(str(tmp_path / "store/images")).collect()}
    assert images == {"i0": (1, "v1"), "i1": (1, "v1"), "i2": (2, "v1"), "i3": (3, "v1"), "i4": (3, "v1")}
    manuals = {r.doc_id: (r.n_pages, r.n_chunks, r.model, r.source_path == str(tmp_path / "pages")) for r in spark.read.parquet(str(tmp_path / "store/manuals")).collect()}
    assert manuals == {"m": (3, 3, "X", True), "n": (2, 2, "X", True)}


def test_rerank_by_a_model(spark):
    rows = [(1, c, r, "two words", t) for c, r, t in ((10, 1, "none"), (11, 2, "two of the words"), (12, 3, "two"), (13, 4, None))] + [(2, 20, 1, "broken", "a"), (2, 21, 2, "broken", "b b b"), (3, 30, 1, None, "x")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, query string, text string").repartition(3)

    def load():
        def score(queries, texts):
            if "broken" in queries:
                raise RuntimeError("no such query")
            return [float(len(set(q.split()) & set(t.split()))) for q, t in zip(queries, texts, strict=True)]

        return score

    got = {(r.query_id, r.chunk_id): (r.rank, r.score) for r in R.rerank_by(df, load, 1).collect()}
    assert [got[1, c][0] for c in (11, 12, 10, 13)] == [1, 2, 3, 4] and abs(got[1, 13][1] - 0.5) < 1e-9
    assert got[2, 20] == (1, None) and got[2, 21] == (2, None) and got[3, 30][0] == 1

    def missing():
        raise OSError("no model here")

    assert {(r.query_id, r.chunk_id): r.rank for r in R.rerank_by(df, missing).collect()} == {(r[0], r[1]): r[2] for r in rows}
