"""The jobs over growing and repeated input, on copies in folders of the test."""

import json

import duckdb
import pytest

from jobs import lexical_index, manual_sections, queries
from lectern.operators import ingest as I
from lectern.operators import lexical_index as LI
from lectern.operators import retrieval as R

from test_oracle import SF, TABLES, rows

DOCS = "doc_id long, text string, source string"
SETTINGS = {"source": "", "out": "", "checkpoint": ""}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def same_lists(spark, index, docs, asked, **k):
    want = R.bm25(docs.select(docs.doc_id.alias("chunk_id"), "text"), asked, **k).toPandas()
    got = LI.search(spark, index, asked, **k).toPandas()
    assert len(want) and rows(got) == rows(want)


def test_index_grows(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("docs", "index", "mark"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as query_id", "text")
    docs.where("doc_id % 3 = 0").repartition(3).write.parquet(source)
    first = lexical_index.run(spark, source, out, mark, files_at_once=2)
    assert first["batches"] == 2 and first["chunks"] == docs.where("doc_id % 3 = 0").count()
    same_lists(spark, out, docs.where("doc_id % 3 = 0"), asked)
    docs.where("doc_id % 3 > 0").write.mode("append").parquet(source)
    second = lexical_index.run(spark, source, out, mark)
    assert second["chunks"] == docs.where("doc_id % 3 > 0").count() and second["replaced"] == 0
    same_lists(spark, out, docs, asked)
    before = rows(LI.postings(spark, out).toPandas())
    assert lexical_index.run(spark, source, out, mark) == {"batches": 0, "chunks": 0, "words": 0, "replaced": 0}
    assert rows(LI.postings(spark, out).toPandas()) == before

    changed = spark.createDataFrame([(3, "quite another text", "s"), (6, None, "s"), (10**9, "a new one with another word", None)], DOCS)
    changed.coalesce(1).write.mode("append").parquet(source)
    third = lexical_index.run(spark, source, out, mark)
    assert third["chunks"] == 3 and third["replaced"] == 2
    now = docs.where("doc_id not in (3, 6)").unionByName(changed)
    same_lists(spark, out, now, asked)
    same_lists(spark, out, now, spark.createDataFrame([(1, "another word"), (2, "the the text"), (3, None), (4, "nowhere_at_all")], "query_id long, text string"), k=3)


def test_batch_written_again(spark, tmp_path):
    """A batch that failed half-way is written once more, over what it left."""
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(k, f"word{k % 7} common text {k}") for k in range(900)] + [(None, "nobody's")], "chunk_id long, text string")
    LI.add(docs.where("chunk_id < 500"), path, 0)
    LI.add(docs.where("chunk_id >= 400").limit(50), path, 1)
    LI.add(docs.where("chunk_id >= 400"), path, 1)
    again = LI.add(docs.where("chunk_id >= 400"), path, 1)
    assert again == {"chunks": 500, "words": 1600, "replaced": 100}
    assert sorted(r.chunk_id for r in LI.postings(spark, path).where("term = 'common'").collect()) == list(range(900))
    assert LI.stored(spark, path, "terms", "bigint").where("term = 'common'").groupBy().sum("df").first()[0] == 900


def test_blocks_are_left_out(spark, tmp_path, monkeypatch):
    """Most blocks can't reach a threshold that a few chunks set, and lists are the same whatever the first blocks are."""
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(k, "rare rare term" if k < 20 else "filler " * (k % 60 + 4) + ("term " if k % 2 else "other ")) for k in range(6000)], "chunk_id long, text string").repartition(4)
    LI.add(docs, path, 0)
    asked = spark.createDataFrame([(1, "rare term"), (2, "filler other"), (3, "term other")], "query_id long, text string")
    want = rows(R.bm25(docs, asked).toPandas())
    for n in (1, 4, 10_000):
        assert rows(LI.search(spark, path, asked, first_blocks=n).toPandas()) == want
    seen = []
    plain = LI.stored
    monkeypatch.setattr(LI, "stored", lambda *a, **k: seen.append(a[2]) or plain(*a, **k))
    LI.search(spark, path, asked)
    assert set(seen) <= {"totals", "terms", "postings"}


def test_blocks_from_parted_batches():
    """A block's entries are one row, however batches cut them; equal terms of other blocks are another."""
    import pyarrow as pa

    given = sorted((f"t{k % 5}", k % 3, k, 1 + k % 4, 9 - k % 7) for k in range(200))
    for size in (1, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*((t, b, 0, i, f, d) for t, b, i, f, d in given[a : a + size]), strict=True)], names=["term", "block", "bucket", "chunk_id", "tf", "dl"]) for a in range(0, 200, size)]
        got = [r for b in LI.block_rows(iter(batches)) for r in b.to_pylist()]
        assert [(r["term"], r["block"]) for r in got] == sorted({g[:2] for g in given})
        for r in got:
            own = [g[2:] for g in given if g[:2] == (r["term"], r["block"])]
            assert [tuple(e.values()) for e in r["entries"]] == own and (r["n"], r["max_tf"], r["min_dl"]) == (len(own), max(o[1] for o in own), min(o[2] for o in own))


def test_many_replaced_chunks(spark, tmp_path, monkeypatch):
    """Beyond the number of replaced chunks that is broadcast lists are the same, and scores of pairs never go over the network."""
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(k, f"common word{k % 7} " * (k % 5 + 1)) for k in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common word3"), (2, "former word5")], "query_id long, text string")
    LI.add(docs.selectExpr("doc_id as chunk_id", "'former ' || text as text"), path, 0)
    for most in (0, 1 << 20):
        monkeypatch.setattr(LI, "MOST_BROADCAST_REPLACED", most)
        LI.add(docs.selectExpr("doc_id as chunk_id", "text").where("doc_id % 2 = 0"), path, 1)
        now = docs.selectExpr("doc_id", "case when doc_id % 2 = 0 then text else 'former ' || text end as text")
        same_lists(spark, path, now, asked)
        plan = LI.search(spark, path, asked)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [query_id" not in plan.split("MapInArrow")[0]


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    asked = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert LI.search(spark, path, asked).count() == 0
    LI.add(spark.createDataFrame([], "chunk_id long, text string"), path, 0)
    assert LI.search(spark, path, asked).count() == 0 and LI.postings(spark, path).count() == 0
    LI.add(spark.createDataFrame([("a", "word"), ("b", "")], "chunk_id string, text string"), f"{path}-text", 0)
    assert [(r.chunk_id, r.rank) for r in LI.search(spark, f"{path}-text", asked, id_type="string").collect()] == [("a", 1)]


def test_sections_rerun_and_other_versions(spark, tmp_path):
    source, out = str(tmp_path / "pages"), str(tmp_path / "store")
    lines = "1. First steps\nTurn it on.\nFooter\n2. Paper\nOpen the lid."
    pages = [("a", k, lines if k % 2 else "Goes on here.\nFooter") for k in range(1, 9)] + [("b", 1, None), (None, 1, "Alone"), (None, 2, "Second")]
    spark.createDataFrame(pages, "doc_id string, page int, text string").repartition(3).write.parquet(source)
    one = manual_sections.run(spark, source, out, "v1")
    assert one["manuals"] == 3 and one["pages"] == 11
    first = rows(manual_sections.read_sections(spark, out).toPandas())
    assert manual_sections.run(spark, source, out, "v1") == one
    assert rows(manual_sections.read_sections(spark, out).toPandas()) == first
    got = {(r.doc_id, r.page, r.seg): (r.title, r.body, r.is_continuation) for r in manual_sections.read_sections(spark, out).collect()}
    assert got["a", 1, 0] == ("1. First steps", "Turn it on.", False) and got["a", 2, 0] == ("2. Paper", "Goes on here.", True)
    assert got["b", 1, 0] == (None, "", False) and got[None, 2, 0] == (None, "Second", False)
    spark.createDataFrame([("a", 1, "Only page")], "doc_id string, page int, text string").write.parquet(f"{source}2")
    manual_sections.run(spark, f"{source}2", out, "v2")
    after = manual_sections.read_sections(spark, out)
    assert rows(after.where("version = 'v1'").toPandas()) == first and after.where("version = 'v2'").count() == 1


def test_configurations_name_the_parameters():
    import inspect
    from pathlib import Path

    for job in (lexical_index, manual_sections):
        settings = json.loads(Path(job.__file__).with_suffix(".json").read_text())
        inspect.signature(job.run).bind(None, **settings)


@pytest.mark.parametrize("tasks", [1, 7])
def test_last_known_over_tasks(spark, tasks):
    rows_ = [("hot" if k < 700 else f"d{k % 3}" if k % 5 else None, k, f"t{k}" if k % 97 == 0 else None) for k in range(1000)]
    df = spark.createDataFrame(rows_, "d string, k int, v string").repartition(tasks)
    for own in (True, False):
        want, last = {}, {}
        for d, k, v in rows_:
            was = last.get(d)
            last[d] = v or was
            want[k] = last[d] if own else was
        assert {r.k: r.x for r in I.last_known(df, "d", ["k"], "v", "x", own).collect()} == want
