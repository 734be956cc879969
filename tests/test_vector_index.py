"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval as R
from lectern.operators import vector_index as V

LARGE = "/root/testdata/sf0.1"


def vectors(spark, table=LARGE):
    e = spark.read.parquet(f"{table}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.lit("v1").alias("version"), "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    v, q = vectors(spark)
    V.fit(v, path)
    V.add(v, path, 0)
    return path, v, q


def lists(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "similarity", "rank").collect())


def test_recall_of_all_queries(spark, stored):
    path, v, q = stored
    true = R.knn(v.select("chunk_id", "embedding"), q)
    n, hits = V.recall(V.search(spark, path, q), true).agg(F.sum("n"), F.sum("hits")).first()
    assert n == 8 * q.count() and hits >= 0.9 * n
    # All cells and all vectors: exact search.
    assert lists(V.search(spark, path, q, probes=10_000, wider=10_000)) == lists(true)


def test_every_vector_is_indexed_once_and_cells_are_pruned(spark, stored):
    path, v, q = stored
    rows = spark.read.parquet(f"{path}/vectors")
    assert sorted(r.chunk_id for r in rows.select("chunk_id").collect()) == sorted(r.chunk_id for r in v.select("chunk_id").collect())
    one = V.search(spark, path, q.limit(1), probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "") or "cell" in plan.split("PartitionFilters:")[1].split("]")[0]
    model = V.load(spark, path)
    near = np.argsort(((model.centroids - V.unit(np.array([q.first().embedding], np.float32))) ** 2).sum(axis=1))[:2]
    cells = {r.cell for r in rows.join(one.select("chunk_id"), "chunk_id").select("cell").collect()}
    assert cells <= set(near.tolist())


def test_replaced_by_document_and_version(spark, tmp_path):
    path, rng = str(tmp_path), np.random.default_rng(2)
    make = lambda ids, doc, version: [(int(i), doc, version, rng.normal(size=10).astype(float).tolist()) for i in ids]
    schema = "chunk_id long, doc_id string, version string, embedding array<double>"
    first = spark.createDataFrame(make(range(300), "a", "v1") + make(range(300, 500), "b", "v1") + [(900, "b", "v1", None), (901, "b", "v1", [0.0] * 10)], schema)
    second = spark.createDataFrame(make(range(600, 700), "a", "v1") + make(range(700, 800), "a", "v2") + make([998], None, None), schema)
    V.fit(first, path, cells=9)
    V.add(first, path, 0)
    V.add(second.limit(5), path, 1)  # failed half-way
    V.add(second, path, 1)
    asked = spark.createDataFrame([(k, rng.normal(size=10).tolist()) for k in range(7)] + [(8, None)], "query_id long, embedding array<double>")
    want = lists(R.knn(first.where("doc_id = 'b'").unionByName(second).select("chunk_id", "embedding"), asked, 5))
    got = lists(V.search(spark, path, asked, 5, probes=9, wider=1000))
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)  # components are kept as floats
    with pytest.raises(ValueError):
        V.add(spark.createDataFrame([(1, "c", "v", [1.0, 2.0])], schema), path, 2)


def test_nothing_and_few(spark, tmp_path):
    v = spark.createDataFrame([], "chunk_id long, doc_id string, version string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.5])], "query_id long, embedding array<float>")
    assert V.fit(v, str(tmp_path / "a")) is None and V.search(spark, str(tmp_path / "a"), q).count() == 0
    few = spark.createDataFrame([("x", "d", "v", [1.0, 0.0, 0.5]), ("y", "d", "v", [0.0, 1.0, 0.0])], "chunk_id string, doc_id string, version string, embedding array<float>")
    V.fit(few, str(tmp_path / "b"))
    V.add(few, str(tmp_path / "b"), 0)
    assert [(r.chunk_id, r.similarity) for r in V.search(spark, str(tmp_path / "b"), q, id_type="string").orderBy("rank").collect()] == [("x", 1.0), ("y", 0.0)]
