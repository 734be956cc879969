"""A stored index of vectors: inverted lists of cells, with product-quantised codes, exact similarities for what they select.

A model (cells' centroids and code books) is fitted by k-means on a bounded sample; then every vector is put into the cell that is
nearest and written, under batch and cell, with a code of one byte for each few components of its difference from the centroid. A
query looks at the codes of the cells next to it, and takes the exact similarity of the vectors whose codes are nearest. Only the
files of those cells are opened, and of most rows only the code is read.

Vectors belong to a document and version (doc_id, version); a batch that has some replaces all vectors that earlier batches have of them.
Batches are written whole or again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS
from .retrieval import MOST_QUERIES_AT_ONCE, dimension, dot

#: Rows that a model is fitted on, about; cells and code words are no more than these allow.
SAMPLE = 65_536
MOST_CELLS = 4096
WORDS = 256
#: Components to a byte of code.
PART = 4
#: Cells that a query looks into, of each SHARE cells one, and at least LEAST_PROBES; vectors whose similarity is then taken, for each of k.
SHARE, LEAST_PROBES, WIDER = 2, 32, 24
AT_ONCE = 256


@dataclass(frozen=True)
class Model:
    """centroids (cells x components) and books (parts x words x components of a part), of unit vectors."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows as parts, the last one filled up with zeros: parts x rows x components of a part."""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width).transpose(1, 0, 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector, and its code."""
        cell = nearest(x, self.centroids)
        return cell, np.stack([nearest(p, b) for p, b in zip(self.split(x - self.centroids[cell]), self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of unit vectors' parts from all code words of a cell: rows x parts x words."""
        return ((self.split(q - self.centroids[cell])[:, :, None, :] - self.books[:, None]) ** 2).sum(axis=3).transpose(1, 0, 2)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - x[a : a + 8192] @ centres.T).argmin(axis=1) for a in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """Centres of at most k groups of rows; a group that runs empty takes the row that is farthest from its centre."""
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(steps):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        if (n == 0).any():
            far = np.argsort(-((x - centres[at]) ** 2).sum(axis=1))[: (n == 0).sum()]
            centres[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding has a direction."""
    return vectors.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))


def fit(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 5) -> Model | None:
    """Fit a model on about SAMPLE rows of vectors (chunk_id, embedding), chosen by hash, and write it under path/model. cells: by default
    the square root of all rows, at most MOST_CELLS. None without any vector."""
    spark, some = vectors.sparkSession, usable(vectors)
    n, dim = some.count(), dimension(some)
    if not n:
        return None
    share = 2 * SAMPLE * (1 << 20) // max(n, 2 * SAMPLE)  # twice as many are let through, as hashes vary
    sample = some.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < max(share, 1)).select("embedding").limit(2 * SAMPLE).toPandas()["embedding"]
    rng = np.random.default_rng(seed)
    x = unit(np.array(sorted(map(tuple, sample)), np.float32).reshape(-1, dim))
    x = x[rng.permutation(len(x))[:SAMPLE]]
    centroids = k_means(x, max(1, min(cells or round(n**0.5), MOST_CELLS, len(x))), rng)
    parts = -(-dim // PART)
    model = Model(centroids, np.zeros((parts, 1, PART), np.float32))
    rest = model.split(x - centroids[nearest(x, centroids)])
    model = Model(centroids, np.stack([np.resize(c := k_means(p, WORDS, rng, 8), (min(WORDS, len(x)), c.shape[1])) for p in rest]))
    rows = [("centroid", k, c.tolist()) for k, c in enumerate(model.centroids)] + [("book", k, b.ravel().tolist()) for k, b in enumerate(model.books)]
    spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return model


MODEL = "kind string, k int, x array<float>"
VECTORS = "chunk_id {id}, doc_id string, version string, code binary, embedding array<float>, batch long, cell int"


def load(spark: SparkSession, path: str) -> Model:
    rows = sorted((r.kind, r.k, r.x) for r in spark.read.schema(MODEL).parquet(f"{path}/model").collect())  # MOST_CELLS rows at most, and the books
    book, centroid = ([x for kind, _, x in rows if kind == name] for name in ("book", "centroid"))
    return Model(np.array(centroid, np.float32), np.array(book, np.float32).reshape(len(book), -1, PART))


def add(vectors: DataFrame, path: str, batch: int) -> None:
    """Write vectors (chunk_id, doc_id, version, embedding) as a batch; all of them go into the index. Null embeddings and such of zeros
    only are left out, those of another length are an error."""
    spark = vectors.sparkSession
    model, src = load(spark, path), usable(vectors).select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("string").alias("version"), F.col("embedding").cast("array<float>").alias("embedding"))
    if (dim := dimension(src)) not in (0, model.dim):
        raise ValueError(f"embeddings of {dim} components in an index of {model.dim}")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("embedding").flatten().to_numpy().reshape(b.num_rows, -1)
            cell, code = sent.value.encode(unit(x))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c.tobytes() for c in code], pa.binary()), b.column("embedding"), pa.array(cell.astype(np.int32))], names=["chunk_id", "doc_id", "version", "code", "embedding", "cell"])

    kind = src.schema["chunk_id"].dataType.simpleString()
    coded = src.mapInArrow(run, f"chunk_id {kind}, doc_id string, version string, code binary, embedding array<float>, cell int")
    # A cell gets few files; one that holds very many vectors is split.
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors/batch={batch}")
    vectors.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("string").alias("version")).distinct().write.mode("overwrite").parquet(f"{path}/versions/batch={batch}")


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, version, batch: what later batches replaced."""
    held = spark.read.schema("doc_id string, version string, batch long").parquet(f"{path}/versions")
    return held.withColumn("last", F.max("batch").over(Window.partitionBy("doc_id", "version"))).where("batch < last").drop("last")


def live(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """The rows that count."""
    rows = spark.read.schema(VECTORS.format(id=id_type)).parquet(f"{path}/vectors")
    gone = superseded(spark, path)
    if gone.isEmpty():
        return rows
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.col("batch").alias("_b"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["_d"]) & rows["version"].eqNullSafe(gone["_v"]) & (rows["batch"] == gone["_b"]), "left_anti")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = SETTINGS.top_k_dense, probes: int | None = None, wider: int = WIDER, id_type: str = "bigint") -> DataFrame:
    """The k chunks most similar to each query (query_id, embedding) by cosine, as in retrieval.knn, from the cells that are near:
    query_id, chunk_id, similarity (6 digits; exact), rank from 1; ties by chunk_id.

    probes: how many cells; by default half of them, and LEAST_PROBES at least. wider: for each of k, how many vectors are compared exactly. More of either
    finds more of the true lists; with all cells and all vectors they are the true lists. Queries are a stated set, sent to the tasks in
    blocks of MOST_QUERIES_AT_ONCE."""
    try:
        model = load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {id_type}, similarity double, rank int")
    cells = len(model.centroids)
    probes, most = min(cells, probes or max(LEAST_PROBES, -(-cells // SHARE))), k * wider
    asked = usable(queries).select("query_id", F.col("embedding").cast("array<float>").alias("q"))
    if (dim := dimension(asked.withColumnRenamed("q", "embedding"))) not in (0, model.dim):
        raise ValueError(f"queries of {dim} components in an index of {model.dim}")
    blocks = max(1, -(-asked.count() // MOST_QUERIES_AT_ONCE))
    rows, id_of = live(spark, path, id_type), queries.schema["query_id"].dataType.simpleString()
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        table = own.toArrow()  # a block of the stated set
        x = unit(table.column("q").combine_chunks().flatten().to_numpy().reshape(-1, model.dim))
        near = np.argsort(((model.centroids**2).sum(axis=1) - 2 * x @ model.centroids.T), axis=1, kind="stable")[:, :probes]
        of_cell: dict[int, np.ndarray] = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((model, x, of_cell, table.column("query_id").combine_chunks()))

        def select(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, x, of_cell, ids = sent.value
            for b in batches:
                at = b.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, len(model.books))
                for c in np.unique(at).tolist():
                    rows = np.flatnonzero(at == c)
                    for a in range(0, len(of_cell.get(c, ())), AT_ONCE):
                        asking = of_cell[c][a : a + AT_ONCE]
                        far, table = np.zeros((len(asking), len(rows)), np.float32), model.tables(x[asking], c)
                        for p in range(len(model.books)):
                            far += table[:, p, codes[rows, p]]
                        best = np.argpartition(far, min(most, len(rows)) - 1, axis=1)[:, :most]
                        q, r = np.repeat(np.arange(len(asking)), best.shape[1]), best.ravel()
                        take = pa.array(rows[r])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(asking[q])), b.column("chunk_id").take(take), b.column("batch").take(take), b.column("cell").take(take), pa.array(far[q, r].astype(np.float64))], names=["query_id", "chunk_id", "batch", "cell", "far"])

        probed = rows.where(F.col("cell").isin(sorted(of_cell)))
        selected = probed.select("chunk_id", "batch", "cell", "code").mapInArrow(select, f"query_id {id_of}, chunk_id {id_type}, batch long, cell int, far double")
        nearest_codes = Window.partitionBy("query_id").orderBy("far", "chunk_id")
        selected = selected.withColumn("nth", F.row_number().over(nearest_codes)).where(F.col("nth") <= most).select("query_id", "chunk_id", "batch", "cell")
        # No more than k * wider rows for each query of a block.
        both = probed.select("chunk_id", "batch", "cell", F.col("embedding").alias("c")).join(F.broadcast(selected), ["chunk_id", "batch", "cell"]).join(F.broadcast(own), "query_id")
        scored = both.select("query_id", "chunk_id", F.round(dot("c", "q") / (length("c") * length("q")), 6).alias("similarity"))
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """query_id, n, hits: of the true list (query_id, chunk_id, similarity) how many rows the found one has; a chunk as similar as the
    true list's last one counts as well, as ties may end a list anywhere."""
    last = true.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("last"))
    got = found.join(last, "query_id").where(F.col("similarity") >= F.col("last")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return last.join(got, "query_id", "left").select("query_id", "n", F.least("n", F.coalesce("hits", F.lit(0))).alias("hits"))
