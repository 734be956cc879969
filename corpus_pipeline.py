"""A corpus pipeline of five stages, each one of the operators in lectern/llm: (spark, docs, sf_dir) -> DataFrame.

Each stage gets what the one before it kept, written as Parquet and read again. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, decontaminate, lang_id, mixing, ngram_join, token_store
from lectern.llm.queries import table, vocabulary

#: Below this share of probability no language is told apart from the others: a little over even odds among four.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter or whose best language is no better than a guess; the label in lang stays as it is."""
    columns, (pred, score) = docs.columns, common.fresh("pred", "score")
    out = lang_id.predict(docs, lang_id.fit(docs), passing=tuple(columns), pred_col=pred, score_col=score)
    return out.where((F.col(pred) != lang_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.75 or more)."""
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights; one may be taken in two epochs."""
    return mixing.take(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store is written; what its files hold is returned, a row per document."""
    return token_store.read_store(spark, token_store.write_store(docs, vocabulary())).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix_sources),
    ("token_store", store_tokens),
]

#: A trained network's decisions can't be said in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = common.new_path(spark, STAGES[-1][0])
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
