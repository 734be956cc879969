"""Keeps the lexical index of a growing folder of documents: python -m jobs.lexical_index CONFIG

Each run takes the files that came since the last one, as a file stream that ends when there are no more, and adds their documents to
the stored index (lectern.operators.lexical_index), which answers BM25 queries without reading texts. The stream's checkpoint says
what has been taken. A batch that failed half-way is written again under its number, over what it left, so reruns end in the same
index. A document that comes again in a later file replaces the earlier one.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import run_from_command_line
from lectern.operators import lexical_index as LI

LOG = logging.getLogger("jobs.lexical_index")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text", files_at_once: int = 1000, buckets: int = 16) -> dict[str, int]:
    """source: a folder or pattern of Parquet files of documents; out: the index; checkpoint: what was taken. files_at_once: files to a batch. Gives the numbers
    of batches, chunks, words and replaced chunks of this run, and logs them by batch."""
    did = {"batches": 0, "chunks": 0, "words": 0, "replaced": 0}

    def take(docs: DataFrame, batch: int) -> None:
        # A file may tell a document twice; of its texts the greatest counts, so that reruns choose alike.
        said = LI.add(docs.groupBy("chunk_id").agg(F.max("text").alias("text")), out, batch, buckets)
        LOG.info("batch %d: read %d chunks from %s; wrote %d words under %s, replaced %d chunks", batch, said["chunks"], source, said["words"], out, said["replaced"])
        for k, v in said.items():
            did[k] += v
        did["batches"] += 1

    schema = spark.read.parquet(source).schema
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source).select(F.col(id_column).alias("chunk_id"), F.col(text_column).alias("text"))
    stream = docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    LOG.info("took %(batches)d batches: %(chunks)d chunks, %(words)d words, %(replaced)d replaced", did)
    return did


if __name__ == "__main__":
    run_from_command_line(run, "lexical_index", __doc__.splitlines()[0])
