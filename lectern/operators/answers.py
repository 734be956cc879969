"""From retrieved chunks to answers: grounding, citations, figures, context and questions to offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import SETTINGS


def ground(steps: DataFrame, warnings: DataFrame, retrieved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps (answer_id, number, text, chunk_id) whose chunk was retrieved (answer_id, chunk_id), warnings that name no chunk or
    a retrieved one, and answer_id, n_steps, n_kept, fallback: an answer that had steps and keeps none falls back."""
    known = retrieved.select("answer_id", "chunk_id").distinct()
    kept = steps.join(known, ["answer_id", "chunk_id"], "left_semi")
    warned = warnings.join(known.withColumn("_in", F.lit(True)), ["answer_id", "chunk_id"], "left").where(F.col("chunk_id").isNull() | F.col("_in")).drop("_in")
    n = steps.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_steps")).join(kept.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_kept")), "answer_id", "left")
    n = n.withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return kept, warned, n.withColumn("fallback", F.col("n_kept") == 0)


def citations(steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that steps (answer_id, number, chunk_id) cite, in order of first mention: answer_id, place, chunk_id, snippet,
    section_title (null if empty), ocr_used."""
    first = steps.groupBy("answer_id", "chunk_id").agg(F.min("number").alias("_n"))
    out = first.join(chunks, "chunk_id").withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("_n", "chunk_id")))
    return out.select("answer_id", "place", "chunk_id", T.snippet(F.col("text"), 220).alias("snippet"), F.nullif("section_title", F.lit("")).alias("section_title"), F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"))


def significant_figures(figures: DataFrame, least: float = SETTINGS.significant_area) -> DataFrame:
    """Of each group's figures (group, image_id, area, pos) those of a certain area, or else the largest one; by area, largest first (place)."""
    g = Window.partitionBy("group")
    out = figures.withColumn("_some", F.max(F.col("area") >= least).over(g)).withColumn("_k", F.row_number().over(g.orderBy(F.desc("area"), "pos")))
    out = out.where(F.when(F.col("_some"), F.col("area") >= least).otherwise(F.col("_k") == 1))
    return out.withColumn("place", F.row_number().over(g.orderBy(F.desc("area"), "pos"))).drop("_some", "_k")


def figures_per_page(figures: DataFrame) -> DataFrame:
    """figures (doc_id, page, chunk_page) with the page they count for, their own or else the chunk's, and how many that page has."""
    out = figures.withColumn("page", F.coalesce("page", "chunk_page"))
    return out.withColumn("on_page", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page")))


def first_images(images: DataFrame, most: int = SETTINGS.max_images) -> DataFrame:
    """Of images (answer_id, pos, image_id) the first `most` distinct ones (0: all), by first occurrence: answer_id, place, image_id."""
    first = images.groupBy("answer_id", "image_id").agg(F.min("pos").alias("pos"))
    out = first.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos", "image_id")))
    return (out.where(F.col("place") <= most) if most else out).select("answer_id", "place", "image_id")


def distinct_groups(groups: DataFrame) -> DataFrame:
    """Groups (doc_id, image_ids, pos) by document and set of images, the first of each."""
    key = F.array_sort(F.array_distinct("image_ids"))
    return groups.withColumn("key", key).withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos"))).where("_k = 1").drop("_k")


def context_line(chunk_id: Column, doc_id: Column, version: Column, page: Column, section: Column, ocr: Column, text: Column) -> Column:
    """One chunk of a model's context."""
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("n/d"))
    note = F.when(F.coalesce(ocr, F.lit(False)), F.lit(" | ATTENZIONE: testo ricavato via OCR, possibili imprecisioni")).otherwise(F.lit(""))
    return F.concat(F.lit("[chunk_id="), chunk_id, F.lit(" | doc="), doc_id, F.lit(" | versione="), unknown(version), F.lit(" | pagina="), page, F.lit(" | sezione="), unknown(section), note, F.lit("]\n"), text, F.lit("\n"))


def render_context(retrieved: DataFrame) -> DataFrame:
    """query_id, context: the lines (query_id, rank, line) of each query in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return retrieved.groupBy("query_id").agg(F.array_join(lines, "\n---\n").alias("context"))


def sections(chunks: DataFrame) -> DataFrame:
    """title, size, pos: cleaned titles with the text they head, of chunks (section_title, text, pos)."""
    return chunks.withColumn("title", T.clean_title(F.col("section_title"))).where("title is not null").groupBy("title").agg(F.sum(F.length("text")).alias("size"), F.min("pos").alias("pos"))


def top_sections(chunks: DataFrame, k: int = 3) -> DataFrame:
    """The questions of the k largest sections: place, title, size, question."""
    best = sections(chunks).orderBy(F.desc("size"), "pos").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("size"), "pos")).alias("place"), "title", "size", T.as_question(F.col("title")).alias("question"))


def fill_up(own: Column, index: Column, k: int = 3) -> Column:
    """A chunk's own questions, then those of the index not among them, up to k."""
    return F.slice(F.array_distinct(F.concat(own, index)), 1, k)


def audit_row(answers: DataFrame) -> DataFrame:
    """What the log says of an answer (steps, images, chunks: array<struct<chunk_id, doc_id, version>>, citations: array<struct<ocr_used>>)."""
    return answers.withColumns(
        {
            "n_steps": F.size("steps"), "n_images": F.size("images"), "retrieved_chunk_ids": F.col("chunks.chunk_id"), "retrieved_docs": F.sort_array(F.array_distinct("chunks.doc_id")),
            "retrieved_versions": F.sort_array(F.array_distinct(F.filter("chunks.version", lambda v: v.isNotNull()))), "ocr_sourced_citations": F.size(F.filter("citations", lambda c: c["ocr_used"])),
        }
    )
