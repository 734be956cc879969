"""From parsed pages to chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..settings import SETTINGS
from ..sources.corpus import flat_images
from ..sources.scratch import shared_dir
from .evaluate import nearest_rank

SEPARATORS = ("\n\n", "\n", ". ", " ")


def numbered(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """df (by, order and few other columns) with each row's number within `by`, from 1, as int.

    A hot `by` is not one task's: rows are dealt by range over both columns and numbered where they are; what is added up over tasks
    is a row for each task and value of `by`."""
    dealt = df.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33))
    shared_dir(df.sparkSession)
    dealt = dealt.checkpoint()  # the same deal in both uses
    starts = dealt.groupBy("_task", by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select("_task", F.col(by).alias("_by"), "_first", "_ahead")
    out = dealt.join(starts.withColumnRenamed("_task", "_t"), (F.col("_task") == F.col("_t")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_ahead") + 1).cast("int").alias(name))


def last_known(df: DataFrame, by: str, order: list[str], value: str, name: str, own: bool = True) -> DataFrame:
    """df with the last `value` that isn't null at or (own=False: only) ahead of each row, within `by`, in the order of `order`.

    A hot `by` is not one task's: rows are dealt by range and looked back on where they are; what is carried over tasks is a row for each
    task and value of `by`. df should have few columns."""
    dealt = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33))
    shared_dir(df.sparkSession)
    dealt = dealt.checkpoint()  # the same deal in both uses
    ends = dealt.groupBy("_task", by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_end"))
    ahead = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_ahead", F.last("_end", ignorenulls=True).over(ahead)).select(F.col("_task").alias("_t"), F.col(by).alias("_by"), "_ahead")
    here = Window.partitionBy("_task", by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = dealt.withColumn("_here", F.last(value, ignorenulls=True).over(here)).join(starts, (F.col("_task") == F.col("_t")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.select(*df.columns, F.coalesce("_here", "_ahead").alias(name))


def numbered_pages(pages: DataFrame, order: str) -> DataFrame:
    """doc_id, page (from 1, by `order` within the document), text of pages (doc_id, order, text). Texts stay where they are until their
    numbers are known. Pages of equal order in one document are numbered in any order, and those without are not pages."""
    n = numbered(pages.where(F.col(order).isNotNull()).select("doc_id", order), "doc_id", order, "page")
    spread = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", order).orderBy("page" if "page" in df.columns else "text")))
    out = spread(pages.where(F.col(order).isNotNull())).alias("a").join(spread(n).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{order}") == F.col(f"b.{order}")) & (F.col("a._nth") == F.col("b._nth")))
    return out.select("a.doc_id", "b.page", "a.text")


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos (from 0), line of pages (doc_id, page, text)."""
    return pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


#: Recurring lines up to this number are sent to where the pages are.
MOST_BROADCAST_LINES = 200_000


def boilerplate(pages: DataFrame, share: float = SETTINGS.boilerplate_share, most_chars: int = SETTINGS.boilerplate_chars) -> DataFrame:
    """doc_id, line: trimmed lines of limited length that stand on more than a share of their document's pages (doc_id, text; a page in a
    row). A page tells each line once."""
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= most_chars))
    each = pages.select("doc_id", F.explode(F.array_distinct(lines)).alias("line"))
    found = each.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).join(n, "doc_id").where(F.col("n") > share * F.col("n_pages")).select("doc_id", "line")
    shared_dir(pages.sparkSession)
    return found.checkpoint()  # few lines, which are used several times


def strip_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """pages (doc_id, page, text; a page in a row) without boilerplate lines and lone page numbers (one off either way): doc_id, page, text, trimmed at both ends.
    Lines are not taken from their page."""
    gone = repeated.groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))  # a share of pages leaves a document few of them
    gone = F.broadcast(gone) if repeated.count() <= MOST_BROADCAST_LINES else gone
    out = pages.select("doc_id", "page", "text").join(gone, "doc_id", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<string>")))

    def stays(line: Column) -> Column:
        t = F.trim(line)
        number = F.when(t.rlike("^[0-9]{1,9}$"), t.cast("int"))
        return ~F.array_contains(F.col("_gone"), t) & F.coalesce(~number.between(F.col("page") - 1, F.col("page") + 1), F.lit(True))

    text = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), stays), "\n")
    return out.select("doc_id", "page", F.trim(text, F.lit(" \n\t\r")).alias("text"))


def merge_ocr(pages: DataFrame) -> DataFrame:
    """pages (native, ocr_text, ocr_status: ok, empty, unavailable or null) with text, and whether OCR was tried, used, failed or
    found nothing. OCR is tried where native text is short; if it found enough, native text not in it goes ahead of it."""
    native, ocr = F.trim(F.coalesce("native", F.lit(""))), F.trim(F.coalesce("ocr_text", F.lit("")))
    tried = F.length(native) < K.OCR_LEAST_NATIVE_CHARS
    status = F.when(F.col("ocr_status") == "unavailable", "unavailable").when(F.length(ocr) < K.OCR_LEAST_CHARS, "empty").otherwise("ok")
    used = tried & (status == "ok")
    text = F.when(~used, F.coalesce("native", F.lit(""))).when((native != "") & ~ocr.contains(native), F.concat(native, F.lit("\n"), ocr)).otherwise(ocr)
    return pages.withColumns({"text": text, "ocr_attempted": tried, "ocr_used": used, "ocr_failed": tried & (status == "unavailable"), "ocr_empty": tried & (status == "empty")})


def headers(pages: DataFrame, pattern: str = K.SECTION_HEADER) -> DataFrame:
    """doc_id, page, seg (from 0), title (null for text ahead of the first header), body: trimmed, empty bodies left out; a page
    where nothing is left is one untitled segment. pages have a page in a row, which is cut where it is.

    A header is a line that matches the pattern as a whole; a body runs up to the next header."""
    # As a generator's output a column is made once, where it would else be made again for each use in a lambda.
    once = lambda df, name, c: df.select("*", F.inline(F.array(F.struct(c.alias(name)))))
    out = once(pages.select("doc_id", "page", "text"), "_text", F.coalesce("text", F.lit(""))).drop("text")
    out = once(out, "_lines", F.split("_text", "\n"))
    out = once(out, "_at", F.filter(F.transform("_lines", lambda x, k: F.when(x.rlike(f"^(?:{pattern})$"), k)), lambda k: k.isNotNull()))

    def part(k: Column) -> Column:
        begin = F.when(k > 0, F.get("_at", k - 1) + 1).otherwise(0)
        end = F.coalesce(F.get("_at", k), F.size("_lines"))
        body = F.trim(F.array_join(F.slice("_lines", begin + 1, end - begin), "\n"), F.lit(" \n\t\r"))
        return F.struct(F.when(k > 0, F.trim(F.get("_lines", begin - 1))).alias("title"), body.alias("body"))

    parts = F.filter(F.transform(F.sequence(F.lit(0), F.size("_at")), part), lambda x: x["body"] != "")
    bare = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("_text").alias("body")))
    out = once(out, "_parts", parts).withColumn("_parts", F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(bare))
    return out.select("doc_id", "page", F.posexplode("_parts").alias("seg", "_p")).select("doc_id", "page", "seg", "_p.title", "_p.body")


def carry_titles(segments: DataFrame) -> DataFrame:
    """segments (doc_id, page, seg, title, body; one for each page and seg) without pages of contents; a page's first segment without
    title takes the last title before it in its document (is_continuation)."""
    out = segments.where(~T.looks_like_contents(F.col("body")))
    last = last_known(out.select("doc_id", "page", "seg", "title"), "doc_id", ["page", "seg"], "title", "_last", own=False)
    last = last.where((F.col("seg") == 0) & F.col("title").isNull() & F.col("_last").isNotNull()).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "_last")
    out = out.join(last, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("seg") == 0), "left").drop("_d", "_p")
    goes_on = (F.col("seg") == 0) & F.col("title").isNull() & F.col("_last").isNotNull()
    return out.withColumn("is_continuation", goes_on).withColumn("title", F.when(goes_on, F.col("_last")).otherwise(F.col("title"))).drop("_last")


def title_places(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, pos, title, y of titles (doc_id, page, pos, title): the first of the page's lines (y, text, pos) that equals
    the title's first line; titles without one are left out."""
    first = lines.groupBy("doc_id", "page", F.col("text").alias("_line")).agg(F.min_by("y", "pos").alias("y"))
    return titles.withColumn("_line", F.trim(F.split(F.trim("title"), "\n")[0])).join(first, ["doc_id", "page", "_line"]).drop("_line")


def reading_order(lines: DataFrame, above: DataFrame) -> DataFrame:
    """lines (doc_id, page, pos, line) with `place` (from 1): those that stand in `above` (doc_id, page, text: lines printed above
    the first title, as often as they are printed) come first, all else keeps its order."""
    n = above.groupBy("doc_id", "page", F.col("text").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    out = lines.withColumn("t", F.trim("line")).join(n, ["doc_id", "page", "t"], "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "page", "t").orderBy("pos"))
    out = out.withColumn("moved", nth <= F.coalesce("n", F.lit(0)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(~F.col("moved"), "pos"))).drop("t", "n")


def figures_by_section(titles: DataFrame, figures: DataFrame) -> DataFrame:
    """An as-of join: the figures (doc_id, page, y, pos, image_id) with the last title (doc_id, page, y, pos, title) at or above
    them on the page, or else the last of the pages before; figures without any are left out."""
    t = titles.select("doc_id", "page", "y", F.lit(0).alias("kind"), "pos", "title", F.lit(None).cast("string").alias("image_id"))
    f = figures.select("doc_id", "page", "y", F.lit(1).alias("kind"), "pos", F.lit(None).cast("string").alias("title"), "image_id")
    out = last_known(t.unionByName(f), "doc_id", ["page", "y", "kind", "pos"], "title", "last")
    return out.where((F.col("kind") == 1) & F.col("last").isNotNull()).select("doc_id", "page", "image_id", "pos", T.title_key(F.col("last")).alias("section"))


def split_text(text: str, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters where separators allow it: cut at the first separator of the list that occurs, kept at
    the start of the next part; parts still too long are cut by the ones after it; neighbours are merged while they fit, and
    each piece begins with up to `overlap` characters of the one before."""
    own = next((s for s in separators if s in text), None)
    if own is None:
        return [text.strip()] if text.strip() else []
    rest = separators[separators.index(own) + 1 :]
    parts = [p for p in re.split(f"(?={re.escape(own)})", text) if p]
    out: list[str] = []
    held: list[str] = []

    def emit() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) >= size:
            if held:
                emit()
                held = []
            out += split_text(part, size, overlap, rest) if rest else [part.strip()]
            continue
        if held and sum(map(len, held)) + len(part) > size:
            emit()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    if held:
        emit()
    return out


def split_bodies(segments: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """segments with a row for each piece of their body (piece, from 0; text); only bodies over `size` go through Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_p=b["body"].map(lambda x: split_text(x, size, overlap)))

    short = segments.where(F.length("body") <= size).withColumn("_p", F.array("body"))
    long = segments.where(F.length("body") > size).mapInPandas(run, short.schema)
    return short.unionByName(long).select("*", F.posexplode("_p").alias("piece", "text")).drop("_p")


def attach_figures(pieces: DataFrame, figures: DataFrame) -> DataFrame:
    """pieces (doc_id, title) with section (the title, its white space as single spaces) and image_ids: all figures (doc_id, section,
    image_id, pos) of the document that stand under such a title, in order."""
    images = figures.groupBy("doc_id", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "image_id"))), lambda x: x["image_id"]).alias("image_ids"))
    out = pieces.withColumn("section", T.title_key(F.col("title"))).join(images, ["doc_id", "section"], "left")
    return out.withColumn("image_ids", F.coalesce("image_ids", F.array().cast("array<string>")))


def chunk(pages: DataFrame, figures: DataFrame, manuals: DataFrame, header: str = K.SECTION_HEADER) -> DataFrame:
    """Structural chunks of pages (doc_id, page, text): headers, titles carried forward, size splits, tiny pieces and pages of
    contents dropped, numbered in document order; figures (doc_id, section, image_id, pos) by their section's title; version,
    model, firmware and source_path from manuals (doc_id)."""
    segs = carry_titles(headers(pages, header))
    pieces = split_bodies(segs).where((F.length(F.trim("text")) >= SETTINGS.least_chunk_chars) & ~T.looks_like_contents(F.col("text")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seg", "piece"))
    out = attach_figures(pieces.withColumn("n", n), figures).join(manuals.select("doc_id", "version", "model", "firmware", "source_path"), "doc_id", "left")
    return out.select(
        T.chunk_id(F.col("doc_id").cast("string"), F.col("version"), F.col("n")).alias("chunk_id"), "doc_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("title").alias("section_title"), "text",
        "image_ids", "version", "model", "firmware", "source_path", "is_continuation",
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos, y, text of the pages' printed lines (text_lines), trimmed, without empty ones."""
    each = pages.select("doc_id", "page", F.posexplode("text_lines").alias("pos", "l")).select("doc_id", "page", "pos", "l.y", F.trim("l.text").alias("text"))
    return each.where("text != ''")


def in_reading_order(pages: DataFrame, printed: DataFrame, header: str = K.SECTION_HEADER, tolerance: float = SETTINGS.title_tolerance) -> DataFrame:
    """pages (doc_id, page, text) with those lines ahead of all others that are printed (page_lines) more than `tolerance` above their
    page's first title; pages without a title that is printed stay as they are."""
    heads = headers(pages, header).where("title is not null").select("doc_id", "page", F.col("seg").alias("pos"), "title")
    first = title_places(heads, printed).groupBy("doc_id", "page").agg(F.min("y").alias("_first"))
    above = printed.join(first, ["doc_id", "page"]).where(F.col("y") < F.col("_first") - tolerance).select("doc_id", "page", "text")
    ordered = reading_order(lines_of(pages), above).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page").join(ordered, ["doc_id", "page"])


def section_figures(pages: DataFrame, printed: DataFrame, images: DataFrame, header: str = K.SECTION_HEADER) -> DataFrame:
    """doc_id, section, image_id, pos (in document order): each image (doc_id, page, pos, image_id, y0) under the title that stands over
    it, by where titles are printed."""
    titles = headers(pages, header).where("title is not null").select("doc_id", "page", F.col("seg").alias("pos"), "title")
    figures = images.select("doc_id", "page", F.col("y0").alias("y"), "pos", "image_id")
    return figures_by_section(title_places(titles, printed), figures).select("doc_id", "section", "image_id", (F.col("page") * F.lit(1_000_000).cast("long") + F.col("pos")).alias("pos"))


def ingest(pages: DataFrame, manuals: DataFrame, header: str = K.SECTION_HEADER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From parsed pages (sources.corpus.PAGES; instead of text and its flags native, ocr_text and ocr_status) and manuals (doc_id,
    version, model, firmware, source_path) all that the store keeps: chunks, images and the manuals' records.

    OCR's text is merged, boilerplate goes, lines are put in reading order, figures go to the section over them. Lists of lines or images
    that are null, or no column, are empty."""
    if "native" in pages.columns:
        pages = merge_ocr(pages)
    for c, kind in (("text_lines", "array<struct<y:double,text:string>>"), ("images", "array<struct<image_id:string,x0:double,y0:double,x1:double,y1:double>>")):
        pages = pages if c in pages.columns else pages.withColumn(c, F.lit(None).cast(kind))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in pages.columns else F.lit(False)
    pages = pages.withColumns({c: flag(c) for c in ("ocr_used", "ocr_failed", "ocr_empty")})
    printed, images = page_lines(pages), flat_images(pages)
    text = in_reading_order(strip_lines(pages.select("doc_id", "page", "text"), boilerplate(pages.select("doc_id", "page", "text"))), printed, header)
    chunks = chunk(text, section_figures(text, printed, images, header), manuals, header)
    record = ingestion_record(chunks, pages).join(manuals, "doc_id").withColumn("ingested_at", T.utc_now())
    return chunks, images.join(manuals.select("doc_id", "version"), "doc_id"), record


def ingestion_record(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: chunks, pages, and pages by what OCR did."""
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    p = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("ocr_used").alias("n_ocr_pages"), F.count_if("ocr_failed").alias("n_ocr_failed_pages"), F.count_if("ocr_empty").alias("n_ocr_empty_pages"))
    return p.join(c, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Number, upper median, least and greatest length of chunks, and the share with a title."""
    sized = chunks.select(F.length("text").alias("size"), F.col("section_title").isNotNull().alias("titled"), F.lit(0).alias("_all"))
    rest = sized.agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("greatest"), F.round(F.avg(F.col("titled").cast("int")), 3).alias("titled_share"))
    return rest.join(F.broadcast(nearest_rank(sized, ["_all"], "size", {"median": 0.5}).drop("_all")), how="left")


def semantic_breaks(sentences: DataFrame, percent: float = 95.0) -> DataFrame:
    """doc_id, pos, distance, breaks: for each of a document's sentences (doc_id, pos, embedding) but its first, the cosine distance
    to the one before, and whether a chunk begins there: at distances above the document's percentile (linear interpolation)."""
    line = Window.partitionBy("doc_id").orderBy("pos")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    both = sentences.withColumn("_b", F.lag("embedding").over(line)).where("_b is not null")
    far = both.select("doc_id", "pos", F.round(1 - dot("embedding", "_b") / F.sqrt(dot("embedding", "embedding") * dot("_b", "_b")), 6).alias("distance"))
    limit = far.groupBy("doc_id").agg(F.percentile("distance", F.lit(percent / 100)).alias("_limit"))
    return far.join(limit, "doc_id").select("doc_id", "pos", "distance", (F.col("distance") > F.col("_limit")).alias("breaks"))
