"""Scans, sinks, lookups, small projections and the request from end to end, as queries over the test tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import ingest as I
from ..operators import lexical_index as LI
from ..operators import requests as RQ
from ..operators import retrieval as R
from ..operators import vector_index as V
from ..sources import corpus as SC
from ..sources import scratch
from ..sources import store as S
from ..streaming import sessions as ST
from . import catalog as C
from .catalog import docs, query, table

_D = "d AS (SELECT *, coalesce(text, '') AS t FROM documents)"


# documents as pages whose native text is cut short or missing, with what OCR read of them: all, all but the beginning, or nothing.
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return docs(spark, sf_dir).select(
        F.col("source").alias("doc_id"), n.alias("page"), F.when(n % 3 == 0, F.substring("text", 1, 25)).when(n % 3 == 1, F.substring("text", 1, 60)).alias("native"),
        F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, F.substr(F.col("text"), F.lit(10))).when(n % 4 == 2, "x").alias("ocr_text"), F.when(n % 5 == 0, "unavailable").alias("ocr_status"),
    )


_OCR = f"""{_D}, sp AS (SELECT source AS doc_id, doc_id AS page, CASE doc_id % 3 WHEN 0 THEN left(t, 25) WHEN 1 THEN left(t, 60) END AS native,
  CASE doc_id % 4 WHEN 0 THEN t WHEN 1 THEN substr(t, 10) WHEN 2 THEN 'x' END AS ocr, doc_id % 5 = 0 AS broken FROM d),
sq AS (SELECT *, trim(coalesce(native, '')) AS n, trim(coalesce(ocr, '')) AS o FROM sp),
sr AS (SELECT *, length(n) < 40 AS ocr_attempted, length(n) < 40 AND NOT broken AND length(o) >= 20 AS ocr_used, length(n) < 40 AND broken AS ocr_failed, length(n) < 40 AND NOT broken AND length(o) < 20 AS ocr_empty FROM sq),
oc AS (SELECT doc_id, page, ocr_attempted, ocr_used, ocr_failed, ocr_empty, CASE WHEN NOT ocr_used THEN coalesce(native, '') WHEN n <> '' AND NOT contains(o, n) THEN n || chr(10) || o ELSE o END AS text FROM sr)"""


@query(f"WITH {_OCR} SELECT * FROM oc")
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_ocr(scanned_pages(spark, sf_dir)).select("doc_id", "page", "ocr_attempted", "ocr_used", "ocr_failed", "ocr_empty", "text")


@query(f"WITH {_OCR} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE ocr_used) AS n_ocr_pages, count(*) FILTER (WHERE ocr_failed) AS n_ocr_failed_pages, count(*) FILTER (WHERE ocr_empty) AS n_ocr_empty_pages, count(*) FILTER (WHERE length(text) >= 30) AS n_chunks FROM oc GROUP BY doc_id")
def ingestion_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = I.merge_ocr(scanned_pages(spark, sf_dir))
    return I.ingestion_record(pages.where("length(text) >= 30"), pages)


@query("WITH b AS (SELECT item_id, text FROM benchmark) SELECT source AS doc_id, doc_id AS page, length(text) AS n FROM documents WHERE doc_id IN (SELECT item_id FROM b)")
def page_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a list names."""
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.length("text").cast("long").alias("n")).join(wanted, "page", "left_semi").select("doc_id", "page", "n")


# documents as chunks with all that the corpus stores of them.
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = docs(spark, sf_dir), F.col("doc_id")
    return d.select(
        "text", T.chunk_id(F.col("source"), F.concat(F.lit("Rev. "), F.col("lang"), F.lit("/"), (n % 3).cast("string")), n.cast("int")).alias("chunk_id"), F.col("source").alias("doc_id"), n.cast("int").alias("page_start"), n.cast("int").alias("page_end"),
        F.when(n % 4 != 0, F.substring("text", 1, 12)).alias("section_title"), F.when(n % 2 == 0, F.array(F.concat(F.lit("i"), n.cast("string")), F.lit('q"'))).otherwise(F.array().cast("array<string>")).alias("image_ids"),
        F.col("lang").alias("version"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("firmware"), F.lit("").alias("source_path"), (n % 7 == 0).alias("ocr_used"), (n % 5 == 0).alias("is_continuation"),
    )


_CHUNKS = f"""{_D}, sc AS (SELECT t AS text, source || '_rev-' || lang || '-' || (doc_id % 3) || '_c' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 4, '0') ELSE CAST(doc_id AS VARCHAR) END AS chunk_id, source AS doc_id, CAST(doc_id AS INTEGER) AS page_start,
  CASE WHEN doc_id % 4 <> 0 THEN nullif(left(t, 12), '') END AS section_title, CASE WHEN doc_id % 2 = 0 THEN 'i' || doc_id || '|q"' ELSE '' END AS image_ids, lang AS version, doc_id % 7 = 0 AS ocr_used, doc_id % 5 = 0 AS is_continuation FROM d)"""


@query(f"WITH {_CHUNKS} SELECT * FROM sc")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as the corpus file and read again, past a malformed line for each twentieth chunk."""
    path = scratch.scratch_path(spark, "corpus")
    c = stored_chunks(spark, sf_dir)
    good = SC.to_corpus(c).select(F.to_json(F.struct("text", "metadata")).alias("value"))
    bad = c.where("page_start % 20 = 0").select(F.concat(F.lit('{"text": '), F.col("chunk_id")).alias("value"))
    good.unionByName(bad).write.text(path)
    out = SC.corpus(spark, path, tolerant=True)
    return out.select("text", "chunk_id", "doc_id", "page_start", "section_title", F.array_join("image_ids", "|").alias("image_ids"), "version", "ocr_used", "is_continuation")


@query("SELECT text AS query, CASE item_id % 3 WHEN 0 THEN 'answerable' WHEN 1 THEN 'near' ELSE 'off_topic' END AS kind, CAST(item_id AS INTEGER) AS page, item_id % 3 = 2 AS off_topic FROM benchmark")
def evaluation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions written as a file with blank lines between, and read."""
    path = scratch.scratch_path(spark, "questions")
    i = F.col("item_id")
    b = table(spark, sf_dir, "benchmark").select(F.col("text").alias("query"), F.when(i % 3 == 0, "answerable").when(i % 3 == 1, "near").otherwise("off_topic").alias("kind"), F.array(i.cast("int")).alias("expected_pages"), (i % 3 == 2).alias("off_topic"))
    b.select(F.concat(F.to_json(F.struct("*")), F.lit("\n\n")).alias("value")).write.text(path)
    return SC.scan_json(spark, path, SC.EVAL).select("query", "kind", F.get("expected_pages", F.lit(0)).alias("page"), "off_topic")


# conversations as answers: a turn is a step, its text's document the chunk.
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    d = F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("chunk_id"), F.concat(F.lit("m"), (turn % 3).cast("string")).alias("doc_id"), F.when(turn % 2 == 0, F.concat(F.lit("v"), (turn % 4).cast("string"))).alias("version"))
    each = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", d.alias("c")))).alias("x"), F.sum(F.length("text")).alias("size"))
    return each.select(
        F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("query"), F.col("x.turn").alias("steps"), F.filter("x.turn", lambda k: k % 2 == 1).alias("images"), F.col("x.c").alias("chunks"),
        F.transform("x", lambda k: F.struct((k["turn"] % 3 == 1).alias("ocr_used"))).alias("citations"), (F.col("size") % 2 == 0).alias("fallback"), F.col("size").cast("int").alias("latency_ms"),
    )


@query(
    """SELECT 'q' || conv_id AS query, count(*) AS n_steps, count(*) FILTER (WHERE turn % 2 = 1) AS n_images, string_agg('c' || turn, ',' ORDER BY turn) AS chunk_ids, array_to_string(list_sort(list(DISTINCT 'm' || (turn % 3))), ',') AS docs,
  array_to_string(list_sort(coalesce(list(DISTINCT 'v' || (turn % 4)) FILTER (WHERE turn % 2 = 0), [])), ',') AS versions, count(*) FILTER (WHERE turn % 3 = 1) AS ocr_sourced_citations, sum(length(text)) % 2 = 0 AS fallback, CAST(sum(length(text)) AS INTEGER) AS latency_ms
FROM conversations GROUP BY conv_id"""
)
def audit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log says of answers, appended in two parts and read as a whole."""
    path = scratch.scratch_path(spark, "audit")
    rows = A.audit_row(answered(spark, sf_dir)).select("query", "fallback", "n_steps", "n_images", "retrieved_chunk_ids", "retrieved_docs", "retrieved_versions", "ocr_sourced_citations", "latency_ms", T.utc_now().alias("timestamp"), T.request_id().alias("request_id"))
    for k in (0, 1):
        S.append_log(rows.where(F.pmod(F.crc32(F.col("query").cast("binary")), F.lit(2)) == k), path)
    log = SC.scan_json(spark, path, SC.AUDIT).where(F.col("request_id").rlike("^[0-9a-f]{8}$") & F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$"))
    text = lambda c, name: F.array_join(c, ",").alias(name)
    return log.select("query", *[F.col(c).cast("long").alias(c) for c in ("n_steps", "n_images", "ocr_sourced_citations")], text("retrieved_chunk_ids", "chunk_ids"), text("retrieved_docs", "docs"), text("retrieved_versions", "versions"), "fallback", "latency_ms")


@query(
    """WITH o AS (SELECT p_brand AS doc_id, 'v' || (p_size % 4) AS version, p_partkey AS pos, p_name AS image_id FROM part),
k AS (SELECT doc_id, version, pos, image_id FROM o WHERE version <> 'v1' OR doc_id NOT IN (SELECT doc_id FROM o WHERE version = 'v2') UNION ALL SELECT doc_id, 'v1', pos, image_id || ' II' FROM o WHERE version = 'v2')
SELECT * FROM k"""
)
def version_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store written by document and version, one version of all documents replaced, all read: one by itself, the others as a whole."""
    path = scratch.scratch_path(spark, "store")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("v"), (F.col("p_size") % 4).cast("string")).alias("version"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("image_id"))
    S.write_versions(p, path)
    new = p.where("version = 'v2'").select("doc_id", F.lit("v1").alias("version"), "pos", F.concat("image_id", F.lit(" II")).alias("image_id"))
    S.write_versions(new, path)
    # Documents that have no row of the new version keep the old one, as only partitions that are written are replaced.
    one = p.agg(F.min("doc_id")).first()[0]
    both = S.read_versions(spark, path, one).unionByName(S.read_versions(spark, path).where(F.col("doc_id") != one))
    return both.select("doc_id", "version", "pos", "image_id")


_BOXES = """bx AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_discount * 100 AS DOUBLE) AS y0, CAST(l_quantity + l_linenumber * 5 - 5 AS DOUBLE) AS x1, CAST(l_discount * 100 + l_tax * 300 AS DOUBLE) AS y1 FROM lineitem),
ba AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM bx)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("l_quantity").cast("double"), (F.col("l_discount") * 100).cast("double")
    x1, y1 = (F.col("l_quantity") + F.col("l_linenumber") * 5 - 5).cast("double"), (F.col("l_discount") * 100 + F.col("l_tax") * 300).cast("double")
    image = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image_id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.array(image).alias("images"))


@query(
    f"""WITH {_BOXES} SELECT doc_id, page, round(area, 4) AS area, round(greatest(0, x0 - 4), 4) AS x0, round(greatest(0, y0 - 4), 4) AS y0, round(least(60, x1 + 4), 4) AS x1, round(least(30, y1 + 4), 4) AS y1,
  'bbox (' || CAST(round_even(x0, 0) AS BIGINT) || ', ' || CAST(round_even(y0, 0) AS BIGINT) || ') – (' || CAST(round_even(x1, 0) AS BIGINT) || ', ' || CAST(round_even(y1, 0) AS BIGINT) || ') pt' AS label FROM ba WHERE area >= 100"""
)
def figure_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = SC.flat_images(boxes(spark, sf_dir))
    c = T.clip(*(F.col(x) for x in ("x0", "y0", "x1", "y1")), F.lit(60.0), F.lit(30.0))
    return f.select("doc_id", "page", F.round("area", 4).alias("area"), *[F.round(c[x], 4).alias(x) for x in ("x0", "y0", "x1", "y1")], T.box_label(*(F.col(x) for x in ("x0", "y0", "x1", "y1"))).alias("label"))


@query(
    """WITH i AS (SELECT p_brand AS doc_id, p_size AS image_id, p_partkey % 5 AS v, p_partkey AS pos FROM part), u AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY doc_id, image_id, v ORDER BY pos DESC) = 1)
SELECT doc_id, image_id, 'v' || v AS version, pos FROM u WHERE image_id IN (SELECT n_nationkey FROM nation) QUALIFY row_number() OVER (PARTITION BY doc_id, image_id ORDER BY v DESC) = 1"""
)
def image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures kept once for each version, the last written one; of those that are wanted the record of the latest version."""
    i = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("image_id"), F.concat(F.lit("v"), (F.col("p_partkey") % 5).cast("string")).alias("version"), F.col("p_partkey").alias("pos"))
    kept = S.upsert(i.limit(0), i, ["doc_id", "image_id", "version"]).withColumn("parts", T.version_parts(F.col("version")))
    wanted = kept.select("doc_id", "image_id").distinct().join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("image_id")), "image_id", "left_semi")
    return S.image_records(kept, wanted).select("doc_id", "image_id", "version", "pos")


@query(
    f"""WITH {C._PAGES}, t AS (SELECT doc_id, page, pos AS at, trim(line) AS title FROM lines_ WHERE trim(line) <> ''), f AS (SELECT doc_id, page, trim(line) AS line, min(pos) AS first FROM lines_ GROUP BY ALL)
SELECT t.doc_id, t.page, t.at AS pos, title, CAST(first AS DOUBLE) * 12 AS y FROM t JOIN f ON t.doc_id = f.doc_id AND t.page = f.page AND title = line"""
)
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place on its page of each title: that of the first line that equals the title's first one."""
    lines = I.lines_of(C.pages(spark, sf_dir)).withColumn("text", F.trim("line"))
    titles = lines.where("text != ''").select("doc_id", "page", "pos", F.concat("text", F.lit("\nmore")).alias("title"))
    out = I.title_places(titles, lines.select("doc_id", "page", "text", "pos", (F.col("pos") * 12.0).alias("y")))
    return out.select("doc_id", "page", "pos", F.regexp_replace("title", "\nmore$", "").alias("title"), "y")


_LOGITS = """lo AS (SELECT b.query_id, chunk_id, b.score, b.rank AS before, CAST(length(coalesce(text, '')) % 7 - 3 AS DOUBLE) AS logit FROM bm25 b JOIN documents ON chunk_id = doc_id)"""


def logits(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """A scorer's stand-in: from the length of the text."""
    return ranked.select("query_id", "chunk_id").distinct().join(docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), (F.length("text") % 7 - 3).cast("double").alias("logit")), "chunk_id")


@query(f"WITH {C._BM25}, {_LOGITS} SELECT query_id, chunk_id, round(1 / (1 + exp(-logit)), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, before) AS INTEGER) AS rank FROM lo")
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = C.lexical_lists(spark, sf_dir)
    out = R.rerank(lists.join(logits(spark, sf_dir, lists), ["query_id", "chunk_id"]), F.col("logit"))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def shared_words() -> R.Scorer:
    """A stand-in for a cross-encoder: how many of the query's words a text has."""
    return lambda queries, texts: [0.25 * len(set(q.lower().split(" ")) & set(t.lower().split(" "))) - 2 for q, t in zip(queries, texts, strict=True)]


@query(
    f"""WITH {C._BM25}, sw AS (SELECT b.query_id, chunk_id, b.rank AS before, 0.25 * len(list_intersect(list_distinct(string_split(lower(coalesce(q.text, '')), ' ')), list_distinct(string_split(lower(coalesce(d.text, '')), ' ')))) - 2 AS logit
  FROM bm25 b JOIN documents d ON chunk_id = doc_id JOIN benchmark q ON b.query_id = q.item_id)
SELECT query_id, chunk_id, round(1 / (1 + exp(-CAST(logit AS DOUBLE))), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, before) AS INTEGER) AS rank FROM sw"""
)
def rerank_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical lists in the order of a model that reads query and text, as tasks load it."""
    said = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    out = R.rerank_by(C.lexical_lists(spark, sf_dir).drop("score").join(said, "query_id").join(texts, "chunk_id"), shared_words)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {C._BM25} SELECT query_id, chunk_id, score, rank FROM bm25")
def stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical lists from the stored index, to which the documents came in two batches; some of the first came with other texts and were replaced."""
    path = scratch.scratch_path(spark, "lexical")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    LI.add(d.where("chunk_id % 3 != 0").withColumn("text", F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("former "), "text")).otherwise(F.col("text"))), path, 0)
    LI.add(d.where("chunk_id % 3 = 0 or chunk_id % 5 = 0"), path, 1)
    return LI.search(spark, path, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def indexed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense lists from the stored index, to which the vectors came in two batches; the second one replaced a document of the first."""
    path, e = scratch.scratch_path(spark, "vectors"), table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.lit("v1").alias("version"), "embedding")
    V.fit(v, path)
    V.add(v.where("doc_id % 2 = 0 or doc_id = 1"), path, 0)
    V.add(v.where("doc_id % 2 = 1"), path, 1)
    return V.search(spark, path, e.where("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), "embedding"))


@query()
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_lists(spark, sf_dir)


@query("SELECT count(*) AS n_queries, true AS nine_tenths_found FROM embeddings WHERE vec_id % 100 = 0")
def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of what exact search does, over all queries."""
    found = V.recall(indexed_lists(spark, sf_dir), C.dense_lists(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("nine_tenths_found"))


@query("SELECT doc_id, 'passage: ' || coalesce(text, '') AS passage, 'query: ' || coalesce(lang, '') AS query, coalesce(lang, '') AS plain FROM documents")
def model_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.coalesce("lang", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", T.prefixed(F.col("text"), "passage", "intfloat/multilingual-e5-large").alias("passage"), T.prefixed(lang, "query", "E5-small").alias("query"), T.prefixed(lang, "query", "other").alias("plain"))


@query(
    """SELECT doc_id, trim(regexp_replace(lower('Rev. ' || coalesce(lang, '') || ' /' || coalesce(source, '') || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  source || CASE WHEN lang <> 'en' THEN ' ' || lang ELSE '' END || ' · p.' || doc_id || CASE WHEN left(text, 12) <> '' THEN ' · ' || left(text, 12) ELSE '' END AS label,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n_ids, left(coalesce(text, ''), 200) AS snippet FROM documents"""
)
def chunk_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of chunks: slugs of versions, provenance, decoded lists of figures (malformed ones are empty), snippets."""
    n = F.col("doc_id")
    slug = T.slug(F.concat(F.lit("Rev. "), F.coalesce("lang", F.lit("")), F.lit(" /"), F.coalesce("source", F.lit("")), F.lit("!")))
    label = T.provenance(F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), n, F.substring("text", 1, 12))
    ids = T.decode_ids(F.when(n % 3 == 0, F.lit('["a", ')).otherwise(F.lit('["a", "b"]')))
    return docs(spark, sf_dir).select("doc_id", slug.alias("slug"), label.alias("label"), F.size(ids).alias("n_ids"), T.snippet(F.col("text")).alias("snippet"))


@query(
    f"""WITH {C._KNN}, {C._BM25}, u AS (SELECT chunk_id, 'dense' AS origin, 1 AS p FROM knn UNION ALL SELECT chunk_id, 'lexical', 0 FROM bm25), v AS (SELECT DISTINCT ON (chunk_id) chunk_id, origin FROM u ORDER BY chunk_id, p)
SELECT chunk_id, origin, source FROM v LEFT JOIN documents ON chunk_id = doc_id"""
)
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each retrieved chunk; where both lists have it, the lexical list's copy counts."""
    of = lambda df, name, p: df.select("chunk_id", F.struct(F.lit(p).alias("p"), F.lit(name).alias("origin")).alias("o"))
    both = of(C.dense_lists(spark, sf_dir), "dense", 1).unionByName(of(C.lexical_lists(spark, sf_dir), "lexical", 0))
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return both.groupBy("chunk_id").agg(F.min("o").alias("o")).join(source, "chunk_id", "left").select("chunk_id", "o.origin", "source")


@query(
    """WITH m AS (SELECT user_id AS request_id, event_type AS label, epoch_us(ts) / 1000000.0 AS sec FROM events),
p AS (SELECT request_id, min(sec) FILTER (WHERE label = 'view') AS s, min(sec) FILTER (WHERE label = 'click') AS r, min(sec) FILTER (WHERE label = 'purchase') AS f, min(sec) FILTER (WHERE label = 'signup') AS d FROM m GROUP BY request_id)
SELECT request_id, CAST(floor((r - s) * 1000) AS BIGINT) AS retrieval_ms, CAST(floor((f - s) * 1000) AS BIGINT) AS time_to_first_token_ms, CAST(floor((coalesce(d, r) - s) * 1000) AS BIGINT) AS latency_ms FROM p"""
)
def request_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as marks of requests: a user's first view, click, purchase and signup are the phases."""
    names = F.create_map(*[F.lit(x) for pair in (("view", "start"), ("click", "retrieved"), ("purchase", "first_token"), ("signup", "done")) for x in pair])
    return RQ.phases(table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), names[F.col("event_type")].alias("label"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")))


@query(
    """WITH l AS (SELECT label AS doc_id, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
f AS (SELECT doc_id, pos, round(1 - list_dot_product(e, b) / sqrt(list_dot_product(e, e) * list_dot_product(b, b)), 6) AS distance FROM l WHERE b IS NOT NULL), q AS (SELECT doc_id, quantile_cont(distance, 0.95) AS lim FROM f GROUP BY doc_id)
SELECT f.doc_id, pos, distance, distance > lim AS breaks FROM f JOIN q ON f.doc_id = q.doc_id"""
)
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as a document's sentences."""
    return I.semantic_breaks(table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), "embedding"))


@query(
    f"""WITH {C._KNN}, {C._BM25}, {C._FUSED},
qs AS (SELECT item_id AS query_id FROM benchmark), g AS (SELECT query_id, coalesce(max(similarity), 0) AS relevance FROM qs LEFT JOIN (SELECT * FROM knn WHERE chunk_id <> query_id * 100) USING (query_id) GROUP BY query_id),
tp AS (SELECT f.*, source AS model, CAST(length(coalesce(text, '')) % 7 - 3 AS DOUBLE) AS logit FROM fused f JOIN g USING (query_id) JOIN documents ON chunk_id = doc_id WHERE relevance >= 0.8),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, rank) AS place FROM tp), sh AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY place) AS retrieved FROM rr GROUP BY query_id),
mb AS (SELECT query_id, model, max(score) AS best FROM tp WHERE model IS NOT NULL GROUP BY ALL), mt AS (SELECT *, max(best) OVER (PARTITION BY query_id) AS top FROM mb),
mc AS (SELECT query_id, coalesce(list_sort(list(model) FILTER (WHERE top > 0 AND best >= 0.85 * top)), []) AS c FROM mt GROUP BY query_id),
sp AS (SELECT query_id, rank AS number, chunk_id FROM bm25 WHERE rank % 2 = 1 UNION ALL SELECT item_id, 99, item_id FROM benchmark),
kp AS (SELECT sp.* FROM sp JOIN rr USING (query_id, chunk_id)), kc AS (SELECT query_id, count(*) AS n FROM kp GROUP BY query_id),
ci AS (SELECT query_id, chunk_id, min(number) AS n FROM kp GROUP BY ALL), cs AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY n, chunk_id) AS citations FROM ci GROUP BY query_id),
w AS (SELECT query_id, relevance, c, n, CASE WHEN relevance < 0.8 THEN 'off_topic' WHEN coalesce(len(c), 0) > 1 THEN 'ambiguous' WHEN coalesce(n, 0) = 0 THEN 'fallback' ELSE 'answer' END AS route FROM g LEFT JOIN mc USING (query_id) LEFT JOIN kc USING (query_id))
SELECT query_id, route, relevance, coalesce(retrieved, '') AS retrieved, CASE WHEN route = 'ambiguous' THEN array_to_string(c, ',') ELSE '' END AS candidate_models, CASE WHEN route = 'answer' THEN n ELSE 0 END AS n_steps, CASE WHEN route = 'answer' THEN citations ELSE '' END AS citations
FROM w LEFT JOIN sh USING (query_id) LEFT JOIN cs USING (query_id)"""
)
def answered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from gate to citations, with answers passed in: an item cites its lexical chunks of odd rank and the chunk of its own number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    dense, lexical = C.dense_lists(spark, sf_dir), C.lexical_lists(spark, sf_dir)
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", F.lit("").alias("section_title"), F.lit(False).alias("ocr_used"), F.col("source").alias("model"), F.col("source").alias("doc_id"), F.col("lang").alias("version"))
    step = lexical.where("rank % 2 = 1").select("query_id", F.col("rank").alias("number"), F.lit("step").alias("text"), "chunk_id").unionByName(items.select("query_id", F.lit(99).alias("number"), F.lit("step").alias("text"), F.col("query_id").alias("chunk_id")))
    near = dense.join(items, "query_id", "left_semi")
    # The gate leaves a query's own vector out; fusion has it.
    out = RQ.answer(items, near, lexical, chunks, step, logits(spark, sf_dir, near.select("query_id", "chunk_id").unionByName(lexical.select("query_id", "chunk_id"))), gate=near.where(F.col("chunk_id") != F.col("query_id") * 100))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("query_id", "route", "relevance", text("retrieved"), text("candidate_models"), "n_steps", text("citations"))


@query("SELECT to_json({'query_id': item_id, 'corrected': lower(coalesce(text, '')), 'n': length(coalesce(text, ''))})::VARCHAR AS shown FROM benchmark")
def understanding_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a query's understanding: all of it but the expanded text."""
    t = F.coalesce("text", F.lit(""))
    whole = F.struct(F.col("item_id").alias("query_id"), F.lower(t).alias("corrected"), F.concat(t, F.lit(" | more")).alias("expanded"), F.length(t).alias("n"))
    return table(spark, sf_dir, "benchmark").select(F.to_json(whole.dropFields("expanded")).alias("shown"))


def streamed(spark: SparkSession, out: DataFrame, name: str, state: str | None = None) -> DataFrame:
    """All that a stream gives for the files that are there now; with `state`, and what its earlier runs gave."""
    path = f"{state}-{name}" if state else scratch.scratch_path(spark, name)
    state = state or scratch.scratch_path(spark, f"{name}-state")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query(
    f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, coalesce(text, '') AS text, role = 'assistant' OR length(coalesce(text, '')) < 60 AS asks FROM conversations),
p AS (SELECT *, CASE WHEN lag(asks) OVER (PARTITION BY session ORDER BY turn) THEN lag(text) OVER (PARTITION BY session ORDER BY turn) END AS pending, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') AS w FROM t)
SELECT session, turn, pending, CASE WHEN pending <> '' AND len(w) > 0 AND NOT contains(trim(text), '?') AND len(w) <= 6 AND regexp_replace(lower(w[1]), '^[,;:]+|[,;:]+$', '', 'g') NOT IN ('{C._ASK}')
  THEN regexp_replace(pending, '[ ?]+$', '') || ' — ' || trim(text) ELSE trim(text) END AS query FROM p"""
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a slot of state each, as a stream over files of turns that come in several batches; the stream is stopped half-way and
    goes on from its checkpoint."""
    path, state, text = scratch.scratch_path(spark, "turns"), scratch.scratch_path(spark, "turns-state"), F.coalesce("text", F.lit(""))
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), text.alias("text"), (F.coalesce(F.col("role") == "assistant", F.lit(False)) | (F.length(text) < 60)).alias("asks"))
    kept = spark.conf.get(ST.PROVIDER, None)
    try:
        for part in (F.col("turn") < 2, F.col("turn").between(2, 3), F.col("turn") > 3):
            t.where(part).write.mode("append").parquet(path)
            turns = spark.readStream.schema(ST.TURNS).parquet(path)
            out = streamed(spark, ST.pending_questions(turns).select("session", "turn", "pending", "query"), "sessions", state)
    finally:
        if kept is None:
            spark.conf.unset(ST.PROVIDER)
        else:
            spark.conf.set(ST.PROVIDER, kept)
    return out


_DAY = "CAST(86400000000 AS BIGINT)"


@query(
    f"""WITH l AS (SELECT epoch_us(ts) AS us, user_id % 5 = 0 AS fb, user_id % 7 = 0 AS ot, CAST(floor(value * 40) AS INTEGER) AS lat FROM events), w AS (SELECT us // {_DAY} AS day, * FROM l), m AS (SELECT max(us) - {_DAY} AS mark FROM l)
SELECT CAST(day * 86400 AS BIGINT) AS start, count(*) AS n, count(*) FILTER (WHERE fb) AS n_fallback, count(*) FILTER (WHERE ot) AS n_off_topic, round(avg(lat), 6) AS latency_ms FROM w, m GROUP BY day, mark HAVING (day + 1) * {_DAY} <= mark"""
)
def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each day of the growing log; a day is told when no row of it can come late any more."""
    path, user = scratch.scratch_path(spark, "log"), F.col("user_id")
    at = F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = table(spark, sf_dir, "events").select(at.alias("timestamp"), (user % 5 == 0).alias("fallback"), (user % 7 == 0).alias("off_topic"), F.floor(F.col("value") * 40).cast("int").alias("latency_ms"))
    S.append_log(rows, path)
    out = ST.windowed_rates(ST.audit_stream(spark, path), "1 day", "1 day")
    return streamed(spark, out.select(F.unix_seconds("window.start").alias("start"), "n", "n_fallback", "n_off_topic", F.round("latency_ms", 6).alias("latency_ms")), "rates")


@query(
    f"""WITH l AS (SELECT epoch_us(ts) AS us, CAST(floor(value * 40) AS INTEGER) AS lat FROM events WHERE value IS NOT NULL), w AS (SELECT us // {_DAY} AS day, lat FROM l), m AS (SELECT max(us) - {_DAY} AS mark FROM l)
SELECT CAST(day * 86400 AS BIGINT) AS start, count(*) AS n, true AS near FROM w, m GROUP BY day, mark HAVING (day + 1) * {_DAY} <= mark"""
)
def audit_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median and the 95th percentile of each day's latencies as a stream keeps them in sketches, and whether their ranks are within a
    hundredth of what is asked for, against all of the day's values."""
    path = scratch.scratch_path(spark, "latencies")
    at = F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = table(spark, sf_dir, "events").select(at.alias("timestamp"), F.floor(F.col("value") * 40).cast("int").alias("latency_ms"))
    S.append_log(rows, path)
    shares = {"p50": 0.5, "p95": 0.95}
    out = ST.windowed_percentiles(ST.audit_stream(spark, path), "latency_ms", shares, "1 day", "1 day")
    told = streamed(spark, out.select(F.unix_seconds("window.start").alias("start"), "n", *shares), "percentiles")
    values = rows.where("latency_ms is not null").select((F.floor(F.unix_seconds(F.to_timestamp("timestamp")) / 86400) * 86400).alias("start"), "latency_ms")
    ranks = told.join(values, "start").groupBy("start", "n").agg(*[F.count_if(F.col("latency_ms") < F.col(c)).alias(f"{c}_lo") for c in shares], *[F.count_if(F.col("latency_ms") <= F.col(c)).alias(f"{c}_hi") for c in shares])
    near = [(F.col(f"{c}_lo") <= (s + 0.01) * F.col("n")) & (F.col(f"{c}_hi") >= (s - 0.01) * F.col("n")) for c, s in shares.items()]
    return ranks.select("start", "n", (near[0] & near[1]).alias("near"))
