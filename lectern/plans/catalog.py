"""The engine's operators as queries over the test tables, each with SQL of the same rows where SQL can express it.

The tables stand in for manuals: documents for chunks (source as model or document), benchmark items for user queries, part and
lineitem for figures, events for the audit log. All queries read whole tables; the vectors whose id is divisible by 100 are the
stated set of dense queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import fuzzy
from ..functions import text as T
from ..operators import answers as A
from ..operators import evaluate as E
from ..operators import followup as FU
from ..operators import ingest as I
from ..operators import query as Q
from ..operators import retrieval as R
from ..sources import corpus as SC
from ..sources import store as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def dense_lists(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.knn(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), "embedding"), k)


def lexical_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


_KNN = """
kq AS (SELECT vec_id // 100 AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
ks AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) /
        (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS similarity FROM embeddings, kq),
kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM ks),
knn AS (SELECT * FROM kr WHERE rank <= 8)"""

_BM25 = r"""
bw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
bt AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM bw),
bp AS (SELECT doc_id, dl, term, count(*) AS tf FROM bt GROUP BY ALL),
tot AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM bw),
bd AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
bi AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM bd, tot),
bm AS (SELECT avg(raw) AS mean FROM bi),
bq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
bs AS (SELECT query_id, doc_id AS chunk_id, round(sum(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf), 6) AS score
       FROM bp JOIN bi USING (term) JOIN bq USING (term), bm, tot GROUP BY query_id, doc_id),
br AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bs),
bm25 AS (SELECT * FROM br WHERE rank <= 8)"""

_FUSED = """
fu AS (SELECT query_id, chunk_id, rank, 0.6 AS w, true AS d FROM knn UNION ALL SELECT query_id, chunk_id, rank, 0.4, false FROM bm25),
fs AS (SELECT query_id, chunk_id, round(sum(CAST(w AS DOUBLE) / (60 + rank)), 6) AS score, min(CASE WHEN d THEN rank END) AS dense_rank, min(CASE WHEN NOT d THEN rank END) AS lexical_rank FROM fu GROUP BY query_id, chunk_id),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS INTEGER) AS rank FROM fs),
fused AS (SELECT * FROM fr WHERE rank <= 5)"""


@query(f"WITH {_KNN} SELECT query_id, chunk_id, similarity, rank FROM knn")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_lists(spark, sf_dir)


@query(f"WITH {_KNN} SELECT query_id, max(similarity) AS relevance, max(similarity) < 0.8 AS off_topic FROM knn WHERE chunk_id <> query_id * 100 GROUP BY query_id")
def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = dense_lists(spark, sf_dir)
    return R.gate(near.select("query_id").distinct(), near.where(F.col("chunk_id") != F.col("query_id") * 100))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_lists(spark, sf_dir)


@query(f"WITH {_KNN}, {_BM25}, {_FUSED} SELECT query_id, chunk_id, score, rank, coalesce(dense_rank, 0) AS dense_rank, coalesce(lexical_rank, 0) AS lexical_rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.top_fused(R.fuse(dense_lists(spark, sf_dir), lexical_lists(spark, sf_dir)))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dense_rank", "lexical_rank")})


@query(
    f"""WITH {_KNN}, {_BM25}, m AS (SELECT doc_id AS chunk_id, lang AS model FROM documents),
w AS (SELECT DISTINCT query_id, CASE query_id % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'xx' END AS wanted FROM bm25),
u AS (SELECT 0 AS list, query_id, chunk_id, rank FROM knn UNION ALL SELECT 1, query_id, chunk_id, rank FROM bm25),
x AS (SELECT u.*, model, coalesce(lower(model) = lower(wanted), false) AS fits FROM u LEFT JOIN m USING (chunk_id) LEFT JOIN w USING (query_id)),
y AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_ FROM x)
SELECT list, query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, list ORDER BY rank) AS INTEGER) AS rank FROM y WHERE fits OR NOT any_"""
)
def model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("model"))
    lexical = lexical_lists(spark, sf_dir)
    wanted = lexical.select("query_id").distinct().withColumn("wanted", F.when(F.col("query_id") % 3 == 0, "DE").when(F.col("query_id") % 3 == 1, "xx"))
    lists = [x.select("query_id", "chunk_id", "rank").join(model, "chunk_id", "left") for x in (dense_lists(spark, sf_dir), lexical)]
    a, b = R.filter_model(*lists, wanted)
    return a.withColumn("list", F.lit(0)).unionByName(b.withColumn("list", F.lit(1))).select("list", "query_id", "chunk_id", "rank")


_VERSION = "list_transform(list_filter(list_transform(string_split(replace({0}, '-', '.'), '.'), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda p: p <> ''), lambda p: CAST(p AS INTEGER))"
_LATEST = f"""v AS (SELECT p_brand AS doc_id, 'v' || (p_size // 10) || '.' || (p_size % 10) || '-r' || (p_partkey % 3) AS version, p_partkey AS pos FROM part),
vp AS (SELECT *, {_VERSION.format("version")} AS parts FROM v),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY parts DESC, pos) AS n FROM vp) WHERE n = 1)"""


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    version = F.concat(F.lit("v"), F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"), F.lit("-r"), (F.col("p_partkey") % 3).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), version.alias("version"), F.col("p_partkey").alias("pos"), "p_retailprice")


@query(f"WITH {_LATEST} SELECT doc_id, version, array_to_string(parts, '.') AS parts FROM latest")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_versions(manuals(spark, sf_dir)).withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), "."))


@query(
    f"""WITH {_LATEST} SELECT pos, doc_id, vp.version, vp.parts < latest.parts AS is_stale, round(CASE WHEN vp.parts < latest.parts THEN p_retailprice * 0.98 ELSE p_retailprice END, 6) AS score
FROM (SELECT vp.*, p_retailprice FROM vp JOIN part ON pos = p_partkey) vp JOIN (SELECT doc_id, parts FROM latest) latest USING (doc_id)"""
)
def stale_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manuals(spark, sf_dir)
    out = R.penalise_stale(m.withColumn("score", F.col("p_retailprice")), R.latest_versions(m))
    return out.select("pos", "doc_id", "version", "is_stale", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_KNN}, {_BM25}, {_FUSED}, b AS (SELECT query_id, source AS model, max(score) AS best FROM fused JOIN documents ON chunk_id = doc_id WHERE source IS NOT NULL GROUP BY ALL),
t AS (SELECT *, max(best) OVER (PARTITION BY query_id) AS top FROM b),
c AS (SELECT query_id, coalesce(list_sort(list(model) FILTER (WHERE top > 0 AND best >= 0.85 * top)), []) AS m FROM t GROUP BY query_id)
SELECT query_id, len(m) > 1 AS ambiguous, CASE WHEN len(m) > 1 THEN array_to_string(m, ',') ELSE '' END AS candidate_models FROM c"""
)
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("model"))
    return R.ambiguity(rrf_fusion(spark, sf_dir).join(model, "chunk_id")).withColumn("candidate_models", F.array_join("candidate_models", ","))


# documents as pages: a source is a manual, its texts are the pages in order of doc_id.
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = I.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "page").select(F.col("doc_id").alias("_d"), "page")
    d = docs(spark, sf_dir)
    return d.join(place, d["doc_id"] == place["_d"]).select(F.col("source").alias("doc_id"), "page", "text")


_PAGES = """pages_ AS (SELECT source AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page, coalesce(text, '') AS text FROM documents),
lines_ AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos FROM pages_)"""
_REPEATED = f"""{_PAGES}, np AS (SELECT doc_id, count(*) AS n_pages FROM pages_ GROUP BY doc_id),
dl AS (SELECT DISTINCT doc_id, page, trim(line) AS line FROM lines_ WHERE trim(line) <> '' AND length(trim(line)) <= 120),
repeated AS (SELECT doc_id, line FROM (SELECT doc_id, line, count(*) AS n FROM dl GROUP BY ALL) JOIN np USING (doc_id) WHERE n > 0.05 * n_pages)"""


@query(f"WITH {_REPEATED} SELECT * FROM repeated")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.boilerplate(pages(spark, sf_dir), 0.05)


@query(
    f"""WITH {_REPEATED}, k AS (SELECT l.* FROM lines_ l LEFT JOIN repeated r ON l.doc_id = r.doc_id AND trim(l.line) = r.line
  WHERE r.line IS NULL AND NOT coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(l.line), '[0-9]{{1,9}}') THEN trim(l.line) END AS INTEGER) BETWEEN l.page - 1 AND l.page + 1, false)),
t AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM k GROUP BY ALL)
SELECT p.doc_id, p.page, trim(coalesce(t.text, ''), chr(32) || chr(10) || chr(9) || chr(13)) AS text FROM pages_ p LEFT JOIN t USING (doc_id, page)"""
)
def strip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return I.strip_lines(p, I.boilerplate(p, 0.05))


@query(
    f"""WITH {_PAGES}, e AS (SELECT *, regexp_full_match(line, '[A-ZÀ-Ý]\\S* .{{3,60}}[.]') AS head FROM lines_),
k AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY pos) AS k FROM e),
p AS (SELECT doc_id, page, k, min(CASE WHEN head THEN trim(line) END) AS title, trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos), ''), chr(32) || chr(10) || chr(9) || chr(13)) AS body FROM k GROUP BY doc_id, page, k),
q AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS INTEGER) AS seg, title, body FROM p WHERE body <> '')
SELECT * FROM q UNION ALL SELECT doc_id, page, 0, NULL, text FROM pages_ WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = pages_.doc_id AND q.page = pages_.page)"""
)
def header_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.headers(pages(spark, sf_dir), r"[A-ZÀ-Ý]\S* .{3,60}[.]")


_CARRY = """s AS (SELECT conv_id AS doc_id, CAST(turn // 2 AS INTEGER) AS page, CAST(turn % 2 AS INTEGER) AS seg, CASE WHEN role = 'system' OR length(coalesce(text, '')) % 3 = 0 THEN left(coalesce(text, ''), 20) END AS title, coalesce(text, '') AS body FROM conversations),
l AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s)"""


@query(f"WITH {_CARRY} SELECT doc_id, page, seg, CASE WHEN seg = 0 AND title IS NULL AND last IS NOT NULL THEN last ELSE title END AS title, seg = 0 AND title IS NULL AND last IS NOT NULL AS is_continuation FROM l")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when((F.col("role") == "system") | (F.length("text") % 3 == 0), F.substring("text", 1, 20))
    s = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("page"), (F.col("turn") % 2).cast("int").alias("seg"), title.alias("title"), F.col("text").alias("body"))
    return I.carry_titles(s).select("doc_id", "page", "seg", "title", "is_continuation")


@query(
    f"""WITH {_PAGES}, ab AS (SELECT doc_id, page, trim(line) AS t, count(*) AS n FROM lines_ WHERE pos % 5 = 3 GROUP BY ALL),
x AS (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, l.page, trim(l.line) ORDER BY l.pos) <= coalesce(n, 0) AS moved FROM lines_ l LEFT JOIN ab ON l.doc_id = ab.doc_id AND l.page = ab.page AND trim(l.line) = ab.t)
SELECT doc_id, page, pos, line, moved, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY NOT moved, pos) AS INTEGER) AS place FROM x"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.lines_of(pages(spark, sf_dir))
    return I.reading_order(lines, lines.where("pos % 5 = 3").select("doc_id", "page", F.trim("line").alias("text"))).select("doc_id", "page", "pos", "line", "moved", "place")


@query(
    """WITH t AS (SELECT o_custkey % 50 AS doc_id, CAST(year(o_orderdate) AS INTEGER) AS page, CAST(dayofyear(o_orderdate) AS DOUBLE) AS y, 0 AS kind, o_orderkey AS pos, o_orderpriority AS title, NULL AS image_id FROM orders),
f AS (SELECT l_suppkey % 50 AS doc_id, CAST(year(l_shipdate) AS INTEGER) AS page, CAST(dayofyear(l_shipdate) AS DOUBLE) AS y, 1 AS kind, l_orderkey * 10 + l_linenumber AS pos, NULL AS title, l_orderkey || '-' || l_linenumber AS image_id FROM lineitem),
u AS (SELECT * FROM t UNION ALL SELECT * FROM f),
w AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, y, kind, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM u)
SELECT doc_id, page, image_id, pos, found AS section FROM w WHERE kind = 1 AND found IS NOT NULL"""
)
def asof_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda c: [F.year(c).alias("page"), F.dayofyear(c).cast("double").alias("y")]
    titles = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), *place("o_orderdate"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"))
    figures = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("doc_id"), *place("l_shipdate"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("image_id"))
    return I.figures_by_section(titles, figures)


@query(r"SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-ÿ]+')) AS word FROM documents) WHERE NOT regexp_matches(word, '[0-9÷]') GROUP BY word")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.term_frequency(docs(spark, sf_dir))


@query(r"""WITH t AS (SELECT text FROM documents UNION ALL SELECT p_name || ': errore ' || chr(CAST(65 + p_partkey % 3 AS INTEGER)) || CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || (60 + p_size) || ', x' || p_size FROM part)
SELECT DISTINCT upper(replace(code, '-', '')) AS code FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '(?i)\b[A-Z]-?[0-9]{2,3}\b')) AS code FROM t)""")
def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in documents and in what is said of parts."""
    letter, size = F.char((F.lit(65) + F.col("p_partkey") % 3).cast("int")), F.col("p_size")
    said = F.concat("p_name", F.lit(": errore "), letter, F.when(size % 2 == 0, "-").otherwise(""), (size + 60).cast("string"), F.lit(", x"), size.cast("string"))
    return Q.indexed_codes(docs(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "part").select(said.alias("text"))))


_VOCAB = "vocab AS (SELECT unnest(['the', 'of the', 'and', 'is the', 'que', 'de la', 'der die', 'und', 'la', 'in the of']) AS term)"
_TOKENS = r"tk AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-ÿ]+') AS tokens FROM benchmark)"
TERMS = ["the", "of the", "and", "is the", "que", "de la", "der die", "und", "la", "in the of"]


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(f"WITH {_VOCAB}, {_TOKENS} SELECT DISTINCT query_id, term FROM tk, vocab WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || term || ' ')")
def phrase_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.exact_terms(query_tokens(spark, sf_dir), spark.createDataFrame([(t,) for t in TERMS], "term string"))


@query(
    rf"""WITH {_TOKENS}, voc AS (SELECT DISTINCT unnest([array_to_string(tokens[1:2], ' '), array_to_string(tokens[3:5], ' '), tokens[6]]) AS term FROM tk WHERE len(tokens) >= 6),
td AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-ÿ]+'), ' ') || ' ' AS said FROM documents)
SELECT doc_id, term FROM td JOIN voc ON contains(said, ' ' || term || ' ')"""
)
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of benchmark items, two, three and one at a time, in all documents."""
    words = query_tokens(spark, sf_dir).where(F.size("tokens") >= 6)
    term = F.explode(F.array(F.array_join(F.slice("tokens", 1, 2), " "), F.array_join(F.slice("tokens", 3, 3), " "), F.col("tokens")[5]))
    return Q.text_terms(docs(spark, sf_dir), words.select(term.alias("term")).distinct())


@query(
    f"""WITH {_VOCAB}, {_TOKENS}, fam AS (SELECT * FROM (VALUES (0, 'the', 0), (0, 'of the', 1), (0, 'is the', 2), (1, 'und', 0), (1, 'der die', 1), (1, 'the', 2), (2, 'la', 0), (2, 'de la', 1)) f(family, term, place)),
m AS (SELECT DISTINCT query_id, term FROM tk, vocab WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || term || ' ')),
own AS (SELECT term, min(family) AS family FROM fam GROUP BY term)
SELECT query_id, fam.term, family, place FROM (SELECT DISTINCT query_id, family FROM m JOIN own USING (term)) JOIN fam USING (family)"""
)
def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "the", 0), (0, "of the", 1), (0, "is the", 2), (1, "und", 0), (1, "der die", 1), (1, "the", 2), (2, "la", 0), (2, "de la", 1)]
    return Q.expansion(phrase_terms(spark, sf_dir), spark.createDataFrame(rows, "family int, term string, place int"))


# The vocabulary of the fuzzy queries: all of the benchmark's own two- and three-word runs with their first letter doubled.
def fuzzy_vocabulary(windows: DataFrame) -> DataFrame:
    return windows.select(F.concat(F.substring("gram", 1, 1), "gram").alias("term")).distinct()


def _lcs(pairs: str, a: str, b: str) -> str:
    """SQL of lcs_(a, b, lcs): the longest common subsequence of each pair of strings, a row of the dynamic programme a step."""
    return f"""lp AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {pairs}),
lr AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS r, string_split(b, '') AS y FROM lp UNION ALL
  SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], CASE WHEN y[k] = substr(a, i + 1, 1) THEN r[k] + 1 ELSE 0 END))))), y FROM lr WHERE i < length(a)),
lcs_ AS (SELECT a, b, r[length(b) + 1] AS lcs FROM lr WHERE i = length(a))"""


_FUNCTION_WORDS = "['" + "', '".join(w.replace("'", "''") for w in sorted(K.FUNCTION_WORDS)) + "']"


_OWN_TERMS = "voc AS (SELECT DISTINCT left(gram, 1) || gram AS term, n FROM win)"


def _fuzzy(threshold: float, tokens: str = _TOKENS, vocabulary: str = _OWN_TERMS, source: str = "tk") -> str:
    """SQL of win(query_id, start, n, gram) and best(gram, term, ratio). Lengths and DuckDB's distance over bytes, of which a letter
    of these texts has two at most, leave out pairs that can't reach the threshold."""
    most = f"{(1 - threshold / 100):.4f} * (length(gram) + length(term)) + 0.000001"
    return f"""{tokens}, win AS (SELECT query_id, CAST(start AS INTEGER) AS start, n, array_to_string(tokens[start + 1 : start + n], ' ') AS gram FROM (SELECT query_id, tokens, n, unnest(range(len(tokens) - n + 1)) AS start FROM {source}, (VALUES (2), (3)) z(n) WHERE len(tokens) >= n)),
{vocabulary}, dw AS (SELECT DISTINCT gram, n FROM win WHERE length(gram) >= {K.LEAST_WINDOW_CHARS}),
fp AS (SELECT gram, term, n FROM dw JOIN voc USING (n) WHERE 200.0 * least(length(gram), length(term)) >= {threshold} * (length(gram) + length(term)) AND levenshtein(gram, term) <= 2 * ({most})),
{_lcs("fp", "gram", "term")},
fr AS (SELECT gram, term, n, 200.0 * lcs / (length(gram) + length(term)) AS ratio FROM fp JOIN lcs_ ON gram = a AND term = b),
best AS (SELECT gram, term, CAST(ratio AS DOUBLE) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY ratio DESC, term) AS k FROM fr WHERE ratio >= {threshold}) WHERE k = 1
  AND len(list_filter(list_zip(string_split(gram, ' '), string_split(term, ' ')), lambda x: x[1] <> x[2] AND list_contains({_FUNCTION_WORDS}, x[1]))) = 0)"""


#: SQL of greedy_(query_id, start, n, term): the windows that are taken.
_GREEDY = """cand AS (SELECT query_id, start, n, term, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, start, term) AS k FROM win JOIN best USING (gram)),
gr AS (SELECT query_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT query_id FROM cand) UNION ALL
  SELECT g.query_id, c.k, CASE WHEN list_has_any(used, range(start, start + n)) THEN used ELSE list_concat(used, range(start, start + n)) END, CASE WHEN list_has_any(used, range(start, start + n)) THEN taken ELSE list_append(taken, c.k) END FROM gr g JOIN cand c ON g.query_id = c.query_id AND c.k = g.k + 1),
last AS (SELECT query_id, arg_max(taken, k) AS taken FROM gr GROUP BY query_id),
greedy_ AS (SELECT c.query_id, start, n, term FROM cand c JOIN last l ON c.query_id = l.query_id AND list_contains(taken, c.k))"""


@query(f"WITH RECURSIVE {_fuzzy(88.0)} SELECT gram, term, round(ratio, 6) AS ratio FROM best")
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = Q.ngrams(query_tokens(spark, sf_dir), K.WINDOW_WORDS)
    return Q.best_matches(windows, fuzzy_vocabulary(windows)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH RECURSIVE {_fuzzy(80.0)}, {_GREEDY} SELECT * FROM greedy_")
def greedy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = Q.ngrams(query_tokens(spark, sf_dir), K.WINDOW_WORDS)
    return Q.greedy(windows.join(Q.best_matches(windows, fuzzy_vocabulary(windows), 80.0), "gram").select("query_id", "start", "n", "term"))


#: DuckDB's distance counts bytes: letters beyond ASCII become single ones for it.
_BYTES = "translate({0}, '" + "".join(map(chr, range(0xE0, 0x100))) + "', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')"


def swapped(word: Column) -> Column:
    """A word with its first two letters swapped."""
    return F.concat(F.substring(word, 2, 1), F.substring(word, 1, 1), F.substr(word, F.lit(3)))


# The conversations' words stand in for a language's lexicon, with frequencies on the Zipf scale.
_LANGUAGE = r"""lw AS (SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-ÿ]+')) AS word FROM conversations) WHERE NOT regexp_matches(word, '[0-9÷]') GROUP BY word),
lz AS (SELECT word, round(log10(c * 1000000000.0 / (SELECT sum(c) FROM lw)), 2) AS zipf FROM lw),
lang AS (SELECT word, zipf AS freq FROM lz WHERE regexp_full_match(word, '\p{L}+') AND zipf >= 1.0 ORDER BY zipf DESC, word LIMIT 300000)"""


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.term_frequency(table(spark, sf_dir, "conversations"))
    total = w.agg(F.sum("freq").alias("total"))
    return SC.language_words(w.join(F.broadcast(total)).select("word", F.round(F.log10(F.col("freq") * 1e9 / F.col("total")), 2).alias("zipf")))


@query(f"WITH {_LANGUAGE} SELECT * FROM lang")
def language_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(spark, sf_dir)


_MANUAL = r"m AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-ÿ]+')) AS word FROM documents) WHERE NOT regexp_matches(word, '[0-9÷]') GROUP BY word)"


def _corrections(words: str) -> str:
    """SQL of fixes(word, corrected) for words(word). Which letters two words have differs by two for each edit at most."""
    letters = "list_reduce(list_transform(string_split(word, ''), lambda x: CAST(1 AS BIGINT) << CAST(unicode(x) % 61 AS BIGINT)), lambda a, b: a | b)"
    return f"""uk AS (SELECT DISTINCT word, {letters} AS has, CASE WHEN length(word) <= {K.SHORT_WORD_CHARS} THEN {K.EDITS_SHORT} ELSE {K.EDITS_LONG} END AS lim FROM {words} WHERE length(word) >= {K.LEAST_CORRECTED_CHARS} AND NOT regexp_matches(word, '[0-9]') AND word NOT IN (SELECT word FROM m) AND word NOT IN (SELECT word FROM lang)),
vo AS (SELECT word AS hit, {letters} AS own, CAST(freq AS DOUBLE) AS freq, 0 AS list FROM m UNION ALL SELECT word, {letters}, freq, 1 FROM lang),
co AS (SELECT uk.word, hit, freq, list, lim, damerau_levenshtein({_BYTES.format('uk.word')}, {_BYTES.format('hit')}) AS d FROM uk JOIN vo ON abs(length(uk.word) - length(hit)) <= lim AND length(hit) >= {K.LEAST_CORRECTED_CHARS - K.EDITS_LONG} AND bit_count(xor(has, own)) <= 2 * lim),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, list ORDER BY d, freq DESC, hit) AS k FROM co WHERE d <= lim) WHERE k = 1),
fixes AS (SELECT word, hit AS corrected FROM (SELECT word, hit, row_number() OVER (PARTITION BY word ORDER BY d, list) AS k FROM cb) WHERE k = 1)"""


@query(
    rf"""WITH {_MANUAL}, {_LANGUAGE}, q AS (SELECT DISTINCT substr(word, 2, 1) || left(word, 1) || substr(word, 3) AS word FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-ÿ]+')) AS word FROM benchmark) WHERE length(word) >= 5),
{_corrections("q")} SELECT * FROM fixes"""
)
def typo_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = query_tokens(spark, sf_dir).select(F.explode("tokens").alias("word")).where(F.length("word") >= 5)
    said = word.select(swapped(F.col("word")).alias("word")).distinct()
    return Q.corrections(said, Q.term_frequency(docs(spark, sf_dir)), language(spark, sf_dir))


@query(
    f"""WITH {_TOKENS}, mo AS (SELECT array_to_string(tokens[3:4], '') AS compact, min_by(upper(array_to_string(tokens[3:4], '-')), query_id) AS model FROM tk WHERE len(tokens) >= 4 GROUP BY ALL),
st AS (SELECT query_id, tokens, unnest(range(1, len(tokens) + 1)) AS start FROM tk), rn AS (SELECT query_id, tokens, start, unnest(range(1, len(tokens) - start + 2)) AS n FROM st),
ru AS (SELECT query_id, start, n, array_to_string(tokens[start : start + n - 1], '') AS compact FROM rn)
SELECT query_id, model FROM (SELECT query_id, model, row_number() OVER (PARTITION BY query_id ORDER BY start, n, compact) AS k FROM ru JOIN mo USING (compact)) WHERE k = 1"""
)
def compact_model_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's third and fourth word as the name of a model."""
    q = query_tokens(spark, sf_dir)
    names = q.where(F.size("tokens") >= 4).select(F.upper(F.array_join(F.slice("tokens", 3, 2), "-")).alias("model"), F.col("query_id").alias("pos"))
    return Q.mentioned_model(q, Q.indexed_models(names))


_TITLES = r"""ti AS (SELECT doc_id AS pos, text, regexp_replace(regexp_replace(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '(?i)^\s*(?:\d{1,2}(?:\.\d{1,2}){0,2}[.)]?|CAPITOLO\s+\d+|SEZIONE\s+\d+)\s*[-–:]?\s*', ''), '^[ .:\-–\t]+|[ .:\-–\t]+$', '', 'g'), '\s{2,}', ' ', 'g') AS title FROM documents),
se AS (SELECT title, sum(length(text)) AS size, min(pos) AS pos FROM ti WHERE length(title) BETWEEN 8 AND 70 AND NOT regexp_matches(title, '(?i)^(sommario|indice|appendice|glossario|premessa|introduzione|note|informazioni agli utenti|descrizione generale|caratteristiche tecniche)\b') AND regexp_matches(title, '\p{L}') GROUP BY title)"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.split("text", "\n")[0].alias("section_title"), "text", F.col("doc_id").alias("pos"))


@query(f"WITH {_TITLES} SELECT title, CAST(size AS BIGINT) AS size, pos FROM se")
def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sections(titled(spark, sf_dir))


@query(
    f"""WITH {_TITLES} SELECT CAST(row_number() OVER (ORDER BY size DESC, pos) AS INTEGER) AS place, title, CAST(size AS BIGINT) AS size,
  'Come si esegue: ' || array_to_string(list_transform(string_split_regex(title, '\\s+'), lambda w: CASE WHEN upper(regexp_replace(w, '^[()\\[\\]]+|[()\\[\\]]+$', '', 'g')) IN ('IVA','DGFE','MMC','POS','PC','X','Z','WIFI','RCH') THEN w ELSE lower(w) END), ' ') || '?' AS question
FROM se QUALIFY place <= 3"""
)
def section_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_sections(titled(spark, sf_dir))


@query(
    """WITH o AS (SELECT doc_id, list_filter([lang, source], lambda x: x IS NOT NULL) AS own, ['en', 'src1', 'src2', 'src3'] AS idx FROM documents),
a AS (SELECT doc_id, list_concat(own, idx) AS l FROM o)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS faqs FROM a"""
)
def faq_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.filter(F.array("lang", "source"), lambda x: x.isNotNull())
    return docs(spark, sf_dir).select("doc_id", F.array_join(A.fill_up(own, F.array(*[F.lit(x) for x in ("en", "src1", "src2", "src3")])), ",").alias("faqs"))


# labels as steps of answers: an answer for each quality and hundred of documents, retrieved chunks are the documents of even id.
_STEPS = """st AS (SELECT CAST(doc_id // 10 AS BIGINT) AS answer_id, CAST(doc_id % 10 AS INTEGER) AS number, doc_id AS chunk_id FROM labels),
rt AS (SELECT DISTINCT CAST(doc_id // 10 AS BIGINT) AS answer_id, doc_id AS chunk_id FROM documents WHERE (doc_id // 10) % 3 <> 0 AND doc_id % 2 = 0)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.expr("doc_id div 10").alias("answer_id"), (F.col("doc_id") % 10).cast("int").alias("number"), F.lit("step").alias("text"), F.col("doc_id").alias("chunk_id"))


@query(f"WITH {_STEPS} SELECT s.answer_id, count(*) AS n_steps, count(r.chunk_id) AS n_kept, count(r.chunk_id) = 0 AS fallback FROM st s LEFT JOIN rt r ON s.answer_id = r.answer_id AND s.chunk_id = r.chunk_id GROUP BY s.answer_id")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrieved = docs(spark, sf_dir).where("(doc_id div 10) % 3 <> 0 and doc_id % 2 = 0").select(F.expr("doc_id div 10").alias("answer_id"), F.col("doc_id").alias("chunk_id"))
    s = steps(spark, sf_dir)
    return A.ground(s, s, retrieved)[2]


@query(
    """SELECT CAST(l.doc_id // 10 AS BIGINT) AS answer_id, CAST(row_number() OVER (PARTITION BY l.doc_id // 10 ORDER BY min(l.doc_id % 10), l.doc_id) AS INTEGER) AS place, l.doc_id AS chunk_id, left(any_value(coalesce(d.text, '')), 220) AS snippet,
  nullif(any_value(d.source), '') AS section_title, any_value(coalesce(d.lang, '') = 'de') AS ocr_used FROM labels l JOIN documents d USING (doc_id) GROUP BY l.doc_id"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("section_title"), (F.coalesce("lang", F.lit("")) == "de").alias("ocr_used"))
    return A.citations(steps(spark, sf_dir).drop("text"), chunks)


@query(
    """WITH f AS (SELECT p_brand AS "group", p_partkey AS image_id, p_retailprice AS area, p_partkey AS pos FROM part),
x AS (SELECT *, bool_or(area >= 1900) OVER (PARTITION BY "group") AS any_, row_number() OVER (PARTITION BY "group" ORDER BY area DESC, pos) AS k FROM f)
SELECT "group", image_id, area, CAST(row_number() OVER (PARTITION BY "group" ORDER BY area DESC, pos) AS INTEGER) AS place FROM x WHERE CASE WHEN any_ THEN area >= 1900 ELSE k = 1 END"""
)
def figure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("image_id"), F.col("p_retailprice").alias("area"), F.col("p_partkey").alias("pos"))
    return A.significant_figures(f, 1900.0).drop("pos")


@query(
    """WITH f AS (SELECT l_orderkey AS answer_id, l_partkey AS image_id, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT answer_id, place, image_id FROM (SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY pos, image_id) AS INTEGER) AS place, image_id FROM f) WHERE place <= 3"""
)
def cap_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_images(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("image_id")), 3)


@query(
    """SELECT l_orderkey AS doc_id, CAST(coalesce(CASE WHEN l_returnflag <> 'N' THEN l_linenumber % 3 END, 1) AS INTEGER) AS page, l_linenumber AS image_id,
  count(*) OVER (PARTITION BY l_orderkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_linenumber % 3 END, 1)) AS on_page FROM lineitem"""
)
def figures_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") % 3).cast("int").alias("page"), F.lit(1).alias("chunk_page"), F.col("l_linenumber").alias("image_id"))
    return A.figures_per_page(f).select("doc_id", "page", "image_id", "on_page")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: values as latencies, types as flags."""
    e = table(spark, sf_dir, "events")
    ids = lambda c: F.when(c, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.floor(F.col("value") * 40).cast("int").alias("latency_ms"), F.floor(F.col("value") * 12).cast("int").alias("retrieval_ms"), F.when(F.col("user_id") % 4 != 0, F.floor(F.col("value") * 20).cast("int")).alias("time_to_first_token_ms"),
        (F.col("user_id") % 5 == 0).alias("fallback"), (F.col("user_id") % 7 == 0).alias("off_topic"), (F.col("event_id") % 3).alias("n_images"), ids(F.col("event_id") % 9 != 0).alias("retrieved_chunk_ids"), ids(F.col("event_id") % 11 == 0).alias("corrections"),
    )


_NEAREST = "coalesce(list_sort(list({0}) FILTER (WHERE {0} IS NOT NULL))[CAST(least(floor(count({0}) * {1}), count({0}) - 1) AS BIGINT) + 1], 0)"
_LOG = """lg AS (SELECT CAST(floor(value * 40) AS INTEGER) AS lat, CAST(floor(value * 12) AS INTEGER) AS ret, CASE WHEN user_id % 4 <> 0 THEN CAST(floor(value * 20) AS INTEGER) END AS tt,
  user_id % 5 = 0 AS fb, user_id % 7 = 0 AS ot, event_id % 3 AS ni, event_id % 9 <> 0 AS hit, event_id % 11 = 0 AS cor FROM events)"""


@query(
    f"""WITH {_LOG} SELECT count(*) AS n_queries, round(count(tt) / count(*), 3) AS ttft_measured_rate,
  round(coalesce(count(*) FILTER (WHERE ret < 2000 AND NOT ot) / nullif(count(*) FILTER (WHERE NOT ot), 0), 0), 3) AS retrieval_within_budget_rate,
  round(coalesce(count(*) FILTER (WHERE lat < 8000 AND NOT ot) / nullif(count(*) FILTER (WHERE NOT ot), 0), 0), 3) AS e2e_within_budget_rate,
  round(count(*) FILTER (WHERE fb) / count(*), 3) AS fallback_rate, round(count(*) FILTER (WHERE ot) / count(*), 3) AS off_topic_rate,
  round(count(*) FILTER (WHERE ni > 0) / count(*), 3) AS images_attached_rate, round(count(*) FILTER (WHERE hit) / count(*), 3) AS hit_rate_any_chunk, round(count(*) FILTER (WHERE cor) / count(*), 3) AS typo_corrected_rate,
  {", ".join(_NEAREST.format(c, s) + f" AS {n}_{p}" for c, n in (("lat", "latency_ms"), ("ret", "retrieval_ms"), ("tt", "ttft_ms")) for s, p in ((0.5, "p50"), (0.95, "p95")))} FROM lg"""
)
def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.audit_metrics(audit_log(spark, sf_dir))


@query("SELECT CASE WHEN grouping(quality) = 0 THEN 'q' || quality END AS kind, count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS correct, round(avg(CAST(toxic = 0 AS INTEGER)), 3) AS accuracy FROM labels GROUP BY ROLLUP (quality)")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decisions(table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("kind"), (F.col("toxic") == 0).alias("ok")))


@query(
    f"""WITH {_KNN}, r AS (SELECT query_id, min(CASE WHEN a.label = b.label THEN rank END) AS first FROM (SELECT * FROM knn WHERE chunk_id <> query_id * 100) k JOIN embeddings a ON a.vec_id = chunk_id JOIN embeddings b ON b.vec_id = query_id * 100 GROUP BY query_id)
SELECT count(*) AS n, {", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_{k}" for k in (1, 3, 5))}, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM r"""
)
def hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = dense_lists(spark, sf_dir).where(F.col("chunk_id") != F.col("query_id") * 100)
    near = near.join(label.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").join(label.select((F.expr("vec_id div 100")).alias("query_id"), F.col("vec_id").alias("q"), F.col("label").alias("own")).where("q % 100 = 0"), "query_id")
    return E.hit_rates(E.hits(near.withColumn("relevant", F.col("label") == F.col("own"))))


@query("WITH p AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS m, max(1 + l_orderkey % 3) AS e FROM lineitem GROUP BY l_orderkey) SELECT CAST(sum(least(m, e)) AS BIGINT) AS found, CAST(sum(e) AS BIGINT) AS expected FROM p")
def figures_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.figures_found(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") == "R").alias("matches"), (1 + F.col("l_orderkey") % 3).alias("expected")))


@query(
    """WITH s AS (SELECT CASE label % 2 WHEN 0 THEN 'answerable' ELSE 'near' END AS kind, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings),
g AS (SELECT min(score) FILTER (WHERE kind = 'answerable') AS least_answerable, min(score) FILTER (WHERE kind = 'near') AS least_near, floor(CAST(0.0236 AS DOUBLE) * CAST(1.5 AS DOUBLE) * 10000) / 10000 AS margin FROM s)
SELECT *, least(floor((least_answerable - margin) * 10000) / 10000, floor(least_near * 10000) / 10000) AS threshold FROM g"""
)
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 2 == 0, "answerable").otherwise("near").alias("kind"), F.col("embedding")[0].cast("double").alias("score"))
    return E.thresholds(s, "answerable", "near", F.lit(0.0236))


@query(
    """WITH s AS (SELECT item_id AS id, CAST(length(coalesce(text, '')) AS DOUBLE) AS score FROM benchmark), d AS (SELECT unnest(range(2000)) AS draw), n AS (SELECT count(*) // 2 AS half FROM s),
x AS (SELECT draw, id, score, row_number() OVER (PARTITION BY draw ORDER BY md5('0-' || draw || '-' || id), id) <= half AS inn FROM s, d, n),
y AS (SELECT *, min(CASE WHEN inn THEN score END) OVER (PARTITION BY draw) - score AS gap FROM x)
SELECT CAST(draw AS INTEGER) AS draw, count(*) AS n_below, round(max(gap), 6) AS largest_gap FROM y WHERE NOT inn AND gap > 0 GROUP BY draw"""
)
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.resampled_gaps(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score")))


@query(
    """WITH o AS (SELECT source AS doc_id, lang AS version, doc_id AS pos, length(text) AS n FROM documents), nw AS (SELECT * FROM o WHERE version = 'de' AND pos % 2 = 0),
k AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.doc_id = o.doc_id AND nw.version = o.version))
SELECT * FROM k UNION ALL SELECT doc_id, version, pos + 1 + (SELECT coalesce(max(pos), -1) FROM k), n FROM nw"""
)
def upsert_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("version"), F.col("doc_id").alias("pos"), F.length("text").cast("long").alias("n"))
    return S.replace(old, old.where("version = 'de' and pos % 2 = 0"))


@query(
    """SELECT CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_suppkey ELSE o.s_suppkey END AS s_suppkey, CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_name ELSE o.s_name END AS s_name
FROM supplier o FULL JOIN (SELECT s_suppkey + 3 AS s_suppkey, s_name || ' II' AS s_name FROM supplier WHERE s_suppkey % 2 = 0) n ON o.s_suppkey = n.s_suppkey"""
)
def upsert_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return S.upsert(s, s.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 3).alias("s_suppkey"), F.concat("s_name", F.lit(" II")).alias("s_name")), ["s_suppkey"])


_ASK = "', '".join(w.replace("'", "''") for w in K.INTERROGATIVES)


@query(
    f"""WITH t AS (SELECT conv_id AS session, turn, coalesce(text, '') AS text, role = 'assistant' OR length(coalesce(text, '')) < 60 AS asks FROM conversations),
p AS (SELECT *, CASE WHEN lag(asks) OVER (PARTITION BY session ORDER BY turn) THEN lag(text) OVER (PARTITION BY session ORDER BY turn) END AS pending, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') AS w FROM t)
SELECT session, turn, pending, CASE WHEN pending <> '' AND len(w) > 0 AND NOT contains(trim(text), '?') AND len(w) <= 6 AND regexp_replace(lower(w[1]), '^[,;:]+|[,;:]+$', '', 'g') NOT IN ('{_ASK}')
  THEN regexp_replace(pending, '[ ?]+$', '') || ' — ' || trim(text) ELSE trim(text) END AS query FROM p"""
)
def followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", text.alias("text"), ((F.col("role") == "assistant") | (F.length(text) < 60)).alias("asks"))
    return FU.follow_up(t).select("session", "turn", "pending", "query")


@query("SELECT source, left(sha1(array_to_string(list_sort(list(CAST(doc_id AS VARCHAR))), '|')), 8) AS preview FROM documents GROUP BY source")
def preview_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(T.preview_name(F.collect_list(F.col("doc_id").cast("string"))).alias("preview"))


@query(
    f"""WITH {_BM25} SELECT query_id, string_agg('[chunk_id=' || chunk_id || ' | doc=' || source || ' | versione=' || coalesce(nullif(CASE WHEN lang <> 'en' THEN lang END, ''), 'n/d') || ' | pagina=' || n_chars || ' | sezione=n/d'
  || CASE WHEN lang = 'de' THEN ' | ATTENZIONE: testo ricavato via OCR, possibili imprecisioni' ELSE '' END || ']' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context
FROM bm25 JOIN documents ON chunk_id = doc_id GROUP BY query_id"""
)
def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    line = A.context_line(F.col("chunk_id").cast("string"), F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.col("n_chars").cast("string"), F.lit(None).cast("string"), F.col("lang") == "de", F.col("text"))
    return A.render_context(lexical_lists(spark, sf_dir).join(d.withColumnRenamed("doc_id", "chunk_id"), "chunk_id").select("query_id", "rank", line.alias("line")))


@query(
    """WITH x AS (SELECT source AS doc_id, lang, length(coalesce(text, '')) AS n, list_filter([CAST(n_chars % 3 AS VARCHAR), CAST(doc_id % 2 AS VARCHAR), CAST(n_chars % 3 AS VARCHAR)], lambda v: v IS NOT NULL) AS ids, doc_id AS pos FROM documents),
k AS (SELECT doc_id, pos, list_sort(list_distinct(ids)) AS key FROM x)
SELECT doc_id, pos, array_to_string(key, ',') AS key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM k) WHERE n = 1"""
)
def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.filter(F.array((F.col("n_chars") % 3).cast("string"), (F.col("doc_id") % 2).cast("string"), (F.col("n_chars") % 3).cast("string")), lambda v: v.isNotNull())
    g = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), ids.alias("image_ids"), F.col("doc_id").alias("pos"))
    return A.distinct_groups(g).select("doc_id", "pos", F.array_join("key", ",").alias("key"))


@query(
    """WITH x AS (SELECT length(coalesce(text, '')) AS n, lang <> 'en' AS t FROM documents)
SELECT count(*) AS n, min(n) AS least, max(n) AS greatest, round(avg(CAST(coalesce(t, false) AS INTEGER)), 3) AS titled_share, list_sort(list(n))[count(*) // 2 + 1] AS median FROM x"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.chunk_statistics(docs(spark, sf_dir).select("text", F.when(F.col("lang") != "en", F.col("lang")).alias("section_title")))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("n", "least", "greatest", "median")], "titled_share")


def typo_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.typos(query_tokens(spark, sf_dir).select(F.explode("tokens").alias("word")).distinct())


_TYPO_SQL = f"""{_TOKENS}, tw AS (SELECT DISTINCT unnest(tokens) AS word FROM tk), tl AS (SELECT word, CAST(('0x' || left(md5(word), 8)) AS BIGINT) % (length(word) - 1) + 1 AS k FROM tw WHERE length(word) >= 5),
ty AS (SELECT * FROM (SELECT word, 'drop' AS kind, left(word, k - 1) || substr(word, k + 1) AS typo FROM tl UNION ALL SELECT word, 'swap', left(word, k - 1) || substr(word, k + 1, 1) || substr(word, k, 1) || substr(word, k + 2) FROM tl
  UNION ALL SELECT word, 'replace', left(word, k - 1) || 'e' || substr(word, k + 1) FROM tl) WHERE typo <> word),
{_lcs("ty", "word", "typo")}, tr AS (SELECT word, kind, typo, 200.0 * lcs / (length(word) + length(typo)) AS ratio FROM ty JOIN lcs_ ON word = a AND typo = b)"""


@query(f"WITH RECURSIVE {_TYPO_SQL} SELECT word, kind, typo, round(CAST(ratio AS DOUBLE), 6) AS ratio FROM tr")
def typo_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic typos of the queries' words with their similarity to the word."""
    return typo_words(spark, sf_dir).withColumn("ratio", F.round(fuzzy.ratio(F.col("word"), F.col("typo")), 6))


@query(
    f"""WITH RECURSIVE {_TYPO_SQL} SELECT CAST(lim AS DOUBLE) AS "limit", kind, count(*) AS n, count(*) FILTER (WHERE ratio >= lim AND NOT list_contains({_FUNCTION_WORDS}, typo)) AS matched FROM tr, (SELECT unnest(range(70, 100, 2)) AS lim) GROUP BY ALL"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many typos are matched to their words at 15 thresholds, less those that would rewrite a function word."""
    pairs = typo_words(spark, sf_dir).withColumn("ratio", fuzzy.ratio(F.col("word"), F.col("typo"))).withColumn("promotes", Q.promotes_function_word(F.col("typo"), F.col("word")))
    return E.sweep(pairs, [float(x) for x in range(70, 100, 2)])


#: The thresholds that are tried.
LIMITS = [70.0, 75.0, 80.0, 82.0, 84.0, 85.0, 86.0, 87.0, 88.0, 89.0, 90.0, 91.0, 92.0, 93.0, 95.0]


def calibration(tokens: DataFrame) -> DataFrame:
    """The sweep of 15 thresholds for texts (query_id, tokens), with their first two and first three words as terms."""
    windows = Q.ngrams(tokens, K.WINDOW_WORDS).select("gram", "n").distinct()
    terms = tokens.select(F.explode(F.array(F.array_join(F.slice("tokens", 1, 2), " "), F.array_join(F.slice("tokens", 1, 3), " "))).alias("term")).where("term like '% %'").distinct()
    typed = E.term_typos(terms)
    asked = windows.unionByName(typed.select(F.col("typo").alias("gram"), F.size(F.split("typo", " ")).alias("n"))).distinct()
    matched = Q.best_matches(asked, terms, min(LIMITS), guard=False)
    return E.calibrate(matched.withColumn("promotes", Q.promotes_function_word(F.col("gram"), F.col("term"))), typed, windows, LIMITS)


@query()
def calibration_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against a plain computation in the tests, as its SQL would hold every window against every term."""
    return calibration(query_tokens(spark, sf_dir))


@query()
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages, chunked, with figures for every third headed part; the size split is a recursive rule outside SQL, tested
    against a plain implementation."""
    p = pages(spark, sf_dir)
    none = F.lit(None).cast("string")
    m = p.select("doc_id").distinct().select("doc_id", F.lit("v1.0").alias("version"), none.alias("model"), none.alias("firmware"), none.alias("source_path"))
    header = r"[A-ZÀ-Ý]\S* .{3,60}[.]"
    heads = I.lines_of(p).where(F.col("line").rlike(f"^(?:{header})$") & ((F.col("page") + F.col("pos")) % 3 == 0))
    figures = heads.select("doc_id", T.title_key(F.col("line")).alias("section"), F.concat_ws("-", F.lit("i"), "page", "pos").alias("image_id"), (F.col("page") * 1000 + F.col("pos")).alias("pos"))
    return I.chunk(p, figures, m, header).withColumn("image_ids", F.array_join("image_ids", ","))


# The benchmark items as users' queries: the fifth word mistyped, a code, a version and a model said at the end. Their families are
# an item's first two words, and its next two with the first letter doubled; codes come from part, models from documents.
_SAID = r"""ut AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zà-ÿ]+') AS w FROM benchmark),
us AS (SELECT item_id AS query_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 5 THEN substr(x, 2, 1) || left(x, 1) || substr(x, 3) ELSE x END), ' ') || ' codice errore ' || CASE WHEN item_id % 2 = 0 THEN 'A ' ELSE '' END || (60 + item_id % 40) || ', versione ' || (item_id % 5) || '.2 SRC-' || (item_id % 4) AS text FROM ut),
fam AS (SELECT item_id AS family, array_to_string(w[1:2], ' ') AS term, 0 AS place FROM ut WHERE len(w) >= 4 UNION ALL SELECT item_id, left(w[3], 1) || array_to_string(w[3:4], ' '), 1 FROM ut WHERE len(w) >= 4),
codes AS (SELECT DISTINCT chr(CAST(65 + p_partkey % 3 AS INTEGER)) || (60 + p_size % 40) AS code FROM part)"""


def said(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """query_id, text; family, canonical, term, place; code."""
    w, i = query_tokens(spark, sf_dir), F.col("query_id")
    words = F.transform("tokens", lambda x, k: F.when(k == 4, swapped(x)).otherwise(x))
    end = F.concat(F.lit(" codice errore "), F.when(i % 2 == 0, "A ").otherwise(""), (60 + i % 40).cast("string"), F.lit(", versione "), (i % 5).cast("string"), F.lit(".2 SRC-"), (i % 4).cast("string"))
    pair = lambda k: F.array_join(F.slice("tokens", k, 2), " ")
    terms = F.array(F.struct(pair(1).alias("term"), F.lit(0).alias("place")), F.struct(F.concat(F.substring(pair(3), 1, 1), pair(3)).alias("term"), F.lit(1).alias("place")))
    families = w.where(F.size("tokens") >= 4).select(i.cast("int").alias("family"), pair(1).alias("canonical"), F.inline(terms))
    codes = table(spark, sf_dir, "part").select(F.concat(F.char(65 + F.col("p_partkey") % 3), (60 + F.col("p_size") % 40).cast("string")).alias("code")).distinct()
    return w.select("query_id", F.concat(F.array_join(words, " "), end).alias("text")), families, codes


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_NOW = r"tk AS (SELECT query_id, regexp_extract_all(lower(corrected), '[0-9a-zà-ÿ]+') AS tokens FROM fixed)"
_FAMILY_TERMS = "voc AS (SELECT DISTINCT term, len(string_split(term, ' ')) AS n FROM fam)"


@query(
    rf"""WITH RECURSIVE {_MANUAL}, {_LANGUAGE}, {_SAID}, st AS (SELECT query_id, text, regexp_extract_all(lower(text), '[0-9a-zà-ÿ]+') AS tokens FROM us), sw AS (SELECT DISTINCT unnest(tokens) AS word FROM st),
{_corrections("sw")},
ea AS (SELECT query_id, pos, x.word, CASE WHEN regexp_matches(x.word, '[0-9]') THEN x.word ELSE coalesce(corrected, x.word) END AS after FROM (SELECT query_id, unnest(tokens) AS word, unnest(range(len(tokens))) AS pos FROM st) x LEFT JOIN fixes USING (word)),
ec AS (SELECT query_id, count(*) FILTER (WHERE word <> after) AS n_corrections, string_agg(after, ' ' ORDER BY pos) AS joined FROM ea GROUP BY query_id),
fixed AS (SELECT st.query_id, text, coalesce(n_corrections, 0) AS n_corrections, CASE WHEN n_corrections > 0 THEN joined ELSE text END AS corrected FROM st LEFT JOIN ec USING (query_id)),
{_fuzzy(88.0, _NOW, _FAMILY_TERMS)}, {_GREEDY},
ex AS (SELECT DISTINCT query_id, term FROM tk, (SELECT DISTINCT term FROM fam) WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || term || ' ')),
ma AS (SELECT query_id, 0 AS kind, 0 AS n, 0 AS start, term FROM ex UNION ALL SELECT query_id, 1, -n, start, term FROM greedy_),
ml AS (SELECT query_id, list(term ORDER BY kind, n, start, term) AS l FROM ma GROUP BY query_id), mt AS (SELECT query_id, {_DISTINCT.format("l")} AS matched FROM ml),
ow AS (SELECT term, min(family) AS family FROM fam GROUP BY term), mf AS (SELECT DISTINCT query_id, family FROM ma JOIN ow USING (term)),
mo AS (SELECT query_id, list(term ORDER BY family, place, term) AS more FROM mf JOIN fam USING (family) GROUP BY query_id),
ep AS (SELECT query_id, upper(unnest(regexp_extract_all(text, '{K.ERROR_CODE}', 1)) || unnest(regexp_extract_all(text, '{K.ERROR_CODE}', 2))) AS code FROM us),
en AS (SELECT query_id, upper(coalesce(unnest(regexp_extract_all(text, '{K.ERROR_CODE_IN_CONTEXT}', 1)), '')) AS letter, unnest(regexp_extract_all(text, '{K.ERROR_CODE_IN_CONTEXT}', 2)) AS digits FROM us),
eo AS (SELECT * FROM ep UNION SELECT query_id, letter || digits FROM en WHERE letter <> '' UNION SELECT query_id, code FROM en JOIN codes ON substr(code, 2) = digits WHERE letter = ''),
el AS (SELECT query_id, list_sort(list(DISTINCT code)) AS found FROM eo WHERE code IN (SELECT code FROM codes) OR NOT EXISTS (SELECT 1 FROM codes) GROUP BY query_id),
md AS (SELECT compact, min_by(model, pos) AS model FROM (SELECT array_to_string(regexp_extract_all(lower(source), '[0-9a-zà-ÿ]+'), '') AS compact, source AS model, doc_id AS pos FROM documents WHERE source IS NOT NULL) WHERE compact <> '' GROUP BY compact),
ru AS (SELECT query_id, start, n, array_to_string(tokens[start : start + n - 1], '') AS compact FROM (SELECT query_id, tokens, start, unnest(range(1, least(longest, len(tokens) - start + 1) + 1)) AS n FROM (SELECT query_id, tokens, unnest(range(1, len(tokens) + 1)) AS start FROM st), (SELECT max(length(compact)) AS longest FROM md))),
me AS (SELECT query_id, model FROM (SELECT query_id, model, row_number() OVER (PARTITION BY query_id ORDER BY start, n, compact) AS k FROM ru JOIN md USING (compact)) WHERE k = 1),
ja AS (SELECT f.*, coalesce(matched, []) AS matched, list_concat([corrected], coalesce(more, []), coalesce(found, [])) AS parts, coalesce(found, []) AS found, model FROM fixed f LEFT JOIN mt USING (query_id) LEFT JOIN mo USING (query_id) LEFT JOIN el USING (query_id) LEFT JOIN me USING (query_id))
SELECT query_id, corrected, n_corrections, array_to_string(matched, ',') AS matched_terms, array_to_string(found, ',') AS error_codes, array_to_string({_DISTINCT.format("parts")}, ' | ') AS expanded, nullif(regexp_extract(text, '{K.FIRMWARE}', 1), '') AS firmware, model FROM ja"""
)
def normalised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of query normalisation."""
    d = docs(spark, sf_dir)
    queries, families, codes = said(spark, sf_dir)
    out = Q.normalise(queries, families, Q.term_frequency(d), language(spark, sf_dir), codes, Q.indexed_models(d.select(F.col("source").alias("model"), F.col("doc_id").alias("pos"))))
    return out.select("query_id", "corrected", F.size("corrections").cast("long").alias("n_corrections"), F.array_join("matched_terms", ",").alias("matched_terms"), F.array_join("error_codes", ",").alias("error_codes"), "expanded", "firmware", "model")


# The pages' headed parts, with figures for every third of them.
@query(
    rf"""WITH {_PAGES}, e AS (SELECT *, regexp_full_match(line, '[A-ZÀ-Ý]\S* .{{3,60}}[.]') AS head FROM lines_ WHERE length(line) > 0),
t AS (SELECT doc_id, page, pos, trim(regexp_replace(trim(line), '\s+', ' ', 'g')) AS section FROM e WHERE head), f AS (SELECT doc_id, section, 'i' || page || '-' || pos AS image_id, page * 1000 + pos AS at_ FROM t WHERE (page + pos) % 3 = 0),
g AS (SELECT doc_id, section, string_agg(image_id, ',' ORDER BY at_, image_id) AS image_ids FROM f GROUP BY ALL)
SELECT t.doc_id, page, pos, t.section, coalesce(image_ids, '') AS image_ids FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.section = g.section"""
)
def section_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by the title of their section, wherever in the document it stands."""
    lines = I.lines_of(pages(spark, sf_dir)).where(F.col("line").rlike(r"^(?:[A-ZÀ-Ý]\S* .{3,60}[.])$"))
    titled_ = lines.select("doc_id", "page", "pos", F.trim("line").alias("title"))
    some = titled_.where("(page + pos) % 3 = 0").select("doc_id", T.title_key(F.col("title")).alias("section"), F.concat(F.lit("i"), F.col("page").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("image_id"), (F.col("page") * 1000 + F.col("pos")).alias("pos"))
    return I.attach_figures(titled_, some).select("doc_id", "page", "pos", "section", F.array_join("image_ids", ",").alias("image_ids"))


from . import plumbing  # noqa: E402,F401  more queries of the same catalogue
