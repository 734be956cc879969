"""The operators of this subpackage as queries over the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, html_extract, lang_id, mixing, ngram_join, prefix_trie, simhash, substring_dedup, suffix_dedup, token_store

WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = WORD_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.fit(docs)).select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_chats(turns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mix_epoch", "mix_domain", "lang", "source", "mix_tokens")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_store(table(spark, sf_dir, "documents"), vocabulary())
    return token_store.read_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_join(table(spark, sf_dir, "documents"), count_links=False).select("doc_id", "n_shingles", "component_id")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lang_id": op2_lang_id,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": op4_decontaminate,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_token_store": op8_token_store,
    "op9_ngram_join": op9_ngram_join,
    "op10_html_extract": op10_html_extract,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _weights(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE {mixing.OTHER} END"


def _pour(name: str, parent: str, child: str, out: str) -> str:
    """A level of the budget: common table expressions that end in `out` with a column share."""
    order = f"PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {child}"
    return f"""
{out}a AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM {name}),
{out}b AS (SELECT *, cap * wr <= (budget - used) * w AS full_ FROM {out}a),
{out}c AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS rest,
              sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS parts FROM {out}b),
{out} AS (SELECT *, CASE WHEN full_ THEN cap ELSE rest * w // parts END AS share FROM {out}c)"""


ORACLE_SQL = {
    "op1_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS rn FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM g
""",
    "op7_mix_sources": f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
              ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
r AS (SELECT * FROM d WHERE n > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) * 2 AS HUGEINT) AS cap, CAST(1 AS HUGEINT) AS w FROM r GROUP BY ALL),
n1 AS (SELECT 0 AS root, domain, sum(cap) AS cap, CAST({_weights("domain", mixing.DOMAIN_WEIGHTS)} AS HUGEINT) AS w,
              (SELECT sum(tokens) * 80 // 100 FROM leaves) AS budget FROM leaves GROUP BY domain),
{_pour("n1", "root", "domain", "s1")},
n2 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, CAST({_weights("l.lang", mixing.LANG_WEIGHTS)} AS HUGEINT) AS w, any_value(s1.share) AS budget
       FROM leaves l JOIN s1 USING (domain) GROUP BY l.domain, l.lang),
{_pour("n2", "domain", "lang", "s2")},
n3 AS (SELECT l.*, s2.share AS budget FROM leaves l JOIN s2 ON l.domain = s2.domain AND l.lang = s2.lang),
{_pour("n3", "domain, lang", "source", "s3")},
e AS (SELECT r.*, x.epoch, md5('17-' || x.epoch || '-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM r, (VALUES (0), (1)) x(epoch)),
o AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY epoch, k, coalesce(doc_id, -9223372036854775808)) AS upto FROM e)
SELECT o.doc_id, o.epoch AS mix_epoch, o.domain AS mix_domain, o.lang0 AS lang, o.source0 AS source, o.n AS mix_tokens
FROM o JOIN s3 ON o.domain = s3.domain AND o.lang = s3.lang AND o.source = s3.source WHERE o.upto <= s3.share
""",
    "op3_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(x) + length(x) - length(replace(x, '\\', '')) + 2 * len(regexp_extract_all(x, '</?s>|\[/?INST\]|\[/?ROLE\]|\[/HEAD\]')) AS nx,
  length(r) + length(r) - length(replace(r, '\\', '')) + 2 * len(regexp_extract_all(r, '</?s>|\[/?INST\]|\[/?ROLE\]|\[/HEAD\]')) AS nr FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE r WHEN 'user' THEN 18 + nx WHEN 'assistant' THEN 5 + nx ELSE 20 + nr + nx END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM w WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
l AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM s JOIN m USING (g) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
y AS (SELECT x.doc_id, count(l.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE l.p IS NULL) AS kept FROM x LEFT JOIN l ON x.doc_id = l.doc_id AND x.p = l.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON w.doc_id = y.doc_id
""",
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c, list_reduce(flatten(list_concat([[4294967295]], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, d: xor(xor(a, greatest(d, 0)) >> 1, 3988292384 * (xor(a, greatest(d, 0)) & 1))) AS crc FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, xor(crc, 4294967295) % 9 AS h, c - c % 5 AS base FROM b),
n AS (SELECT h.*, least(h.h, (SELECT count(*) FROM t WHERE t.c = h.base)) AS taken FROM h),
u AS (SELECT n.c, t.pos, r, x FROM n JOIN t ON t.c = n.base AND t.pos <= n.h UNION ALL SELECT n.c, t.pos - n.h + n.taken, r, x FROM n JOIN t ON t.c = n.c AND t.pos > n.h),
l AS (SELECT n.c, coalesce(list(sha256(length(r) || ':' || r || x) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS k, coalesce(list(strlen(x) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS s
      FROM n LEFT JOIN u ON u.c = n.c GROUP BY n.c),
p AS (SELECT c, k, s, unnest(range(0, len(k) + 1)) AS depth FROM l),
g AS (SELECT depth, array_to_string(k[1 : depth], '') AS id, c, len(k) = depth AS ends, CASE WHEN depth > 0 THEN s[depth] ELSE 0 END AS bytes FROM p),
v AS (SELECT depth, id, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM g GROUP BY depth, id),
q AS (SELECT substr(id, 1, 64 * (depth - 1)) AS id, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN q USING (id)),
a AS (SELECT substr(id, 1, 64 * up) AS id, n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM w)),
z AS (SELECT id, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY id)
SELECT w.conv_id, w.depth, e.conv_id AS parent_conv_id, w.n_convs, w.n_children, z.n_leaves, CAST(z.saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN z USING (id) LEFT JOIN v e ON w.depth > 0 AND e.id = substr(w.id, 1, 64 * (w.depth - 1))
""",
    "op9_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, 'all ' || len(w) || ' ' || array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON d.doc_id = m.x
""",
}
