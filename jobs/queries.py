"""The jobs as queries: each runs its job twice into one new folder and returns all of what then stands there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import lexical_index, manual_sections
from lectern.operators import lexical_index as LI
from lectern.plans.catalog import _BM25, _REPEATED
from lectern.sources.scratch import scratch_path

#: A header in the test tables: a short line that begins in upper case and ends with a full stop.
HEADER = r"[A-ZÀ-Ý]\S* .{3,60}[.]"


def job1_lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is given as a pattern, as a stream takes folders and patterns and the table may be one file."""
    folder = scratch_path(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        lexical_index.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/index", f"{folder}/checkpoint")
    return LI.postings(spark, f"{folder}/index")


def job2_manual_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "job2")
    for _ in range(2):  # the second run replaces what the first wrote
        manual_sections.run(spark, f"{sf_dir}/documents.parquet", folder, "v1", "source", "doc_id", "text", HEADER, 0.05)
    return manual_sections.read_sections(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_lexical_index": job1_lexical_index, "job2_manual_sections": job2_manual_sections}

_WHITE = "chr(32) || chr(10) || chr(9) || chr(13)"
SQL = {
    "job1_lexical_index": f"WITH {_BM25} SELECT term, doc_id AS chunk_id, tf, CAST(dl AS INTEGER) AS dl FROM bp",
    "job2_manual_sections": f"""
WITH {_REPEATED},
kept AS (SELECT l.* FROM lines_ l LEFT JOIN repeated r ON l.doc_id = r.doc_id AND trim(l.line) = r.line
  WHERE r.line IS NULL AND NOT coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(l.line), '[0-9]{{1,9}}') THEN trim(l.line) END AS INTEGER) BETWEEN l.page - 1 AND l.page + 1, false)),
joined AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY ALL),
stripped AS (SELECT p.doc_id, p.page, trim(coalesce(j.text, ''), {_WHITE}) AS text FROM pages_ p LEFT JOIN joined j USING (doc_id, page)),
again AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM stripped),
heads AS (SELECT *, regexp_full_match(line, '{HEADER}') AS head FROM again),
parts AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY pos) AS k FROM heads),
bodies AS (SELECT doc_id, page, k, min(CASE WHEN head THEN trim(line) END) AS title, trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos), ''), {_WHITE}) AS body FROM parts GROUP BY doc_id, page, k),
filled AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS INTEGER) AS seg, title, body FROM bodies WHERE body <> ''),
segs AS (SELECT * FROM filled UNION ALL SELECT doc_id, page, 0, NULL, text FROM stripped s WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.doc_id = s.doc_id AND f.page = s.page)),
plain AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '') AS ls FROM segs),
told AS (SELECT * FROM plain WHERE NOT (len(ls) >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, '[.]{{4,}}'))) >= 0.35 * len(ls))),
carried AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM told)
SELECT doc_id, 'v1' AS version, page, seg, CASE WHEN seg = 0 AND title IS NULL AND last IS NOT NULL THEN last ELSE title END AS title, body, seg = 0 AND title IS NULL AND last IS NOT NULL AS is_continuation FROM carried
""",
}
