"""Edit distances and joins by segments against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import fuzzy
from lectern.operators import query as Q


def edited(rng, word, letters="abcdè", most=3):
    w = list(word)
    for _ in range(rng.randint(0, most)):
        k, kind = rng.randrange(len(w) + 1), rng.choice("idrs")
        if kind == "i":
            w.insert(k, rng.choice(letters))
        elif kind == "d" and k < len(w) > 1:
            del w[k]
        elif kind == "r" and k < len(w):
            w[k] = rng.choice(letters)
        elif kind == "s" and k + 1 < len(w):
            w[k], w[k + 1] = w[k + 1], w[k]
    return "".join(w)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_near_distance(spark):
    rng = random.Random(1)
    pairs = [("ca", "abc"), ("abc", "ca"), ("", ""), ("", "ab"), ("ab", ""), ("a", "abcd"), ("ab", "ba"), ("abcd", "badc"), ("xcaz", "xabcz"), ("abcdef", "abcfed"), ("strono", "storno")]
    pairs += [(w, edited(rng, w)) for w in ("".join(rng.choices("abcdè", k=rng.randint(1, 12))) for _ in range(1500))]
    pairs += [("".join(rng.choices("ab", k=rng.randint(0, 5))), "".join(rng.choices("abc", k=rng.randint(0, 5)))) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("d", fuzzy.near_distance(F.col("a"), F.col("b")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want = fuzzy.damerau_distance(r.a, r.b)
        assert (r.d == want) if want <= 2 else r.d > 2, (r.a, r.b, r.d, want)


def test_common_subsequence_by_bits(spark):
    rng = random.Random(2)
    pairs = [("", "abc"), ("abc", "")] + [("".join(rng.choices("abè ", k=rng.randint(1, 70))), "".join(rng.choices("abè c", k=rng.randint(1, 60)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("p", fuzzy.letter_places(F.col("b"))).withColumn("n", fuzzy.lcs_by_bits(F.col("a"), F.col("b"), F.col("p")))
    for r in df.collect():
        assert r.n == lcs(r.a, r.b)


@pytest.mark.parametrize("threshold", [0.0, 60.0, 88.0, 100.0])
def test_windows_by_segments_lose_nothing(spark, threshold):
    rng = random.Random(int(threshold))
    words = ["".join(rng.choices("abeèz", k=rng.randint(1, 7))) for _ in range(25)]
    terms = sorted({" ".join(rng.choices(words, k=n)) for n in (2, 3) for _ in range(25)} | {"a b", "ab cd", "q" * 35 + "abc " + "r" * 30})
    grams = sorted({" ".join(rng.choices(words, k=n)) for n in (2, 3) for _ in range(20)} | {edited(rng, t) for t in terms})
    grams = [g for g in grams if len(g.split(" ")) in (2, 3) and "" not in g.split(" ")]
    w = spark.createDataFrame([(g, len(g.split(" "))) for g in grams], "gram string, n int")
    got = {r.gram: (r.term, round(r.ratio, 6)) for r in Q.best_matches(w, spark.createDataFrame([(t,) for t in terms], "term string"), threshold).collect()}
    want = {}
    for g in grams:
        if len(g) < K.LEAST_WINDOW_CHARS:
            continue
        near = [(-round(200.0 * lcs(g, t) / (len(g) + len(t)), 9), t) for t in terms if len(t.split(" ")) == len(g.split(" ")) and 200.0 * lcs(g, t) / (len(g) + len(t)) >= threshold]
        if near:
            r, t = min(near)
            if not any(a != b and a in K.FUNCTION_WORDS for a, b in zip(g.split(" "), t.split(" "), strict=True)):
                want[g] = (t, round(-r, 6))
    assert got == want


def test_corrections_against_plain(spark):
    rng = random.Random(7)
    vocab = {"".join(rng.choices("abcdè", k=rng.choice((4, 5, 6, 7, 9, 12, 19, 20, 21, 22, 23, 26, 40)))): rng.randint(1, 9) for _ in range(250)}
    manual, language = dict(list(vocab.items())[:150]), dict(list(vocab.items())[150:])
    asked = sorted({edited(rng, w) for w in list(vocab) * 3} | {"ab1cd", "abcd"})
    frame = lambda d: spark.createDataFrame(list(d.items()), "word string, freq long")
    out = Q.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), frame(manual), frame(language))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.word: r.corrected for r in out.collect()}
    want = {}
    for w in asked:
        if len(w) < K.LEAST_CORRECTED_CHARS or w in vocab or any(c.isdigit() for c in w):
            continue
        limit = K.EDITS_SHORT if len(w) <= K.SHORT_WORD_CHARS else K.EDITS_LONG
        best = [min(((fuzzy.damerau_distance(w, v), -f, v) for v, f in words.items() if abs(len(v) - len(w)) <= limit), default=None) for words in (manual, language)]
        best = [(b[0], k, b[2]) for k, b in enumerate(best) if b and b[0] <= limit]
        if best:
            want[w] = min(best)[2]
    assert got == want and sum(len(w) > Q.MOST_DELETED_FROM for w in want) > 50


def test_very_long_words_cost_nothing(spark):
    """Words of 100,000 letters in the vocabulary, and among the words asked for."""
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh", k=100_000))
    manual = spark.createDataFrame([(long, 3), ("stampante", 5), ("x" * 2000, 1)], "word string, freq long")
    language = spark.createDataFrame([(long[::-1], 1)], "word string, freq long")
    asked = ["stampnate", "c" * 30_000]
    got = Q.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), manual, language).collect()
    assert [(r.word, r.corrected) for r in got] == [("stampnate", "stampante")]
    assert Q.corrections(spark.createDataFrame([(long[:50_000] + "z" + long[50_001:],)], "word string"), manual, language).first().corrected == long


@pytest.mark.parametrize("most", [0, 200_000])
def test_terms_of_whole_texts(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MOST_AUTOMATON_TERMS", most)
    rng = random.Random(4)
    words = ["ab", "a", "b", "ba", "è1"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60))).upper() + "!") for k in range(60)] + [(61, None), (62, ""), (63, "ab " * 200_000)]
    terms = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)})
    got = sorted((r.doc_id, r.term) for r in Q.text_terms(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(t,) for t in [*terms, terms[0]]], "term string")).collect())
    said = {k: " " + " ".join((t or "").lower().rstrip("!").split()) + " " for k, t in texts}
    assert got == sorted((k, t) for k, s in said.items() for t in terms if f" {t} " in s)
    assert Q.text_terms(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "term string")).count() == 0


def test_calibration_against_plain(spark):
    from lectern.operators import evaluate as E
    from lectern.plans import catalog

    rng = random.Random(11)
    words = ["storno", "stronzo", "carta", "cartaa", "dello", "della", "stampa", "stampe", "il", "la", "rotolo", "rotoli", sorted(K.FUNCTION_WORDS)[0]]
    texts = [(k, rng.choices(words, k=rng.randint(0, 9))) for k in range(25)]
    df = spark.createDataFrame(texts, "query_id long, tokens array<string>")
    got = {r.limit: (r.n_typos, r.recovered, r.rewritten, r.rewritten_guarded) for r in catalog.calibration(df).collect()}
    windows = {" ".join(t[a : a + n]) for _, t in texts for n in (2, 3) for a in range(len(t) - n + 1)}
    terms = {" ".join(t[:n]) for _, t in texts for n in (2, 3)}
    terms = {t for t in terms if " " in t}
    mistyped = [(r.term, r.typo) for r in E.term_typos(spark.createDataFrame([(t,) for t in terms], "term string")).collect()]
    one_word = {}
    for r in E.typos(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        one_word.setdefault(r.word, set()).add(r.typo)
    assert set(mistyped) == {(t, " ".join([*t.split()[:k], x, *t.split()[k + 1 :]])) for t in terms for k, w in enumerate(t.split()) for x in one_word.get(w, ())}

    def best(gram):
        near = [(-200.0 * lcs(gram, t) / (len(gram) + len(t)), t) for t in terms if t.count(" ") == gram.count(" ")]
        if len(gram) < K.LEAST_WINDOW_CHARS or not near:
            return 0.0, None, False
        r, t = min(near)
        return -r, t, any(a != b and a in K.FUNCTION_WORDS for a, b in zip(gram.split(), t.split(), strict=True))

    typed = [(t, x) for t, x in mistyped if x not in windows]
    for limit, (n, recovered, rewritten, guarded) in got.items():
        assert n == len(typed)
        assert recovered == sum(r >= limit and f == t and not p for t, (r, f, p) in ((t, best(x)) for t, x in typed))
        wrong = [(r, p) for r, f, p, w in ((*best(w), w) for w in windows) if f is not None and f != w and r >= limit]
        assert rewritten == len(wrong) and guarded == sum(not p for _, p in wrong)
    assert sorted(got) == catalog.LIMITS and got[70.0][1] > got[95.0][1]


def test_vocabularies_are_made_once(spark):
    """However many parts of the normalisation go by the corrected text, a vocabulary's rows are made one time."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    words = frame([("sostituzione", 3), ("rotolo", 5), ("stampante", 2), ("carta", 9)], "word string, freq long").mapInArrow(counted, "word string, freq long")
    queries = frame([(1, "rololo di crata nella stampnate"), (2, None)], "query_id long, text string")
    out = Q.normalise(queries, Q.synonyms(spark), words, frame([("nella", 1.0)], "word string, freq double"), frame([("E60",)], "code string"), Q.indexed_models(frame([("SRC-1", 1)], "model string, pos long")))
    assert {r.query_id: r.corrected for r in out.collect()} == {1: "rotolo di carta nella stampante", 2: None} and made.value == 4
