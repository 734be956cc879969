"""Small cases of the operators: ties, nulls, empty tables, and golden examples."""

import pytest
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import fuzzy
from lectern.operators import answers as A
from lectern.operators import evaluate as E
from lectern.operators import followup as FU
from lectern.operators import ingest as I
from lectern.operators import query as Q
from lectern.operators import retrieval as R
from lectern.sources import corpus as C
from lectern.sources import store as S
from lectern.streaming import sessions


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_fusion_is_symmetric_and_counts_duplicates(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    one = {r.chunk_id: r.score for r in R.fuse(a, b, 0.6, 0.4).collect()}
    two = {r.chunk_id: r.score for r in R.fuse(b, a, 0.4, 0.6).collect()}
    assert one == pytest.approx(two)
    assert one["x"] == pytest.approx(0.6 / 61 + 0.6 / 63)
    assert [r.chunk_id for r in R.top_fused(R.fuse(a, b), 2).orderBy("rank").collect()] == ["x", "y"]


def test_gate_without_chunks_is_off_topic(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = spark.createDataFrame([(1, 0.8), (2, 0.79)], "query_id int, similarity double")
    assert rows(R.gate(q, got), "query_id") == [(1, 0.8, False), (2, 0.79, True), (3, 0.0, True)]


def test_model_filter_only_where_something_stays(spark):
    ddl = "query_id int, chunk_id string, rank int, model string"
    dense = spark.createDataFrame([(1, "a", 1, "X"), (1, "b", 2, "Y"), (2, "a", 1, "X")], ddl)
    lexical = spark.createDataFrame([(1, "c", 1, None), (2, "b", 1, "Y")], ddl)
    wanted = spark.createDataFrame([(1, "y"), (2, "z")], "query_id int, wanted string")
    d, x = R.filter_model(dense, lexical, wanted)
    assert rows(d.select("query_id", "chunk_id", "rank"), "query_id") == [(1, "b", 1), (2, "a", 1)]
    assert rows(x.select("query_id", "chunk_id", "rank"), "query_id") == [(2, "b", 1)]


def test_latest_version_and_penalty(spark):
    m = spark.createDataFrame([("d", "v9", 0), ("d", "v10", 1), ("d", "10", 2), ("e", None, 3)], "doc_id string, version string, pos int")
    latest = R.latest_versions(m)
    assert rows(latest.select("doc_id", "version"), "doc_id") == [("d", "v10"), ("e", None)]
    scored = spark.createDataFrame([("d", "v9", 1.0), ("d", "v10", 1.0), ("f", "v1", 1.0)], "doc_id string, version string, score double")
    assert rows(R.penalise_stale(scored, latest).select("doc_id", "version", "score", "is_stale"), "doc_id", "score") == [("d", "v9", 0.98, True), ("d", "v10", 1.0, False), ("f", "v1", 1.0, False)]


def test_ambiguity(spark):
    s = spark.createDataFrame([(1, "A", 1.0), (1, "B", 0.85), (1, "C", 0.8), (2, "A", 1.0), (2, None, 1.0)], "query_id int, model string, score double")
    assert rows(R.ambiguity(s), "query_id") == [(1, True, ["A", "B"]), (2, False, [])]


def test_rerank_ties_keep_order(spark):
    r = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 2, 1.0), (1, "c", 3, 1.0)], "query_id int, chunk_id string, rank int, logit double")
    assert [x.chunk_id for x in R.rerank(r, F.col("logit")).orderBy("rank").collect()] == ["b", "c", "a"]
    assert R.rerank(r, None) is r


def test_bm25_fill(spark):
    d = spark.createDataFrame([(1, "alfa beta"), (2, "gamma"), (3, None)], "chunk_id int, text string")
    q = spark.createDataFrame([(9, "alfa alfa")], "query_id int, text string")
    assert [r.chunk_id for r in R.bm25(d, q, 3).collect()] == [1]
    assert [(r.chunk_id, r.rank) for r in R.bm25(d, q, 3, fill=True).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]


MANUAL = [("d", 1, "Cassa RCH\n1.1 Apertura cassa\nGirare la chiave e attendere il segnale.\nPagina 1\n1"), ("d", 2, "Cassa RCH\nTesto che continua la sezione di prima, con altre righe.\n2"), ("d", 3, "Cassa RCH\n1.2 Storno scontrino\n1.3 Chiusura fiscale\nPremere il tasto per la chiusura della giornata.\n3")]


def test_pages_to_chunks(spark):
    p = spark.createDataFrame(MANUAL, "doc_id string, page int, text string")
    clean = I.strip_lines(p, I.boilerplate(p))
    assert "Cassa RCH" not in clean.where("page = 1").first().text and not clean.where("page = 2").first().text.endswith("2")
    segs = I.carry_titles(I.headers(clean))
    assert rows(segs.select("page", "seg", "title", "is_continuation"), "page", "seg") == [(1, 0, "1.1 Apertura cassa", False), (2, 0, "1.1 Apertura cassa", True), (3, 0, "1.3 Chiusura fiscale", False)]
    figures = spark.createDataFrame([("d", "1.1 Apertura cassa", "i2", 2), ("d", "1.1 Apertura cassa", "i1", 1)], "doc_id string, section string, image_id string, pos int")
    manuals = spark.createDataFrame([("d", "0.3", "M", None, "x.pdf")], "doc_id string, version string, model string, firmware string, source_path string")
    got = I.chunk(clean, figures, manuals).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == ["d_0-3_c0001", "d_0-3_c0002", "d_0-3_c0003"]
    assert [r.image_ids for r in got] == [["i1", "i2"], ["i1", "i2"], []]
    assert I.boilerplate(I.strip_lines(p, I.boilerplate(p))).count() == 0


def test_split_text():
    text = "\n\n".join("frase numero %d. altra frase qui" % n for n in range(60))
    parts = I.split_text(text, 200, 50)
    assert all(0 < len(p) <= 200 for p in parts) and all(any(f"numero {n}." in p for p in parts) for n in range(60))
    assert I.split_text("x" * 500, 200, 50) == ["x" * 500]
    assert I.split_text("", 200, 50) == [] and I.split_text("short", 200, 50) == ["short"]


def test_ocr(spark):
    p = spark.createDataFrame([("n" * 40, None, None), ("poco", "testo lungo letto da immagine", "ok"), ("testo", "un testo lungo letto da immagine", "ok"), ("poco", "x", "ok"), (None, None, "unavailable")], "native string, ocr_text string, ocr_status string")
    got = I.merge_ocr(p).collect()
    assert [r.text for r in got] == ["n" * 40, "poco\ntesto lungo letto da immagine", "un testo lungo letto da immagine", "poco", ""]
    assert [(r.ocr_attempted, r.ocr_used, r.ocr_failed, r.ocr_empty) for r in got] == [(False, False, False, False), (True, True, False, False), (True, True, False, False), (True, False, False, True), (True, False, True, False)]


def test_figures_and_reading_order(spark):
    t = spark.createDataFrame([("d", 1, 100.0, 0, "A"), ("d", 1, 300.0, 1, "B  b")], "doc_id string, page int, y double, pos int, title string")
    f = spark.createDataFrame([("d", 1, 50.0, 0, "cover"), ("d", 1, 100.0, 1, "equal"), ("d", 1, 299.0, 2, "above"), ("d", 2, 10.0, 3, "next")], "doc_id string, page int, y double, pos int, image_id string")
    assert rows(I.figures_by_section(t, f).select("image_id", "section"), "image_id") == [("above", "A"), ("equal", "A"), ("next", "B b")]
    lines = spark.createDataFrame([("d", 1, 0, "x"), ("d", 1, 1, "top"), ("d", 1, 2, "top"), ("d", 1, 3, "y")], "doc_id string, page int, pos int, line string")
    above = spark.createDataFrame([("d", 1, "top")], "doc_id string, page int, text string")
    assert [r.pos for r in I.reading_order(lines, above).orderBy("place").collect()] == [1, 0, 2, 3]


VOCAB = ["come", "sostituisco", "rotolo", "carta", "nella", "stampante", "faccio", "storno", "scontrino", "prenotazione"]


def normalise(spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    manual = spark.createDataFrame([(w, 10) for w in VOCAB], "word string, freq int")
    language = spark.createDataFrame([("imposto", 4.0), ("prenotazione", 4.0)], "word string, freq double")
    codes = spark.createDataFrame([("E43",), ("E60",)], "code string")
    models = Q.indexed_models(spark.createDataFrame([("PRINT! F", 0), ("Print F", 1)], "model string, pos int"))
    return {r.query_id: r for r in Q.normalise(q, Q.synonyms(spark), manual, language, codes, models).collect()}


def test_normalisation(spark):
    got = normalise(spark, "come sostituisco il rololo di crata nella stampnate", "Come faccio uno strono scontrino?", "impotso prenoatzione dtaa", "printf: codice errore 43, 20 e 20", "")
    assert got[0].corrected == "come sostituisco il rotolo di carta nella stampante" and got[0].matched_terms == ["rotolo"]
    assert got[1].corrected == "come faccio uno storno scontrino" and got[1].matched_terms == ["storno", "storno scontrino"]
    assert [tuple(c) for c in got[1].corrections] == [("strono", "storno")]
    assert got[1].expanded.startswith("come faccio uno storno scontrino | storno | annullo")
    assert got[2].corrected == "imposto prenotazione dtaa"
    assert got[3].error_codes == ["E43"] and got[3].model == "PRINT! F"
    assert got[4].corrected == "" and got[4].matched_terms == []


def test_windows_and_guard(spark):
    w = spark.createDataFrame([("storno scontrno", 2), ("lo scontrino", 2), ("storno dello scontrino", 3)], "gram string, n int")
    v = spark.createDataFrame([("storno scontrino",), ("la scontrino",)], "term string")
    got = {r.gram: r.term for r in Q.best_matches(w, v).collect()}
    assert got == {"storno scontrno": "storno scontrino"}
    c = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 3, "b"), (1, 4, 2, "c"), (1, 5, 2, "d")], "query_id int, start int, n int, term string")
    assert sorted(r.term for r in Q.greedy(c).collect()) == ["b", "c"]


def test_fuzzy_matches_against_plain(spark):
    import random

    random.seed(5)
    words = ["".join(random.choices("abcd", k=5)) for _ in range(30)]
    grams = [f"{random.choice(words)} {random.choice(words)}" for _ in range(40)]
    terms = [g[:3] + g[4:] for g in grams[:15]]

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 200.0 * row[-1] / (len(a) + len(b))

    want = {}
    for g in set(grams):
        same = [(-ratio(g, t), t) for t in set(terms) if len(t.split()) == len(g.split()) and ratio(g, t) >= 88]
        if same and not any(x != y and x in K.FUNCTION_WORDS for x, y in zip(g.split(), min(same)[1].split(), strict=True)):
            want[g] = min(same)[1]
    w = spark.createDataFrame([(g, 2) for g in grams], "gram string, n int")
    got = {r.gram: r.term for r in Q.best_matches(w, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == want


def test_fuzzy_vocabulary_is_whole(spark):
    from lectern.plans import catalog

    t = spark.createDataFrame([(1, ["aa", "bb", "cc", "dd"])], "query_id int, tokens array<string>")
    got = {r.term for r in catalog.fuzzy_vocabulary(Q.ngrams(t, (2, 3))).collect()}
    assert got == {"aaa bb", "bbb cc", "ccc dd", "aaa bb cc", "bbb cc dd"}


def test_fuzzy_blocks_lose_nothing(spark):
    import random

    random.seed(6)
    words = ["".join(random.choices("abeèz19", k=random.randint(1, 7))) for _ in range(40)]
    grams = sorted({" ".join(random.choices(words, k=n)) for n in (2, 3) for _ in range(60)})

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    w = spark.createDataFrame([(g, len(g.split())) for g in grams], "gram string, n int")
    terms = [g[0] + g for g in grams[::2]] + [g[1:-1] for g in grams if g.split()[0][1:] and g.split()[-1][:-1]]
    for limit in (60.0, 80.0, 100.0):
        want = {}
        for g in grams:
            best = sorted((-200.0 * lcs(g, t) / (len(g) + len(t)), t) for t in set(terms) if len(t.split()) == len(g.split()))
            if len(g) >= 5 and best and -best[0][0] >= limit:
                want[g] = best[0][1]
        got = {r.gram: r.term for r in Q.best_matches(w, spark.createDataFrame([(t,) for t in terms], "term string"), limit).collect()}
        left = {g: t for g, t in want.items() if g not in got}
        assert {g: t for g, t in want.items() if g in got} == got
        assert all(any(x != y and x in Q.K.FUNCTION_WORDS for x, y in zip(g.split(), t.split(), strict=True)) for g, t in left.items())


def test_swapped_words_stay_whole(spark):
    from lectern.plans import catalog

    words = ["ab" + "c" * 1500, "abc", "ab"]
    got = spark.createDataFrame([(w,) for w in words], "word string").select(catalog.swapped(F.col("word")).alias("s")).collect()
    assert [r.s for r in got] == ["ba" + w[2:] for w in words]


def test_models_and_terms_of_any_length(spark):
    q = spark.createDataFrame([(1, "the a b c d e f g h printer", "the a b c d e f g h printer".split()), (2, "", [])], "query_id int, text string, tokens array<string>")
    m = spark.createDataFrame([("A-B C/D E.F G H", 0), ("Printers", 1)], "model string, pos int")
    assert [tuple(r) for r in Q.mentioned_model(q, Q.indexed_models(m)).collect()] == [(1, "A-B C/D E.F G H")]
    assert Q.mentioned_model(q, Q.indexed_models(m).limit(0)).count() == 0
    v = spark.createDataFrame([("a b c d e f g",), ("the",), ("g h printer x",)], "term string")
    assert sorted(r.term for r in Q.exact_terms(q, v).collect()) == ["a b c d e f g", "the"]
    assert Q.exact_terms(q, v.limit(0)).count() == 0


def test_grounding(spark):
    s = spark.createDataFrame([(1, 1, "t", "a"), (1, 2, "t", "x"), (2, 1, "t", "x")], "answer_id int, number int, text string, chunk_id string")
    w = spark.createDataFrame([(1, "t", None), (1, "t", "x"), (1, "t", "a")], "answer_id int, text string, chunk_id string")
    got = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "answer_id int, chunk_id string")
    kept, warned, verdict = A.ground(s, w, got)
    assert kept.count() == 1 and sorted(str(r.chunk_id) for r in warned.collect()) == ["None", "a"]
    assert rows(verdict, "answer_id") == [(1, 2, 1, False), (2, 1, 0, True)]


def test_figures(spark):
    f = spark.createDataFrame([("g", "a", 100.0, 0), ("g", "b", 200.0, 1), ("h", "c", 3000.0, 2), ("h", "d", 10.0, 3)], "group string, image_id string, area double, pos int")
    assert rows(A.significant_figures(f).select("group", "image_id"), "group") == [("g", "b"), ("h", "c")]
    i = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c")], "answer_id int, pos int, image_id string")
    assert rows(A.first_images(i, 2), "place") == [(1, 1, "a"), (1, 2, "b")]
    assert A.first_images(i, 0).count() == 3


def test_audit(spark):
    ddl = "latency_ms int, retrieval_ms int, time_to_first_token_ms int, fallback boolean, off_topic boolean, n_images int, retrieved_chunk_ids array<string>, corrections array<string>"
    one = E.audit_metrics(spark.createDataFrame([(100, None, None, False, None, 0, [], None), (9000, 10, 5, True, True, 1, ["a"], ["x"])], ddl)).first()
    assert (one.n_queries, one.latency_ms_p50, one.latency_ms_p95, one.retrieval_ms_p50, one.ttft_ms_p50) == (2, 9000, 9000, 10, 5)
    assert (one.e2e_within_budget_rate, one.off_topic_rate, one.hit_rate_any_chunk) == (1.0, 0.5, 0.5)
    none = E.audit_metrics(spark.createDataFrame([], ddl)).first()
    assert none.n_queries == 0 and none.latency_ms_p50 == 0 and none.fallback_rate == 0.0


def test_thresholds(spark):
    s = spark.createDataFrame([("a", 0.8372), ("a", 0.88), ("n", 0.8172)], "kind string, score double")
    got = E.thresholds(s, "a", "n", F.lit(0.0236)).first()
    assert (got.margin, got.threshold) == (0.0354, 0.8018)


def test_typos(spark):
    got = E.typos(spark.createDataFrame([("storno",), ("no",)], "word string")).collect()
    assert {r.word for r in got} == {"storno"} and all(fuzzy.damerau_distance(r.word, r.typo) == 1 for r in got)


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("d", "1", 0, "a"), ("d", "2", 1, "b"), ("e", "1", 2, "c")], "doc_id string, version string, pos int, text string")
    new = spark.createDataFrame([("d", "1", 0, "A")], "doc_id string, version string, pos int, text string")
    once = S.replace(old, new)
    assert [r.text for r in once.orderBy("pos").collect()] == ["b", "c", "A"]
    assert S.replace(once, new).count() == once.count()
    path = str(tmp_path / "chunks")
    S.write_versions(old, path)
    S.write_versions(new, path)
    assert sorted(r.text for r in S.read_versions(spark, path).collect()) == ["A", "b", "c"]
    assert "PartitionFilters: [isnotnull(doc_id" in S.read_versions(spark, path, "d")._jdf.queryExecution().toString()
    m = S.upsert(spark.createDataFrame([("d", "1", 1)], "doc_id string, version string, n int"), spark.createDataFrame([("d", "1", 2, 0), ("d", "1", 3, 1)], "doc_id string, version string, n int, pos int"), ["doc_id", "version"])
    assert rows(m) == [("d", "1", 3)]


def test_corpus(spark, tmp_path):
    assert C.corpus(spark, str(tmp_path / "missing")).count() == 0
    chunks = spark.createDataFrame([("c1", "t", None, ["i"])], "chunk_id string, text string, section_title string, image_ids array<string>")
    C.to_corpus(chunks).write.json(str(tmp_path / "c"))
    back = C.corpus(spark, str(tmp_path / "c")).first()
    assert (back.chunk_id, back.section_title, back.image_ids) == ("c1", None, ["i"])
    (tmp_path / "bad.jsonl").write_text('{"text": "a", "metadata": {}}\n\n{nonsense\n')
    assert C.corpus(spark, str(tmp_path / "bad.jsonl"), tolerant=True).where("text = 'a'").count() == 1
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        C.corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_documents(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"uno\x0cdue")

    def parse(data):
        return [{"text": t, "ocr_used": False, "ocr_attempted": False, "ocr_failed": False, "ocr_empty": False, "ocr_error": None, "text_lines": [], "images": []} for t in data.decode().split("\x0c")]

    assert rows(C.scan_documents(spark, str(tmp_path / "m.bin"), parse, 5).select("doc_id", "page", "text"), "page") == [("m", 5, "uno"), ("m", 6, "due")]


def test_follow_up_batch_and_stream(spark, tmp_path):
    data = [("s", 0, "Quale modello?", True), ("s", 1, "print f", False), ("s", 2, "ok", False), ("t", 0, "ciao", False)]
    turns = spark.createDataFrame(data, sessions.TURNS)
    want = {(r.session, r.turn): (r.pending, r.query) for r in FU.follow_up(turns).collect()}
    assert want["s", 1] == ("Quale modello?", "Quale modello — print f") and want["s", 2] == (None, "ok")
    turns.coalesce(1).write.json(str(tmp_path / "in"))
    stream = sessions.pending_questions(spark.readStream.schema(sessions.TURNS).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("turns_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.session, r.turn): (r.pending, r.query) for r in spark.table("turns_out").collect()} == want


def test_audit_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"timestamp": "2024-01-01T00:01:00+00:00", "fallback": true, "off_topic": false, "latency_ms": 10}\n')
    q = sessions.windowed_rates(sessions.audit_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.n_fallback) for r in spark.table("rates").collect()] == [(1, 1)]


def test_pages_are_cut_where_they_are(spark):
    """Neither lines nor segments of a page go over the network, and a page without a manual keeps its text."""
    p = spark.createDataFrame([*MANUAL, (None, 1, "Alone\n1.1 Titolo della pagina\nTesto")], "doc_id string, page int, text string")
    heads = I.headers(p)
    assert "Exchange" not in heads._jdf.queryExecution().executedPlan().toString()
    assert [(r.seg, r.body) for r in heads.where("doc_id is null").orderBy("seg").collect()] == [(0, "Alone"), (1, "Testo")]
    repeated = spark.createDataFrame([("d", "Cassa RCH")], "doc_id string, line string")
    out = I.strip_lines(p, repeated)
    assert "hashpartitioning(page" not in out._jdf.queryExecution().executedPlan().toString() and "hashpartitioning(doc_id#" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.page): r.text for r in out.collect()}[None, 1] == "Alone\n1.1 Titolo della pagina\nTesto"
