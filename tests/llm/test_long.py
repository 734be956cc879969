"""Texts of more than a megabyte, and fingerprints of edited items."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import chat_format as C
from lectern.llm import decontaminate as D
from lectern.llm import exact_dedup, html_extract, lang_id, mixing, ngram_join, queries, substring_dedup, suffix_dedup

rng = random.Random(9)
VOCAB = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(4000)]
PASSAGE = " ".join(rng.choices(VOCAB, k=150))


def long_texts():
    base = " ".join(rng.choices(VOCAB, k=240_000))
    at = (1 << 20) - 300  # the passage lies over the place where long texts are cut
    one = base[:at] + PASSAGE + base[at:]
    return [one, PASSAGE + " " + " ".join(rng.choices(VOCAB, k=200)), " ".join(rng.choices(VOCAB, k=230_000)), one[:500_000] + " changed " + one[500_000:]]


TEXTS = long_texts()


def frame(spark):
    assert len(TEXTS[0]) > (1 << 20) + 400 and len(TEXTS[2]) > 1 << 20
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def test_bytes(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(frame(spark)).collect()}
    data, n = [t.encode() for t in TEXTS], 400
    count = Counter(hash(t[a : a + n]) for t in data for a in range(len(t) - n + 1))
    for k, t in enumerate(data):
        edge = np.zeros(len(t) + 1, int)
        for a in range(len(t) - n + 1):
            if count[hash(t[a : a + n])] > 1:
                edge[a] += 1
                edge[a + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        assert got[k] == (len(t), gone.sum(), np.frombuffer(t, np.uint8)[~gone].tobytes())
    assert got[2][1] == 0 < got[1][1]


def test_words(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated(frame(spark)).collect()}
    first: dict[tuple, int] = {}
    for k, t in enumerate(TEXTS):
        w = t.split()
        gone = set()
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a : a + 13]), k) < k:
                gone.update(range(a, a + 13))
        assert got[k] == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert got[3][1] > 200_000


def test_join(spark):
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.shingle_join(frame(spark)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in TEXTS)]
    assert got == {0: (len(sets[0]), 1, 0), 1: (len(sets[1]), 0, 1), 2: (len(sets[2]), 0, 2), 3: (len(sets[3]), 1, 0)}


def test_many_compared_with_one(spark):
    """More pairs at one text than are compared in one place."""
    words = rng.choices(VOCAB, k=80)
    texts = [" ".join(words)] + [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(1, 79)]
    texts = spark.createDataFrame(list(enumerate(texts)), "nid long, x string")
    pairs = texts.where("nid > 0").select(F.col("nid").alias("u"), F.lit(0).cast("long").alias("v"))
    for at_once in (1, 7, 256):
        assert ngram_join.compare(pairs, texts, 5, 75, at_once).count() == 78


def test_long_turns(spark):
    turns = [(1, 0, "user", TEXTS[0] + "</s>"), (1, 1, "assistant", "[/INST]" + TEXTS[2]), (1, 2, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = C.read_back(C.format_chats(df)).first()
    assert r.loss_chars == len(turns[1][3]) and r.loss_sha256 == hashlib.sha256(turns[1][3].encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for _, _, x, t in turns).encode()).hexdigest()


def test_fingerprints_of_edited_items_are_within_the_radius():
    missed = total = 0
    for _ in range(1500):
        w = rng.choices(VOCAB, k=rng.randint(12, 80))
        v = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 12))):
            v[rng.randrange(len(v))] = rng.choice(VOCAB)
        s, t = (D.window_hashes(D._HASHES.of(x), D.WIDTH, D.SEED) for x in (w, v))
        both = sum((Counter(s.tolist()) & Counter(t.tolist())).values())
        if 100 * both >= 75 * (2 * len(s) - both):
            a, b = (D.fingerprints(x, np.zeros(1, np.int64), len(x))[0] for x in (s, t))
            total += 1
            missed += int(D._POPCOUNT[a ^ b].sum()) > D.RADIUS
    assert total > 300 and missed == 0


def test_long_lists_block_by_block(docs, monkeypatch):
    """The same links and components whatever the blocks that long lists are tested in."""
    want = Counter(tuple(r) for r in ngram_join.shingle_join(docs).collect())
    components = Counter(tuple(r) for r in ngram_join.shingle_join(docs, count_links=False).collect())
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 2)
    assert Counter(tuple(r) for r in ngram_join.shingle_join(docs).collect()) == want
    assert Counter(tuple(r) for r in ngram_join.shingle_join(docs, count_links=False).collect()) == components


def test_long_texts_of_the_other_operators(spark):
    long, other = TEXTS[0], TEXTS[2]
    docs = spark.createDataFrame([(0, long, "en", "s1"), (1, long.upper(), "en", "s1"), (2, long + "!", "en", "s1"), (3, "Ein kurzer Satz", "de", "s2")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, keep="max").collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 3: (3, 1, True)}
    tokens = {(r.doc_id, r.mix_tokens) for r in mixing.mix(docs, percent=100, max_epochs=1).collect()}
    assert {d: n for d, n in tokens} == {0: len(long.split()), 1: len(long.split()), 2: len(long.split()), 3: 3}
    net = lang_id.train([x.encode() for x in (long[:3000], "Über allen Gipfeln ist Ruh " * 50)] * 3, ["en", "de"] * 3, 1)
    predicted = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs, net).collect()}
    windows = np.concatenate([lang_id.to_windows(long.encode())])
    assert len(windows) > 8000 and predicted[0][0] == "en" and 0 <= predicted[0][1] <= 1
    items = spark.createDataFrame([(7, PASSAGE), (8, "not in any of them at all here")], "item_id long, text string")
    leaks = D.find_leaks(docs.where("doc_id < 3"), items).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(0, 7), (1, 7), (2, 7)}
    page = f"<nav><a>home</a></nav><article><p>{long}</p><p>{other}</p></article>"
    out = html_extract.extract_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert out.text == f"{long}\n\n{other}" and out.n_chars == len(out.text)


def test_languages_of_all_documents_by_brute_force(spark):
    """The query over a whole table against a plain forward pass, position by position, over every window of every text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = lang_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op2_lang_id(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        total, at, last = np.zeros(len(net.labels)), 0, False
        while not last:
            last = at + lang_id.WINDOW >= len(data)
            x = net.embedding[np.frombuffer(data[at : at + lang_id.WINDOW].ljust(lang_id.WINDOW, b"\0"), np.uint8)]
            tops = [np.max([np.einsum("we,wef->f", x[k : k + w], f) for k in range(lang_id.WINDOW - w + 1)], axis=0) for w, f in zip(lang_id.WIDTHS, net.filters, strict=True)]
            z = np.maximum(np.concatenate(tops) + net.bias, 0) @ net.out + net.out_bias
            p = np.exp(z - z.max())
            total += p / p.sum() * (len(data) - at if last else lang_id.STRIDE)
            at += lang_id.STRIDE
        p = total / len(data)
        assert got[r.doc_id][0] == net.labels[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4
        assert abs(got[r.doc_id][1] - p.max()) < 1e-3
