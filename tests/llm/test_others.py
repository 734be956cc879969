"""Operators 2, 3, 4, 7, 8 and 10, and the pipeline, against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat_format as C
from lectern.llm import decontaminate as D
from lectern.llm import html_extract as H
from lectern.llm import lang_id as L
from lectern.llm import mixing, queries, token_store

SF = "/root/testdata/sf0.001"


# 2: language identification

def plain_probabilities(net, window):
    e = net.embedding[window]
    h = []
    for w, f in zip(L.WIDTHS, net.filters, strict=True):
        h.append(np.max([sum(e[t + j] @ f[j] for j in range(w)) for t in range(L.WINDOW - w + 1)], axis=0))
    z = np.maximum(np.concatenate(h) + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(z - z.max())
    return p / p.sum()


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = L.fit(docs)
    out = L.predict(docs, net, passing=("lang",)).withColumn("held_out", L.held_out()).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    windows = L.to_windows("".join(r.text for r in docs.limit(3).collect()).encode())[:20]
    assert np.allclose(L.probabilities(net, windows), [plain_probabilities(net, w) for w in windows], atol=1e-5)


def test_language_edges(spark, docs, odd, empty):
    net = L.fit(docs)
    assert set(net.labels) == {"de", "en"}
    got = L.predict(docs, net).collect()
    assert len(got) == docs.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {r.doc_id for r in docs.collect() if not any(map(str.isalpha, r.text or ""))}
    assert Counter((r.doc_id, r.lang_pred) for r in L.predict(odd, net).collect()) == Counter((r.doc_id, r.lang_pred) for r in got)
    assert L.fit(empty) is None and L.predict(empty, None).count() == 0
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("n", [0, 1, 3, 127, 128, 129, 250, 1000])
def test_windows_cover_the_text(n):
    data = bytes(random.Random(n).choices(range(1, 256), k=n))
    w = L.to_windows(data)
    seen = {(bytes(x[k : k + 4])) for x in w for k in range(L.WINDOW - 3)}
    assert all(data[k : k + 4] in seen for k in range(n - 3)) and len(w) == (0 if n == 0 else max(1, -(-(n - 3) // L.STRIDE)))


# 3: chat formatting

def test_escape():
    rng = random.Random(3)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/HEAD]", "\\", "\\.", "a", "<", "[", " ", "é"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        assert C.unescape(C.escape(text)) == text and not C.CONTROL.search(C.escape(text))


def conversations(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] no [/INST]"), (1, 2, None, None), (1, 2, None, None), (2, 0, "system", "be\\."), (2, None, "user", "first"), (None, 0, "assistant", "x"), (3, 0, "tool [/HEAD]", "")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 9)) for k in range(150)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(3)


def test_chats(spark):
    rows, df = conversations(spark)
    formatted = C.format_chats(df)
    got = {r.conv_id: r for r in C.read_back(formatted).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].formatted_chars == len(C.render_inst(turns))
        pieces = sorted((r.seq, r.piece, r.start) for r in formatted.where(F.col("conv_id").eqNullSafe(c)).collect())
        assert "".join(p for _, p, _ in pieces) == C.render_inst(turns)
    assert C.read_back(C.format_chats(df.limit(0))).count() == 0


def test_templates_that_rewrite():
    turns = [(("user", "assistant")[k % 2], f"t{k}") for k in range(60)]
    plain = [x for x in C.spans(iter(turns), C.render_inst, 4)]
    assert "".join(p for p, _ in plain) == C.render_inst(turns) and not any(r for _, r in plain)
    drops = lambda m: "".join(f"<{r}>{x}" if k == len(m) - 1 or r == "user" else f"<{r}>" for k, (r, x) in enumerate(m))
    assert any(r for _, r in C.spans(iter(turns[:4]), drops, 4))
    counts = lambda m: "".join(f"{k}:{x}\n" for k, (_, x) in enumerate(m))
    for n in range(1, 61):  # it only appends
        got = list(C.spans(iter(turns[:n]), counts, 4))
        assert "".join(p for p, _ in got) == counts(turns[:n]) and len(got) == n and not any(r for _, r in got)
    header = lambda m: "HEAD " + C.render_inst(m)
    assert next(C.spans(iter(turns), header, 4))[0].startswith("HEAD <s>")


def test_templates_that_count_are_judged_alike_at_any_length():
    turns = [("system", "s"), *[(("user", "assistant")[k % 2], f"t{k}") for k in range(200)]]
    numbered = lambda m: "".join(f"[{k}]<{r}>{x}" for k, (r, x) in enumerate(m))
    of_all = lambda m: f"{len(m)} turns: " + numbered(m)
    window = lambda m: "".join(f"[{k}]{x if k > len(m) - 50 else ''}" for k, (_, x) in enumerate(m))
    for n in (2, 10, 31, 32, 33, 34, 40, 64, 65, 100, 201):
        got = list(C.spans(iter(turns[:n]), numbered))
        assert "".join(p for p, _ in got) == numbered(turns[:n]) and not any(r for _, r in got), n
        assert any(r for _, r in C.spans(iter(turns[:n]), of_all)), n
        assert any(r for _, r in C.spans(iter(turns[:n]), window)) == (n > 50), n


def test_templates_that_rewrite_far_back():
    turns = [(("user", "assistant")[k % 2], f"t{k}") for k in range(200)]
    last = lambda m: "".join(f"<{r}>{x}" for r, x in m[-40:])
    late = lambda m: "".join(f"<{r}>{x}" if k >= len(m) - 33 else f"<{r}>" for k, (r, x) in enumerate(m))
    for template in (last, late):
        for n in (41, 63, 64, 65, 200):
            assert any(r for _, r in C.spans(iter(turns[:n]), template)), n
    assert not any(r for _, r in C.spans(iter(turns[:40]), last))

    def strict(m):
        rest = m[1:] if m and m[0][0] == "system" else m
        assert all(r == ("user", "assistant")[k % 2] for k, (r, _) in enumerate(rest))
        return "".join(f"<{r}>{x}" for r, x in m)

    for talk in (turns, [("system", "s"), *turns]):
        got = list(C.spans(iter(talk), strict))
        assert "".join(p for p, _ in got) == strict(talk) and not any(r for _, r in got) and len(got) == len(talk)

    seen = [0]
    plain = lambda m: (seen.__setitem__(0, seen[0] + len(m)), C.render_inst(m))[1]
    many = [("system", "s"), *turns * 20]
    got = list(C.spans(iter(many), plain))
    assert "".join(p for p, _ in got) == C.render_inst(many) and seen[0] < 40 * len(many)
    assert list(C.spans(iter([]), plain)) == []


# 4: benchmark decontamination

def test_leaks(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, say(rng.randint(12, 60))) for k in range(30)] + [(90, "two words"), (91, ""), (92, None), (None, say(20)), (0, None)]
    docs = []
    for k in range(150):
        w = say(rng.choice((0, 3, 30, 200))).split()
        if k % 3 == 0:
            own = (items[k % 30][1]).split()
            for _ in range(k % 5):
                own[rng.randrange(len(own))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((k, (" ".join(w)).upper() + "." if k % 2 else ", ".join(w)))
    docs += [(200, "Two, words!"), (201, "there are two words in it"), (None, items[3][1]), (202, None), (5, docs[3][1]), (5, docs[3][1])]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()

    want = {}
    for d, t in docs:
        w = D.words(t or "")
        for i, x in items:
            y = D.words(x or "")
            if 0 < len(y) < 5:
                if w == y:
                    want[d, i] = 1.0
                continue
            bag = Counter(tuple(y[k : k + 5]) for k in range(len(y) - 4))
            best = 0.0
            for a in range(len(w) - len(y) + 1 if y else 0):
                own = Counter(tuple(w[k : k + 5]) for k in range(a, a + len(y) - 4))
                both = sum((bag & own).values())
                best = max(best, both / (2 * sum(bag.values()) - both))
            if best >= 0.75:
                want[d, i] = best
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want)
    assert len(want) > 15 and any(x < 1 for x in want.values())
    assert sum(r.doc_id == 5 for r in got) == 2 * len({r.item_id for r in got if r.doc_id == 5})
    left = D.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    hit = {d for d, _ in want}
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in docs if d not in hit)


def test_leaks_in_documents_shorter_than_the_item(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice((7, 12, 38, 60))))) for k in range(30)] + [(50, " ".join(["again"] * 30))]
    docs = [(100 * i + cut, " ".join(t.split()[:-cut] if cut % 2 else t.split()[cut:])) for i, t in items for cut in range(1, 16) if len(t.split()) > cut]
    want = {}
    for d, t in docs:
        w = t.split()
        own = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for i, x in items:
            y = x.split()
            bag = Counter(tuple(y[k : k + 5]) for k in range(len(y) - 4))
            if sum(bag.values()) > sum(own.values()):
                both = sum((bag & own).values())
                sim = both / (sum(own.values()) + sum(bag.values()) - both)
                if sim >= 0.75:
                    want[d, i] = (sim, 0, len(w))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in D.find_leaks(frame, bench).collect()}
    long = {k: v for k, v in got.items() if v[2] < len(dict(items)[k[1]].split())}
    assert {k: pytest.approx(v) for k, v in want.items()} == long and len(want) > 50
    assert D.Matcher([(1, " ".join(f"w{k}" for k in range(38)))]).find(" ".join(f"w{k}" for k in range(37))) == [(1, 33 / 34, 0, 37)]
    assert {r.doc_id for r in D.without_leaks(frame, bench).collect()}.isdisjoint(d for d, _ in want)


def test_leaks_in_blocks(spark, docs, empty):
    b = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(20)], "item_id long, text string")
    own = b.selectExpr("item_id + 1000 as doc_id", "concat('ahead ', text) as text", "1 as i", "2 as d")
    assert {(r.doc_id, r.item_id, r.start_word) for r in D.find_leaks(own, b, block_bytes=500).collect()} == {(k + 1000, k, 1) for k in range(20)}
    assert D.find_leaks(docs, b.limit(0)).count() == 0 and D.find_leaks(empty, b).count() == 0
    assert D.without_leaks(docs, b.limit(0)).count() == docs.count()


# 7: mixing

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), c.execute(queries.ORACLE_SQL[name]).fetchall()
    names = [x[0] for x in c.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(str(r[x]) for x in names) for r in got.collect()) == Counter(tuple(map(str, r)) for r in want)


def test_mixing(spark, docs, odd, empty):
    c = duckdb.connect()
    frame = docs.toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    c.register("documents", frame)
    want = c.execute(queries.ORACLE_SQL["op7_mix_sources"]).fetchall()
    for df in (docs, odd):
        out = mixing.mix(df)
        assert out.columns[: len(df.columns)] == df.columns
        assert Counter(tuple(r) for r in out.select("doc_id", "mix_epoch", "mix_domain", "lang", "source", "mix_tokens").collect()) == Counter(want)
    assert mixing.mix(empty).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = [("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "e", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r.source: r.share for r in mixing.budgets(leaves, 50, 1).collect()}
    domain0 = 1550 * 40 // 70
    assert got["a"] == 100 and got["a"] + got["b"] == domain0 * 50 // 70 and got["c"] == domain0 * 20 // 70 and got["e"] == 1550 * 30 // 70


# 8: token store

def test_store(spark, docs, odd, empty, rows, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    for df in (docs, odd):
        folder = token_store.write_store(df, path)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, folder).collect())
        assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
        ids = {}
        for i, text, *_ in rows:
            x = t.encode(text or "", add_special_tokens=False).ids + [1]
            ids.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start = 0
        for s, _, n, _ in got:
            assert s == start
            start += n
        back = {}
        for _, i, n, crc in got:
            back.setdefault(i, []).append((n, crc))
        assert {i: sorted(x) for i, x in back.items()} == {i: sorted(x) for i, x in ids.items()}
    starts = {r.start: list(r.ids) for r in token_store.read_ids(spark, folder).collect()}
    assert all(zlib.crc32(np.array(starts[s], "<u4").tobytes()) == crc for s, _, _, crc in got)
    stored = spark.read.parquet(f"{folder}/store").where("kind = 'chunk'")
    assert stored.count() == stored.select("key").distinct().count()
    assert token_store.read_store(spark, token_store.write_store(empty, path)).count() == 0


def test_damage_is_found(spark, docs, tmp_path):
    folder = token_store.write_store(docs, queries.vocabulary(), str(tmp_path / "s"))
    bad = spark.read.parquet(f"{folder}/store").withColumn("payload", F.when(F.col("kind") == "chunk", F.concat(F.col("payload"), F.unhex(F.lit("0000")))))
    bad.write.partitionBy("kind").parquet(f"{folder}-2/store")
    for part in ("index", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}-2/{part}")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, f"{folder}-2").collect()


def test_damage_of_index_and_manifest_is_found(spark, docs, tmp_path):
    """Rows of either that are lost, doubled, exchanged or shifted; recipes that are changed."""
    folder = token_store.write_store(docs.repartition(5), queries.vocabulary(), str(tmp_path / "s"))
    assert token_store.read_store(spark, folder).count() == docs.count()
    parts = {x: spark.read.parquet(f"{folder}/{x}").collect() for x in ("index", "manifest")}
    schemas = {"index": token_store.INDEX_DDL, "manifest": token_store.MANIFEST_DDL}
    at = {x: max(range(len(rows)), key=lambda k: len(rows[k])) for x, rows in parts.items()}
    last = max(range(len(parts["index"])), key=lambda k: (parts["index"][k].segment, parts["index"][k].pos))
    other = next(k for k, r in enumerate(parts["index"]) if k != at["index"] and r.n_tokens != parts["index"][at["index"]].n_tokens and r.doc_id is not None)

    def shift(rows, k, **by):
        return [{**r.asDict(), **({c: r[c] + n for c, n in by.items()} if j == k else {})} for j, r in enumerate(rows)]

    def exchange(rows, a, b, column):
        out = [r.asDict() for r in rows]
        out[a][column], out[b][column] = out[b][column], out[a][column]
        return out

    whole = {x: [r.asDict() for r in rows] for x, rows in parts.items()}
    of_last = whole["index"][last]["segment"]
    cases = [("index", shift(parts["index"], other, **{c: 1})) for c in ("ahead", "n_tokens", "doc_id", "pos")]
    cases += [("index", [r for k, r in enumerate(whole["index"]) if k != j]) for j in (at["index"], last)]
    cases += [("index", [*whole["index"], whole["index"][last]]), ("index", exchange(parts["index"], at["index"], other, "doc_id")), ("index", exchange(parts["index"], at["index"], other, "root"))]
    cases += [("manifest", whole["manifest"][1:]), ("manifest", [*whole["manifest"], whole["manifest"][0]]), ("manifest", shift(parts["manifest"], 0, start=1)), ("manifest", shift(parts["manifest"], 0, n_docs=1))]
    for n, (part, rows) in enumerate(cases):
        bad = f"{folder}-{n}"
        spark.read.parquet(f"{folder}/store").write.partitionBy("kind").parquet(f"{bad}/store")
        for x in parts:
            spark.createDataFrame([tuple(r[c.split()[0]] for c in schemas[x].split(", ")) for r in (rows if x == part else whole[x])], schemas[x]).write.parquet(f"{bad}/{x}")
        with pytest.raises(Exception, match="damaged"):
            token_store.read_store(spark, bad).collect()
    # A segment that is gone from both: the store's own root tells.
    bad = f"{folder}-both"
    spark.read.parquet(f"{folder}/store").write.partitionBy("kind").parquet(f"{bad}/store")
    for x in parts:
        spark.read.parquet(f"{folder}/{x}").where(F.col("segment") != of_last).write.parquet(f"{bad}/{x}")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, bad)


@pytest.mark.parametrize("n", range(19))
def test_tree_that_grows(n):
    leaves, tree = [token_store.digest(bytes([k])) for k in range(n)], token_store.Tree()
    for x in leaves:
        tree.add(x)
    assert tree.root() == token_store.merkle(leaves)


def test_encoder_and_cuts():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t, e = Tokenizer.from_file(path), token_store.Encoder(path)
    texts = ["it's <|endoftext|> x", "Ünï <|ENDOFTEXT|> naïve café 12a a.b", "İstanbul ΑΣ ΣΑΣ. ́x ﬁne ½", "hi\x1cthere\x85z", "日本語テキスト。", "ǅ! ß? ;", ""]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode([x.encode() for x in texts])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40000, 30000).astype(np.uint32)
    c = token_store.cuts(ids)
    assert c[-1] == len(ids) and all(0 < b - a <= 4096 for a, b in zip([0, *c], c, strict=False))
    moved = token_store.cuts(np.concatenate([rng.integers(0, 40000, 777).astype(np.uint32), ids]))
    assert len({x - 777 for x in moved} & set(c)) > 0.8 * len(c)


def test_words_are_looked_up_once():
    """Distinct words of the texts given together, whose marks are pre-tokens of their own; the library sees no word whole that is Latin letters and marks."""
    from tokenizers import Tokenizer

    path, asked, whole = queries.vocabulary(), [], []

    class Counting(token_store.Encoder):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    e, t = Counting(path), Tokenizer.from_file(path)

    class Library:
        def encode(self, text, **kw):
            whole.append(text)
            return t.encode(text, **kw)

    e.tokenizer = Library()
    texts = ["the Stoß%%% "] * 500 + ["", " \t the\x0b\x0cthe\n", "ÜBER?! naïve###."]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode([x.encode() for x in texts])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) < 30 and not whole
    odd = ["a<b ü<", "ü's it's ñ'", "é,x ñ1 1ñ. ñ.ñ", "x\u0301, =\u0338 ,\u0338 ü\u0301!", "。, 、! ü。.", "...", "", "İ! ǅ?? ẞ."]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode([x.encode() for x in odd])] == [x.ids for x in t.encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("most", [1, 7, 40, 1 << 20])
def test_portions(most):
    texts = ["ab", None, "", "é" * 20, "abc", "d", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["d", "t"])
    parts = list(token_store.portions(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), most))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts + texts[2:5]
    assert all(p.num_rows and (p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= most) for p in parts)


def test_marks_do_not_depend_on_blocks():
    ids = np.random.default_rng(3).integers(0, 40000, 5000).astype(np.uint16)
    x = token_store.mix64(ids.astype(np.uint64) + np.uint64(1))
    for window in (1, 2, 7, 8, 11):
        h = np.zeros(len(x) - window + 1, np.uint64)
        for j in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(h)]
        want = np.flatnonzero(token_store.mix64(h) < np.uint64((1 << 64) // 16)) + window
        assert len(want) > 100 and all(np.array_equal(want, token_store._marks(ids, window, 16, n)) for n in (1, 100, 4096, 1 << 15))
        assert not len(token_store._marks(ids[: window - 1], window, 16))


def test_checksum_of_parts():
    rng = random.Random(2)
    parts = [rng.randbytes(rng.randint(0, 300)) for _ in range(40)]
    whole = b"".join(parts)
    after = np.array([sum(map(len, parts[k + 1 :])) for k in range(40)])
    shares = token_store.crc_share(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), after)
    assert token_store.crc_whole(np.array([np.bitwise_xor.reduce(shares)]), np.array([len(whole)]))[0] == zlib.crc32(whole)


# 10: HTML extraction

PAGES = [
    ("<body><header><h1>Site</h1></header><nav><a href=x>a</a></nav><main><h1>T</h1><p>Hello <a href=1>link</a> w.<p class='notice'>cookie</p>Fine &amp;amp; ok<div class='comments'><p>bad</p></div><aside>s</aside><form><input><label>x</label></form><ul><li>one<li>two</ul></main><script>var a='</p>'</script><footer>f</footer>", "T\n\nHello link w.\n\nFine &amp; ok\n\none\n\ntwo"),
    ("<html><body><div id=nav><a>x</a> <a>y</a></div><article><b>Bold&nbsp;&nbsp;text<br>more<p>Un&eacute;</article><div class=\"sidebar\">zzz</div><!-- <p>no</p> --></body>", "Bold text more\n\nUné"),
    ("<p>" + "word " * 40 + "</p><div class='ad'>" + "buy " * 30 + "</div><p>Second one with some words in it.</p>", ("word " * 40).strip() + "\n\nSecond one with some words in it."),
    ("", ""),
    (None, ""),
    ("<style>p{}</style><title>t</title>", ""),
    ("plain text without any markup < 3 at all", "plain text without any markup < 3 at all"),
    ("<article><p>A<b>b</p><p>c</b>d <!-- unclosed", "Ab\n\ncd"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_extract(page, text):
    assert H.extract(page, H.trained()) == text


def test_pages(spark):
    df = spark.createDataFrame([(k, f"u{k}", p, 1) for k, (p, _) in enumerate(PAGES)] + [(None, None, None, None), (0, "u0", PAGES[0][0], 1)], "page_id long, url string, html string, n int")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in H.extract_text(df).collect())
    assert got == Counter([(k, f"u{k}", t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(None, None, "", 0), (0, "u0", PAGES[0][1], len(PAGES[0][1]))])
    assert H.extract_text(df.limit(0)).count() == 0


def test_words_and_links_decide_without_markers():
    tree, long = H.trained(), " ".join(["word"] * 200)
    links = "<ul>" + "<li><a href=x>More here</a></li>" * 4 + "</ul>"
    assert H.extract(f"<h1>Two words</h1><p>{long}</p>{links}", tree) == f"Two words\n\n{long}"
    assert H.extract(f"<h1>Head</h1><div class='post-meta'>By X</div><p>{long}</p>{links}", tree) == f"Head\n\nBy X\n\n{long}"
    assert H.extract(f"<article><p>{long}</p></article><p>{long[:300]}</p>", tree) == long
    assert all(H.decide(tree, (words, own, 2, before, 3, after, 0, 0)) for words in (25, 90, 300) for own in (0, 0.2) for before in (0, 0.5, 1) for after in (0, 0.5, 1))


def test_tree_fits_its_table():
    tree = H.trained()
    for line in H.LABELLED.strip().splitlines():
        *row, label = map(float, line.split())
        assert H.decide(tree, row) == (label == 1), line


# The pipeline

def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} >= {r.doc_id for r in docs.collect() if len(r.text) > 20}
    rows = [(r.doc_id, r.text) for r in kept.collect()]

    from test_dedup import brute_components

    _, groups = brute_components(rows)
    near = stages["ngram_join"](spark, kept, SF)
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {min(rows[a][0] for a in g) for g in groups}
    clean = stages["decontaminate"](spark, near, SF)
    items = [D.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    said = {r.doc_id: " ".join(D.words(r.text)) for r in near.collect()}
    left = {r.doc_id for r in clean.collect()}
    assert not any(" ".join(i) in said[d] for d in left for i in items) and clean.columns == columns
    gone = set(said) - left
    assert all(any(" ".join(i[k : k + 5]) in said[d] for i in items for k in range(len(i) - 4)) for d in gone)
    mixed = stages["mix_sources"](spark, clean, SF)
    assert mixed.columns == columns
    out = P.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect()) and len(out) > 100
