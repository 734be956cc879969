"""Columns of the input that are named like what operators use or add; vocabularies of other kinds; hostile pages."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, ngram_join, queries, token_store
from lectern.llm import decontaminate as D
from lectern.llm import html_extract as H
from lectern.llm import lang_id as L
from lectern.llm import mixing

SF = "/root/testdata/sf0.001"
WITHIN = ("_d", "_k", "_n", "_domain", "_lang", "_source", "_cut_epoch", "_cut_key", "_cut_id", "mix_epoch", "mix_domain", "mix_tokens", "lang_pred", "score", "item_id", "i", "d", "t")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit(k + 5).alias(c) for k, c in enumerate(WITHIN)])


def rows(df):
    return Counter(str(tuple(r)) for r in df.collect())


def own(df):
    return {c: r[c] for r in df.limit(1).collect() for c in WITHIN}


def test_keep_one(docs, odd, clashing):
    plain = rows(ngram_join.keep_one(docs))
    for df in (odd, clashing):
        out = ngram_join.keep_one(df)
        assert out.columns == df.columns and rows(out.select(*docs.columns)) == plain
    assert own(out) == {c: k + 5 for k, c in enumerate(WITHIN)}


def test_mix(docs, clashing):
    plain = rows(mixing.mix(docs))
    out = mixing.mix(clashing)
    assert sorted(out.columns) == sorted(clashing.columns) and rows(out.select(*docs.columns, *mixing.ADDED)) == plain
    taken = mixing.take(clashing)
    assert taken.columns == clashing.columns and own(taken) == {c: k + 5 for k, c in enumerate(WITHIN)}
    assert rows(taken.select(*docs.columns)) == rows(mixing.take(docs))


def test_predict(docs, clashing):
    net = L.fit(docs)
    plain = rows(L.predict(docs, net).select("doc_id", "lang_pred", "score"))
    out = L.predict(clashing, net, passing=tuple(clashing.columns))
    assert sorted(out.columns) == sorted(clashing.columns) and rows(out.select("doc_id", "lang_pred", "score")) == plain
    other = L.predict(clashing, net, passing=("lang_pred",), pred_col="p", score_col="q")
    assert other.columns == ["doc_id", "lang_pred", "p", "q"] and {r.lang_pred for r in other.collect()} == {WITHIN.index("lang_pred") + 5}


def test_leaks(spark, docs, clashing):
    b = docs.where("length(text) > 60").limit(5).select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 50).alias("text"), F.lit(1).alias("d"), F.lit(2).alias("i"))
    assert rows(D.find_leaks(clashing, b)) == rows(D.find_leaks(docs, b))
    out = D.without_leaks(clashing, b)
    assert out.columns == clashing.columns and rows(out.select(*docs.columns)) == rows(D.without_leaks(docs, b))


def test_shared_folder(spark):
    assert common.shared_dir(spark)
    a, b = common.fresh("x", "x")
    assert a != b and common.fresh("x") != [a]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_vocabulary(spark, name):
    from tokenizers import Tokenizer

    path = queries.vocabulary(name)
    t, e = Tokenizer.from_file(path), token_store.Encoder(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text] + ["a  b\n\n c", " lead", "tail ", "x<|endoftext|> y", "Ünï\tİ"]
    kind = "<u2" if e.kind == "H" else "<u4"
    assert [np.frombuffer(x, kind).tolist() for x in e.encode([x.encode() for x in texts])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_store_of_very_long_texts(spark):
    import zlib

    from tokenizers import Tokenizer

    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(vocab, k=250_000))
    assert len(long) > 1 << 20
    df = spark.createDataFrame([(1, long), (2, long), (3, "x" * (1 << 20))], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, token_store.write_store(df, queries.vocabulary())).collect()}
    t = Tokenizer.from_file(queries.vocabulary())
    for d, text in ((1, long), (2, long), (3, "x" * (1 << 20))):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got[d] == (len(ids), zlib.crc32(ids.tobytes()))


LONG = " ".join(["word"] * 200)
HOSTILE = {
    "tags that never end": "<a " * 40_000, "quotes that never end": '<a "' * 20_000, "stray end tags": "<div>" * 20_000 + "</x>" * 20_000, "inline end tags": "<u><div>" + "<i>" * 20_000 + "</u>" * 20_000,
    "nested": "<div>" * 50_000, "closed elements": "<svg/>" * 40_000, "comments": "<!--" * 40_000, "values": '<a b="' * 20_000, "scripts": "<script>" * 20_000, "less than": "<" * 100_000, "declarations": "<!x" * 50_000, "links": "<a>" * 40_000, "paragraphs": "<p><b>" * 20_000, "references": "&amp" * 50_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    tree, began = H.trained(), time.time()
    H.extract(HOSTILE[name], tree)
    H.extract(HOSTILE[name] + f"<article><p>{LONG}</p></article>", tree)
    assert time.time() - began < 2


def test_doubtful_names():
    tree = H.trained()
    page = f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{LONG}</p></section><div class=related><h3>Related</h3><ul><li><a>one two</a><li><a>three four</a></ul></div></article>"
    assert H.extract(page, tree) == f"Title\n\n{LONG}\n\nRelated work\n\n{LONG}"
    page = f"<nav><a>x</a></nav><div class='has-sidebar'><article><p>{LONG}</p><p>say <span class=ad>buy</span> more</p><ol class='comment-list'><article><p>{LONG}</p></article></ol></article></div>"
    assert H.extract(page, tree) == f"{LONG}\n\nsay more"
    assert H.extract(f"<div id='wrapper-with-sidebar'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", tree).count(LONG) == 3  # words and links overrule a class name


def test_lists_of_links_stay_or_go_as_one():
    tree, text = H.trained(), LONG
    links = lambda *said: "<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in said) + "</ul>"
    refs = ("first reference", "second reference", "third one of them", "fourth")
    for n in (1, 2, 3, 4):
        body = f"<article><h1>Title</h1><p>{text}</p><h2>References</h2>{links(*refs[:n])}</article>"
        want = "\n\n".join(["Title", text, "References", *refs[:n]])
        for page in (body, body + "<footer><a>terms of use</a></footer>", "<nav><a>home</a> <a>news</a></nav>" + body + f"<aside>{links('buy', 'now')}</aside>"):
            assert H.extract(page, tree) == want
        assert H.extract(f"<article><h1>T</h1><p>{text}</p>{links(*refs[:n])}<p>{text}</p></article>", tree) == "\n\n".join(["T", text, *refs[:n], text])
    assert H.extract(f"<article><p>{text}</p><p><a>Read this</a></p><p><a>And that</a></p><p><a>And more</a></p></article>", tree) == "\n\n".join([text, "Read this", "And that", "And more"])
    # A menu at the head of a main element, lists of adverts and of related pages, and lists outside of it go as ever.
    assert H.extract(f"<main>{links('home', 'our news', 'contact')}<h1>Title words here</h1><p>{text}</p></main>", tree) == f"Title words here\n\n{text}"
    assert H.extract(f"<article><p>{text}</p><div class=ads>{links('buy this', 'now')}</div><div class=related-posts>{links('one two', 'three')}</div></article>{links('a b', 'c d')}", tree) == text
    # No main element: words and links of block and neighbours alone.
    assert H.extract(f"{links('home', 'news', 'contact us')}<h1>Two words</h1><p>{text}</p><p>{text}</p>{links('terms', 'privacy', 'help')}", tree) == f"Two words\n\n{text}\n\n{text}"


def test_words_and_links_count():
    """Held out, words and links add to what markup tells, and markup to them."""
    whole, counts, markup = H.held_out_accuracy(), H.held_out_accuracy(tuple(range(6))), H.held_out_accuracy((6, 7))
    assert whole > 0.85 and whole > counts + 0.1 and whole > markup + 0.1

    def used(tree):
        return {tree[0]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    assert {H.FEATURES[f] for f in used(H.trained())} >= {"words", "link_density", "words_before", "words_after", "link_density_after"}


class Article(HTMLParser):
    """What stands in article elements, by the standard library's parser."""

    BREAKS = frozenset("p h1 h2 h3 ul ol li div article section table tr td blockquote pre".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in self.BREAKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.blocks.append("")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_all_pages_against_another_parser(spark):
    tree = H.trained()
    pages = [r for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html]
    got = {r.page_id: r.text for r in queries.op10_html_extract(spark, SF).collect()}
    for r in pages:
        assert re.search("<(nav|footer|div class=.ad.)", r.html)
        p = Article()
        p.feed(r.html)
        p.close()
        want = "\n\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)
        assert got[r.page_id] == want == H.extract(r.html, tree)
