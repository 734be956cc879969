"""Operators 1, 5, 6 and 9 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import count_min, exact_dedup, ngram_join, substring_dedup, suffix_dedup
from lectern.llm.suffix_sort import suffix_array


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(docs, odd, empty, rows, keep):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        stay = sorted(ids, key=lambda i: i != best)
        for n, i in enumerate(stay):
            want[i, best, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for df in (docs, odd, docs.coalesce(1)):
        assert got(exact_dedup.exact_dedup(df, keep=keep), *columns) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_group_over_many_partitions(spark):
    df = spark.createDataFrame([(k, "same" if k % 2 else f"t{k}") for k in range(400)], "doc_id long, text string").repartition(8)
    out = exact_dedup.exact_dedup(df, keep="max").collect()
    same = [r for r in out if r.doc_id % 2]
    assert {(r.keep_id, r.group_size) for r in same} == {(399, 200)} and [r.doc_id for r in same if r.kept] == [399]
    assert all(r.kept and r.group_size == 1 for r in out if r.doc_id % 2 == 0)


def test_sketch_misses_nothing(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    twice = np.concatenate([h, h[:500], h[:100]])
    df = spark.createDataFrame([(int(x),) for x in twice.astype(np.int64)], "h long").repartition(5)
    take = lambda b: iter([b.column(0).to_numpy().astype(np.uint64)])
    for least, n in ((2, 500), (3, 100)):
        bits = np.frombuffer(count_min.frequent_bits(df, take, 20, least), np.uint8)
        found = count_min.estimated_frequent(bits, h, 20)
        assert found[:n].all() and found.sum() < n + 20


def test_substrings(docs, odd, empty, rows):
    width, first = 13, {}
    big = 1 << 63
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, big), big if i is None else i)
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (big if i is None else i):
                gone[k : k + width] = [True] * width
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    assert sum(n for (_, _, n, _) in want) > 100
    for df in (docs, odd):
        assert got(substring_dedup.remove_repeated(df), "doc_id", "n_words", "n_removed", "kept_text") == want
    # A sketch far too small only lets more windows through.
    assert got(substring_dedup.remove_repeated(docs, most_bits=20), "doc_id", "n_words", "n_removed", "kept_text") == want
    assert substring_dedup.remove_repeated(empty).count() == 0


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice((1, 2, 3, 6))) for _ in range(rng.randint(0, 16))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_windows():
    rng = random.Random(6)
    for r in range(200):
        pool = [bytes(rng.choices(b"ab " if r % 2 else b"abcdefgh ", k=rng.randint(1, 60))) for _ in range(4)]
        texts = [b"".join(rng.choices(pool, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 5))]
        length = rng.choice((3, 8, 20))
        c = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        for t, found in zip(texts, suffix_dedup.repeated_windows(texts, length), strict=True):
            assert found.tolist() == [c[t[k : k + length]] > 1 for k in range(len(t) - length + 1)]


@pytest.mark.parametrize("length", [80, 400])
def test_bytes(docs, odd, empty, rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    c = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    want = Counter()
    for (i, *_), t in zip(rows, texts, strict=True):
        edge = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if c[t[k : k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])] += 1
    assert sum(n for (_, _, n, _, _) in want) > 100
    for df in (docs, odd)[: 1 if length == 80 else 2]:
        out = suffix_dedup.remove_repeated_bytes(df, length)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == want
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_bytes_of_planted_passages(spark):
    """Passages of 51 to 90 words in two documents each: found by n_removed if and only if they have 400 bytes; n_bytes, the input's length, tells nothing."""
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    texts, want = [], []
    for n in range(51, 91):
        passage = some(n)
        shared = len(passage) + 2  # with the blanks around it; what stands next to these differs
        for x in "xy":
            texts.append(f"{some(rng.randint(20, 200))} {x} {passage} {x} {some(rng.randint(20, 200))}")
            want.append(shared if shared >= 400 else 0)
    texts += [some(rng.randint(1, 400)) for _ in range(40)]
    want += [0] * 40
    assert 20 < sum(x > 0 for x in want) < 70
    out = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in out.collect()}
    assert found == {k: (len(t), n, int(n > 0)) for k, (t, n) in enumerate(zip(texts, want, strict=True))}


def brute_components(rows, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = lowered(t).encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    to = list(range(len(rows)))

    def root(a):
        while to[a] != a:
            a = to[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                to[root(a)] = root(b)
    members = {}
    for a in range(len(rows)):
        members.setdefault(root(a), []).append(a)
    return sets, list(members.values())


def test_links_within_components_are_counted(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    rows = []
    for size in (60, 9, 200):
        base = rng.choices(vocab, k=size)
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(size)] = "edited" + str(rng.randrange(5))
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, (_, t) in enumerate(rows[:3])] + [(900, None), (901, "two words"), (None, rows[7][1])]
    sets, _ = brute_components(rows_ := [(d, t or "") for d, t in rows])
    distinct = set(sets)
    links = lambda a: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) and bool(a & b) for b in distinct)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.shingle_join(df)
    assert Counter((r.doc_id, r.n_links) for r in got.collect()) == Counter((d, links(s)) for (d, _), s in zip(rows_, sets, strict=True))
    assert max(map(links, distinct)) > 10
    plain = ngram_join.shingle_join(df, count_links=False)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, got.drop("n_links").collect()))


def test_join(docs, odd, empty, rows):
    sets, groups = brute_components(rows)
    want = Counter()
    for members in groups:
        ids = [rows[a][0] for a in members if rows[a][0] is not None]
        for a in members:
            want[rows[a][0], len(sets[a]), min(ids) if ids else None] += 1
    for df in (docs, odd):
        assert got(ngram_join.shingle_join(df), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.shingle_join(empty).count() == 0


def test_keep_one(docs, empty, rows):
    sets, groups = brute_components(rows)
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for members in groups:
        ids = [rows[a][0] for a in members]
        if not sets[members[0]]:
            want.update(ids)
        else:
            known = [i for i in ids if i is not None]
            want[min(known) if known else None] += 1
    assert kept == want
    assert ngram_join.keep_one(empty).count() == 0


def test_near_threshold_sets():
    """Light sets meet in a subset, heavy ones in a prefix, whenever they are similar enough."""
    rng = random.Random(8)
    for _ in range(1500):
        n = rng.randint(1, 14)
        a = set(rng.sample(range(40), n))
        b = set(a)
        for _ in range(rng.randint(0, 4)):
            b.discard(rng.choice(sorted(b))) if b and rng.random() < 0.5 else b.add(rng.randrange(40))
        if not b:
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if ngram_join.similar(x, y, 75):
            if max(len(a), len(b)) <= ngram_join.MOST_LIGHT:
                assert set(ngram_join.light_keys(x, 75)) & set(ngram_join.light_keys(y, 75))
            assert set(x[: ngram_join.prefix_length(len(x), 75)]) & set(y[: ngram_join.prefix_length(len(y), 75)])
