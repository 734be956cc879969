"""Operators 11 and 12 against brute force, and the prefix sums they rest on."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from lectern.llm import prefix_sums, prefix_trie, queries, simhash

TURNS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()
    )


def conversations(seed, n=80, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -5, 10**12 + 3]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(("user", "assistant", None)) if t else "user", rng.choice(("a", "ü b", "", None)) if t else "hello"))
    rows += [rows[3], rows[3], (4, None, None, None), (4, None, "x", "first of all"), (None, 1, "user", "nobody's"), (6, 3, "user", "w " * 400_000)]
    return rows


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    from pyspark.sql import functions as F

    odd = df.select("*", *[F.lit(k).alias(x) for k, x in enumerate(("c", "t", "r", "x", "pos", "n", "h", "base", "one", "bytes", "rank", "depth", "p1", "last"))])
    want = brute_trie(rows)
    out = prefix_trie.prefix_trie(odd if seed == 1 else df).collect()
    assert Counter(tuple(r[x] for x in COLUMNS) for r in out) == want
    by = {r.preorder: r for r in out}
    assert sorted(by) == list(range(len(out)))
    for r in out:  # intervals: leaves below are counted in them
        assert sum(by[k].n_children == 0 for k in range(r.preorder, r.subtree_end + 1)) == r.n_leaves


def test_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    c = next(c for c in range(6, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "gone")]
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert Counter(tuple(r[x] for x in COLUMNS) for r in out) == brute_trie(rows) and len(out) == 1


def test_trie_hot_conversation_and_copies(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(600)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 300) for t in range(10)]
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(7)).collect()
    assert Counter(tuple(r[x] for x in COLUMNS) for r in out) == brute_trie(rows)


def test_trie_query_matches_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = duck.execute(queries.ORACLE_SQL["op11_prefix_trie"]).fetchall()
    names = [x[0] for x in duck.description]
    got = queries.QUERIES["op11_prefix_trie"](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[x] for x in names) for r in got.collect()) == Counter(want)


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    group = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(500, 17)]))
    value = rng.integers(-(1 << 62), 1 << 62, 800)
    rows = [(int(g), k, int(v)) for k, (g, v) in enumerate(zip(group, value, strict=True))]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(6)
    for within in ("g", None):
        got = {r.k: (r.v_before, r.v_upto) for r in prefix_sums.running(df, ["g", "k"], ["v"], within).collect()}
        at, last = 0, None
        for g, k, v in rows:
            at = 0 if within and g != last else at
            last, ahead, at = g, at, (at + v + (1 << 63)) % (1 << 64) - (1 << 63)
            assert got[k] == (ahead, at)


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """The root of each fingerprint by all pairs of distinct ones."""
    distinct = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[k + 1 :] ^ distinct[k]) <= radius).tolist():
            root[find(k)] = find(k + 1 + j)
    at = {int(f): find(k) for k, f in enumerate(distinct)}
    return [at[f] for f in prints]


def check_groups(out, rows):
    prints = [brute_fingerprint(x[1]) for x in rows]
    groups = brute_components(prints)
    least = {}
    for (i, *_), g in zip(rows, groups, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == Counter((x[0], f"{f:016x}", least.get(g)) for x, f, g in zip(rows, prints, groups, strict=True))


def test_simhash(docs, odd, empty, rows):
    for df in (docs, odd):
        check_groups(simhash.simhash_groups(df).collect(), rows)
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_groups(queries.QUERIES["op12_simhash"](spark, SF).collect(), rows)


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choices(["A", "bb", "ccc", "dö"], k=5000))
    want = brute_fingerprint(text)
    for piece in (1, 7, 4999, 1 << 16):
        monkeypatch.setattr(simhash, "PIECE", piece if piece > 1 else 3)
        assert simhash.fingerprint(text.encode()) == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_what_all_pairs_do(spark, radius):
    """Centres with their neighbours at 0 to 5 bits, and a list longer than the one whose pairs are tried."""
    rng = random.Random(radius)
    found = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(20):
            found.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    base = rng.getrandbits(64)
    found |= {base ^ x << 40 for x in rng.sample(range(1 << 14), 5000)}
    prints = sorted(found)
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in prints], "f long").repartition(3)
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, radius).collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in links)
    root = {f: f for f in prints}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links:
        root[find(a)] = find(b)
    want, got = defaultdict(set), defaultdict(set)
    for f, g in zip(prints, brute_components(prints, radius), strict=True):
        want[g].add(f)
        got[find(f)].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
