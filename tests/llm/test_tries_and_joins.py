"""Prefix trie, ranked lexical search and Jaccard join against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import jaccard_join as J
from docloom.llm import lexical_search as L
from docloom.llm import prefix_trie as P

# ---- prefix trie --------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def slow_trie(paths):
    """The nodes of {conversation: [(role, text), ...]}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    own = lambda k: (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        children = lambda x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children(k), sum(not children(x) for x in below), sum(map(own, below)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in convs.items()}


def nodes(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def talks(n, seed, longest=9):
    r = np.random.RandomState(seed)
    return [(int(c), t, "user" if t % 2 else None, f"é{r.randint(2)}") for c in r.permutation(n) for t in range(r.randint(1, longest))]


ODD = [(3, None, "a", "x"), (3, 1, None, None), (3, 1, "", "b"), (3, 1, "", "b"), (-7, 5, "a", "x"), (None, 0, "a", "lost"), (10, 0, "a", "x" * 100_000), (11, 0, "a", "x" * 100_000)]


@pytest.mark.parametrize("block,piece", [(4096, 512), (3, 1)])
def test_trie(spark, monkeypatch, block, piece):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "PIECE", piece)
    rows = talks(40, 1) + [(100, t, "user", "é0") for t in range(30)] + [(101, t, "user", "é0") for t in range(25)] + ODD
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as conv", "2 as pos", "3 as row", "4 as content").repartition(5)
    assert nodes(P.prefix_trie(P.numbered(df))) == slow_trie(ordered(rows))


def test_trie_of_nested_chains(spark):
    rows = [(c, t, "u", str(t) if t < c else f"own {c}") for c in range(20) for t in range(c + 1)]
    assert nodes(P.prefix_trie(P.numbered(spark.createDataFrame(rows, TURNS)))) == slow_trie(ordered(rows))


@pytest.mark.parametrize("block", [2])
def test_rebuilt_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = [(c - 12, *x) for c, *x in talks(60, 5, 12)] + [(c, 0, "user", "no base") for c in range(201, 231) if c % 5] + [(c, t, "user", "same") for c in range(100, 130) for t in range(4)] + ODD
    have = ordered(rows)
    paths = {}
    for c in have:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = have.get(int(math.fmod(c, 5)) * -1 + c, [])[:h] + have[c][h:]
    assert any(not p for p in paths.values())
    turns, every = P.grafted(P.numbered(spark.createDataFrame(rows, TURNS)), lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, 8)
    assert nodes(P.prefix_trie(turns, every)) == slow_trie(paths)


def test_trie_without_conversations(spark):
    for rows in ([], [(None, 1, "a", "b")]):
        assert P.prefix_trie(P.numbered(spark.createDataFrame(rows, TURNS))).collect() == []


# ---- lexical search -----------------------------------------------------------------------------------------


def slow_search(docs, items, k):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(d, Counter(w), len(w)) for d, t in docs if (w := cut(t))]
    n, total, df = len(counts), sum(c[2] for c in counts), Counter(t for c in counts for t in c[1])
    asked, out = {}, []
    for i, t in items:
        asked[i] = asked.get(i, Counter()) + Counter(cut(t))
    for i, want in asked.items():
        found = []
        for d, tf, length in counts:
            m = 75 + 25 * length * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, times in want.items() if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def sentences(n, seed, words=60):
    r = np.random.RandomState(seed)
    return [" ".join(f"Wö{int(x)}" for x in np.minimum(r.zipf(1.3, r.randint(1, 60)), words)) + r.choice([".", "-x", " 7!"]) for _ in range(n)]


@pytest.mark.parametrize("shard,block,looks", [(16384, 1 << 20, 4), (16, 40, 1)])
def test_search(spark, monkeypatch, shard, block, looks):
    monkeypatch.setattr(L, "SHARD_DOCS", shard)
    monkeypatch.setattr(L, "BLOCK_TERMS", block)
    monkeypatch.setattr(L, "LOOKS", looks)
    docs = list(enumerate(sentences(150, 1))) + [(500, None), (501, ""), (502, " .-"), (None, "wö1 wö2"), (3, "again wö3"), (3, "again wö3"), (900, "wö5 " * 20_000)]
    docs += [(600 + i, "Tie WÖ4 tie") for i in range(30)]
    items = [(i, t) for i, t in enumerate(sentences(12, 2))] + [(50, None), (51, "nothing here"), (2, "wö2 wö2"), (2, "wö2 wö2"), (None, "tie"), (60, "wö3 " * 500)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as id", "3 as item", "4 as terms").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as doc_id", "3 as times")
    for k in (20, 3):
        assert sorted((tuple(r) for r in L.search(d, q, k).collect()), key=str) == slow_search(docs, items, k)


def test_search_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    asked, nothing = some.withColumnRenamed("doc_id", "item_id"), none.withColumnRenamed("doc_id", "item_id")
    assert L.search(none, asked).collect() == [] and L.search(some, nothing).collect() == []


def test_lists_that_cannot_qualify_are_not_read(spark):
    import pyarrow as pa

    n = 4000
    words = pa.array([[b"rare", b"common"] if i < 30 else [b"common"] for i in range(n)], pa.list_(pa.binary()))
    tf = pa.array([[1] * len(x) for x in words.to_pylist()], pa.list_(pa.int64()))
    shard = L.Shard(pa.array(range(n)), np.full(n, 10), words, tf, pa.array([b"rare", b"common"]), n, 10 * n)
    probed = []

    class Lists(np.ndarray):
        def __getitem__(self, key):
            probed.append(key)
            return np.asarray(self).__getitem__(key)

    shard.factor = shard.factor.view(Lists)
    least = int(5000 * shard.most[0])
    rows, scores = shard.best(np.array([0, 1]), np.array([5000, 1]), 20, least)
    assert rows.tolist() == list(range(20)) and len(set(scores.tolist())) == 1
    assert sum(isinstance(key, slice) and key.stop - key.start == n for key in probed) <= 1  # taken once, for the documents asked


# ---- Jaccard join -------------------------------------------------------------------------------------------


def slow_sets(texts, k=3):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def slow_join(rows, num=90, den=100):
    sets, label = slow_sets([t for _, t in rows]), list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((g for g in groups[label[i]] if g is not None), default=None)) for i in range(len(rows))), key=str)


def versions(n, seed, sizes):
    r = np.random.RandomState(seed)
    base = [" ".join(f"w{x}" for x in r.randint(0, 5000, size)) for size in sizes]
    out = []
    for i in range(n):
        w = base[r.randint(len(base))].split()
        for _ in range(r.randint(0, 1 + len(w) // 40) if r.rand() < 0.8 else len(w) // 8):
            w[r.randint(len(w))] = f"e{r.randint(3)}"
        cut = r.randint(0, 2 + len(w) // 20)
        out.append((int(i), " ".join(w[cut:])))
    return out


def joined(df, **how):
    return sorted((tuple(r) for r in J.similar_documents(df, **how).collect()), key=str)


@pytest.mark.parametrize("light", [0, 25, 40])
def test_jaccard_join(spark, monkeypatch, light):
    monkeypatch.setattr(J, "boundary", lambda *a: light)
    if light == 25:
        monkeypatch.setattr(J, "LIST_ROWS", 8)
        monkeypatch.setattr(J, "CLASSES", (2, 4, 8))
        monkeypatch.setattr(J, "CHUNK_COUNT", 2)
        monkeypatch.setattr(J, "CHUNK_SHINGLES", 500)
        monkeypatch.setattr(J, "COPIES", 3)
    rows = versions(220, 3, [9, 12, 14, 20, 21, 24, 30, 31, 33, 38, 44, 60, 130, 300])
    rows += [(700, None), (701, ""), (702, " \n\t"), (None, "lone text here"), (None, "one"), (703, "One"), (7, "again"), (7, "again"), (704, "two words"), (705, "TWO  words"), (None, None)]
    rows += [(710 + i, rows[0][1]) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as n", "3 as component_id", "4 as digest").repartition(4)
    got = joined(df)
    assert got == slow_join(rows)
    assert 20 < len({c for _, _, c in got}) < 200


def test_jaccard_join_at_the_threshold(spark):
    # Sets of 19 and 19 shingles with 18 in common are 18/20; with 17 of 18 and 18, 17/19 is below.
    rows = []
    for i, words in enumerate(range(20, 60)):
        base = [f"b{i}-{x}" for x in range(words)]
        rows += [(1000 * i + cut, " ".join(base[: words - cut])) for cut in range(7)]
        rows += [(1000 * i + 100 + cut, " ".join([*base[: words - cut], *(f"c{i}-{x}" for x in range(cut))])) for cut in range(1, 4)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == slow_join(rows)


def test_jaccard_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert joined(df) == []


def test_a_long_text_and_its_copy(spark):
    words = [f"w{i % 9973}-{i % 7}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-600])), (3, " ".join(words[: len(words) // 2])), (4, "x" * 3_000_000), (5, "x" * 3_000_000 + "\n")]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == slow_join(rows)


def test_no_list_is_followed_by_pairs(spark):
    """A group of near copies makes about as many proposals as it has texts."""
    rows = [(i, " ".join([f"e{i}"] + [f"w{x}" for x in range(200)] + [f"f{i % 7}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    collected = J.materialize(J._collected(docs, "doc_id", "text", 3), "t")
    sets = J.materialize(collected.where("n > 0").select("digest", "k", "n", "sketch", "light"), "t")
    entries = J.materialize(J._listed(docs, "text", 3, J._classes(collected), 90, 100), "t")
    assert J.stars(J._proposed(entries, sets, 90, 100)).count() < 800
    assert {c for _, _, c in joined(docs)} == {0}


def test_sketches_rule_out_no_link():
    r = np.random.RandomState(4)
    for size in (1, 5, 63, 64, 65, 200, 1000):
        for _ in range(20):
            a = np.unique(r.randint(0, 2**63, size).astype(np.uint64))
            b = np.unique(np.concatenate((a[: len(a) - len(a) // 25], r.randint(0, 2**63, len(a) // 30).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert J.plausible_forest(np.array([len(a), len(b)]), [J.sketch(a), J.sketch(b)], 90, 100).tolist() == [0, 0]


def test_the_boundary_is_that_of_the_least_cost():
    assert J.subsets_of(8, 40, 90, 100) == 1 and J.subsets_of(9, 40, 90, 100) == 2 and J.subsets_of(10, 40, 90, 100) == 12 and J.subsets_of(10, 9, 90, 100) == 10
    assert J.boundary({20: 100}, {20: 10**9}, 90, 100) >= 20 and J.boundary({20: 10**6}, {20: 10}, 90, 100) < 20 and J.boundary({}, {}, 90, 100) == 0
    for x in (5, 18, 30):
        cost = sum(7 * J.subsets_of(a, x, 90, 100) for a in range(1, x + 1)) + sum(50 for a in range(1, 41) if a >= J.need(x + 1, 90, 100))
        best = J.boundary({a: 7 for a in range(1, 41)}, {a: 50 for a in range(1, 41)}, 90, 100)
        assert cost >= sum(7 * J.subsets_of(a, best, 90, 100) for a in range(1, best + 1)) + sum(50 for a in range(1, 41) if a >= J.need(best + 1, 90, 100))
