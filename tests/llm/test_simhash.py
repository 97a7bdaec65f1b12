import numpy as np
import pytest
import xxhash

from corpus_pipeline import NEAR
from docloom.llm import simhash as S


def slow_fingerprint(text, k=4):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n\t ", "one", "One two THREE", "a b c d e f g", "É é x y z É", "w " * 700, " ".join(map(str, range(5000)))])
def test_fingerprint(text):
    assert int.from_bytes(S.fingerprint(text), "big") == slow_fingerprint(text)


@pytest.mark.parametrize("n,size,radius", [(2, 8, 4), (63, 8, 4), (64, 8, 4), (65, 8, 4), (300, 8, 20), (200, 32, 100), (70, 8, 0), (70, 8, 30)])
def test_linked_pairs(n, size, radius):
    r = np.random.RandomState(n + radius)
    fps = r.randint(0, 256, (n, size)).astype(np.uint8)
    fps[n // 2 :] = fps[: n - n // 2]
    for i in range(n):
        for b in r.choice(size * 8, r.randint(0, 8), replace=False):
            fps[i, b // 8] ^= 1 << (b % 8)
    d = np.array([[np.unpackbits(a ^ b).sum() for b in fps] for a in fps])
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= radius}
    assert set(zip(*map(np.ndarray.tolist, S.linked_pairs(fps, radius)))) == want


def slow_components(rows, radius=4):
    ids = [i for i, _ in rows]
    fps = [slow_fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(ids[i])
    return sorted(((ids[i], min((g for g in groups[label[i]] if g is not None), default=None)) for i in range(len(rows))), key=str)


def texts(n, seed):
    r = np.random.RandomState(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(r.choice(words, 300)) for _ in range(n // 5)]
    out = []
    for i in range(n):
        w = base[r.randint(len(base))].split()
        for _ in range(r.randint(0, 4)):
            w[r.randint(len(w))] = "edit"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("cell_rows", [1024, 16])
def test_components(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(S, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(S, "BLOCK_ROWS", cell_rows)
    rows = texts(120, 3) + [(500, None), (501, ""), (502, "  "), (None, "lone text here"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as cell", "3 as component_id")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == slow_components(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).collect() == []
    assert S.one_of_each(df).collect() == []


def test_tables_are_exact():
    for rows in (10, 10**5, 10**7, 10**10):
        tables = S._cells(64, 4, rows, None)
        r = np.random.RandomState(1)
        for _ in range(300):
            differing = set(r.choice(64, 4, replace=False).tolist())
            assert any(not differing & set(t) for t in tables)


def test_chain_of_components(spark):
    edges = [(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(100) if i != 50]
    got = {r.v: r.label for r in S.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {i.to_bytes(2, "big"): (0 if i <= 50 else 51).to_bytes(2, "big") for i in range(101)}


def test_one_of_each(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (9, "other words are here now"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in S.one_of_each(df).collect()), key=str) == [1, 9, None]


@pytest.mark.parametrize("how", [{}, NEAR])
def test_one_of_each_with_repeated_ids(spark, how):
    a, b, c, d = ("alone and unlike the rest", "some other words that differ here", "a copy of a smaller id is this", "the last of all the texts")
    rows = [(1, c), (2, a), (2, b), (2, b + " "), (3, c), (3, d), (3, d), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text.strip()) for r in S.one_of_each(df, **how).collect()), key=str)
    assert got == sorted([(1, c), (2, a), (2, b), (3, d), (None, c)], key=str)


def test_wide_fingerprints_by_bands(spark):
    rows = texts(100, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df, shingle=5, planes=512, radius=80, bands=(32, 16)).collect()}
    assert len(set(got.values())) == 20


def pair(words, jaccard, seed):
    """Two texts whose sets of five-word shingles have about the given similarity: one word in a while differs, at the ends of a run."""
    r = np.random.RandomState(seed)
    a = [f"w{x}" for x in r.randint(0, 10**6, words)]
    n = words - 4
    changed = round(n * (1 - jaccard) / (1 + jaccard))
    return " ".join(a), " ".join(a[: words - changed] + [f"z{x}" for x in r.randint(0, 10**6, changed)])


def jaccard(a, b):
    x, y = (set(S._shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_links_are_verified(spark):
    rows, want = [], {}
    for k, target in enumerate([0.75] * 40 + [0.79] * 40 + [0.805] * 80 + [0.85] * 40):
        a, b = pair(200 + 5 * (k % 80), target, k)
        rows += [(2 * k, a), (2 * k + 1, b)]
        want[2 * k + 1] = 2 * k if jaccard(a, b) >= 0.8 else 2 * k + 1
    assert sum(k != v for k, v in want.items()) == 120
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df, **NEAR).collect()}
    assert all(got[k] in (v, k) for k, v in want.items()) and all(got[k] == k for k in range(0, len(rows), 2))
    assert sum(got[k] == v for k, v in want.items() if k != v) >= 0.97 * 120


@pytest.mark.parametrize("set_bytes", [1 << 20, 2000])
def test_verified_components(spark, monkeypatch, set_bytes):
    monkeypatch.setattr(S, "SET_BYTES", set_bytes)
    rows = texts(100, 5) + [(500, None), (501, ""), (502, " "), (None, "w1 w2")]
    want = {i: i for i, _ in rows}
    for _ in range(5):
        for i, t in rows[:100]:
            want[i] = min(want[j] for j, u in rows[:100] if jaccard(t, u) >= 0.8)
    want |= {501: 500, 502: 500}
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **NEAR).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_similar_forest(seed):
    r = np.random.RandomState(seed)
    base = [r.choice(500, 40, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate((r.choice(base[r.randint(6)], r.randint(30, 41), replace=False), r.randint(500, 600, r.randint(0, 3))))).astype(np.uint64) for _ in range(80)]
    sets += [np.empty(0, np.uint64)] * 2
    label = S.similar_forest(sets, 0.8)
    near = [[len(set(a.tolist()) & set(b.tolist())) >= 0.8 * len(set(a.tolist()) | set(b.tolist())) for b in sets] for a in sets]
    want = list(range(len(sets)))
    for _ in sets:
        want = [min(want[j] for j in range(len(sets)) if near[i][j]) for i in range(len(sets))]
    assert label.tolist() == want


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (3, None), (4, "other words than these are here now"), (None, "a b c d e f g h")]
    names = ["row", "id", "version", "label", "stays", "_version", "_gone_id", "fp", "component_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{k} as {n}" for k, n in enumerate(names)]).repartition(3)
    for how in ({}, {"similar": 0.8, "shingle": 5}):
        got = S.one_of_each(df, **how)
        assert got.columns == df.columns
        assert sorted(((r.doc_id, r.text, r["row"], r.component_id) for r in got.collect()), key=str) == sorted([(1, rows[0][1], 0, 8), (3, None, 0, 8), (4, rows[4][1], 0, 8), (None, rows[0][1], 0, 8)], key=str)


@pytest.mark.parametrize("seed", range(6))
def test_full_cells_equal_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(S, "PAIR_ROWS", [40, 64, 1000][seed % 3])
    monkeypatch.setattr(S, "LANES", [3, 1 << 18][seed % 2])
    r = np.random.RandomState(seed)
    base = r.randint(0, 256, (3, 8)).astype(np.uint8)
    near = base[r.randint(0, 3, 260)].copy()
    for x in near:  # chains: each differs from a copy in a few bits, so groups are wider than the radius
        for p in r.randint(0, 64, r.randint(0, 9)):
            x[p // 8] ^= 1 << (p % 8)
    fps = np.concatenate((near, r.randint(0, 256, (90, 8)).astype(np.uint8)))[r.permutation(350)]
    far = np.unpackbits(fps[:, None] ^ fps[None], axis=2).sum(axis=2)
    label = np.arange(350)
    while True:
        new = np.array([label[far[i] <= 6].min() for i in range(350)])
        if (new == label).all():
            break
        label = new
    got = S.cell_components(fps, 6)
    assert (got == label).all() and len(set(label)) > 50


def test_a_group_has_no_more_edges_for_more_tables(spark, monkeypatch):
    own = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"{own} tail{i}") for i in range(400)] + [(1000 + i, f"other{i} {i} text{i} of its own {i * i}") for i in range(20)]
    counts, real = [], S.components
    monkeypatch.setattr(S, "components", lambda edges: (counts.append(edges.count()), real(edges))[1])
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), planes=512, radius=112, bands=(48, 13), similar=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 1000 else i for i, _ in rows}
    assert 399 <= counts[0] < 800


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write for shuffles, and what it returns."""
    context = spark.sparkContext
    jvm, store = context._jvm, context._jsc.sc().statusStore()

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    got = run()
    return sum(n for k, n in stages().items() if k not in before), got


def test_near_dedup_shuffles_only_texts_that_may_go(spark):
    r = np.random.RandomState(8)
    rows = [(i, " ".join(f"{x:08x}" for x in r.randint(0, 2**31, 3000))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    at = S.materialize(df, "test-documents")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, got = shuffled(spark, lambda: sorted(x.doc_id for x in S.one_of_each(at, **NEAR).select("doc_id", "text").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == list(range(200))
    assert n < sum(len(t) for _, t in rows) / 2


def test_copies_are_read_once(spark, monkeypatch):
    own = " ".join(f"word{i}" for i in range(200))
    rows = [(i, own) for i in range(50)] + [(60, own + " tail")] * 2 + [(None, None)] * 3 + [(70, "")]
    seen, real = [], S.possible
    monkeypatch.setattr(S, "possible", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df, **NEAR).collect()}
    assert got == {i: 0 for i in (*range(50), 60)} | {None: 70, 70: 70}
    # One of the fifty copies; rows that repeat an id, or have none, are as many as they are.
    assert seen[0].where("possible").count() <= 1 + 2 + 3 + 1


@pytest.mark.parametrize("most_bits", [1, 64, 1 << 26])
def test_possible_misses_none(spark, monkeypatch, most_bits):
    monkeypatch.setattr(S, "MOST_BITS", most_bits)
    rows = spark.range(20_000).selectExpr("if(id % 7 = 0, null, id) as id", "id * 31 as version", "id % 50 = 0 as asked")
    found = S.possible(rows, rows.where("asked"), ["id", "version"])
    assert found.columns == [*rows.columns, "possible"] and found.count() == 20_000
    assert found.where("asked and not possible").isEmpty()
    assert most_bits < 1 << 26 or found.where("possible").count() < 2000
    assert S.possible(rows, rows.where("false"), ["id", "version"]).where("possible").isEmpty()


@pytest.mark.parametrize("how", [{}, NEAR])
def test_one_of_each_with_a_full_bitmap(spark, monkeypatch, how):
    monkeypatch.setattr(S, "MOST_BITS", 1)
    rows = texts(60, 9) + [(500, None), (501, ""), (None, "w1 w2"), (None, "w1 w2"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    full = sorted(map(str, S.one_of_each(df, **how).collect()))
    monkeypatch.setattr(S, "MOST_BITS", 1 << 26)
    assert sorted(map(str, S.one_of_each(df, **how).collect())) == full
    assert len(full) < 40
