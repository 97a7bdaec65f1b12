from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from test_line_templates import slow
from tokenizers import Tokenizer

import corpus_pipeline as C
from docloom.llm import toxicity as X


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = np.random.RandomState(3)
    words = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for d in "aeiou"]
    prose = lambda n: " ".join(r.choice(words, n))
    terms = "All pages are licensed under these same terms."
    rows = []
    for i in range(300):
        rows.append([i, "\n".join([prose(60), *[terms] * (i % 2), prose(60)]), "en", f"s{i % 3}"])
    for i in range(300, 420):  # toxic ones
        rows.append([i, "\n".join([prose(30) + " idiot " + prose(30), *[terms] * (i % 2)]), "en", "s0"])
    for i in range(420, 450):  # near copies of the first thirty, each line changed at its start
        lines = rows[i - 420][1].split("\n")
        rows.append([i, "\n".join("changed " + x for x in (lines[0], lines[-1])), "en", "s1"])
    rows += [[450, rows[40][1], "en", "s1"], [451, None, "en", "s1"], [452, "", "fr", None], [453, "  \n ", None, "s2"], [None, prose(40), "en", "s1"], [454, prose(3000), "en", "s2"]]
    docs = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{at}/documents.parquet")
    labels = [(i, 1, int(300 <= i < 420)) for i in range(420)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}", docs


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_force(spark, sf, docs):
    machine = X.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    left = [(d[0], d[1]) for d in docs if machine.score(d[1]) < 0.5]
    kept = []
    for (i, new, gone), (_, old) in zip(slow(left), sorted(left, key=str)):
        if not gone or (new or "").strip():
            kept.append((i, new))
    label = {i: i for i, _ in kept if i is not None}
    sets = {i: shingles(t) for i, t in kept if i is not None}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return [(i, t) for i, t in kept if i is None or label[i] == i]


def test_the_pipeline_equals_brute_force(spark, sf):
    at, docs = sf
    want = brute_force(spark, at, docs)
    ids = {i for i, _ in want}
    assert not ids & set(range(300, 420)) and ids >= set(range(300)) | {None, 454} and 450 not in ids and not ids & set(range(420, 450))
    got = C.run(spark, at).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lengths = defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
    assert dict(lengths) == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in want}
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_stages_keep_the_columns(spark, sf):
    at, docs = sf
    df = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, at)
        assert out.schema.simpleString() == df.schema.simpleString(), name
        df = C.materialize(out, "test-stage")


def test_stages_with_columns_of_any_name(spark, sf):
    at, _ = sf
    names = ["id", "version", "row", "label", "words", "r0", "leaf", "lines_gone", "toxicity_score", "score", "y", "fp", "dropped", "_version"]
    plain = spark.read.parquet(f"{at}/documents.parquet")
    df = plain.selectExpr("*", *[f"{k} as {n}" for k, n in enumerate(names)])
    for name, stage in C.STAGES:
        out, want = C.materialize(stage(spark, df, at), "test-clash"), stage(spark, plain, at)
        assert out.drop(*names).count() == want.count(), name
        if name != "packing":
            assert out.schema.simpleString() == df.schema.simpleString() and out.select(*names).distinct().collect() == [tuple(range(len(names)))], name
            df, plain = out, C.materialize(want, "test-plain")


def test_near_copies_leave_whole_or_not_at_all(spark):
    """Copies of one document, each with words of its own changed, go through line dedup untouched and leave near-dedup whole."""
    r = np.random.RandomState(9)
    words = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for d in "aeiou"]
    base = [r.choice(words, 60).tolist() for _ in range(6)]
    terms = "All pages are licensed under these same terms."
    rows = [(0, "\n".join(" ".join(x) for x in base))]
    for i in range(1, 21):
        lines = [list(x) for x in base]
        lines[i % 6][r.randint(60)] = f"changed{i}"
        rows.append((i, "\n".join(" ".join(x) for x in lines)))
    rows += [(100 + i, " ".join(r.choice(words, 80)) + f"\n{terms}\n" + " ".join(r.choice(words, 80))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = C.materialize(C.line_dedup(spark, docs, ""), "test-lines")
    texts = {x.doc_id: x.text for x in left.collect()}
    assert all(texts[i] == t for i, t in rows if i <= 100) and all(terms not in texts[i] for i in range(101, 120))
    assert {x.doc_id for x in C.near_dedup(spark, left, "").collect()} == {0, *range(100, 120)}


def test_stages_on_nothing(spark, sf):
    at, _ = sf
    df = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, df, at).collect() == []


def test_near_dedup_loses_no_link_of_the_documents(spark):
    """All pairs of texts of sf0.01 at a similarity of 0.8 or more by their sets, each within one component; and no others connected."""
    from collections import Counter
    from itertools import combinations


    from docloom.llm.simhash import _shingle_hashes, near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(np.unique(_shingle_hashes(r.text, 5)).tolist()) for r in docs.collect()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    both = Counter(p for ds in holders.values() for p in combinations(sorted(ds), 2))
    links = {(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}
    links |= set(combinations(sorted(d for d, s in sets.items() if not s), 2))
    label = {d: d for d in sets}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, **C.NEAR).collect()}
    assert len(links) > 50 and got == label
