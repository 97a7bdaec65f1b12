"""Places by joins against brute force."""

import difflib
import random

import pytest

from docloom.operators import geo, lookup


def words(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeđô ") for _ in range(r.randint(1, 14))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "x", "a", "aa"])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("least", [0.78, 0.86, 0.95])
def test_alike_loses_no_name_of_four_letters_and_more(spark, least):
    asked, names = [w for w in words(1, 60) if len(w) >= 4], [w for w in words(1, 90) + words(2, 30) if len(w) >= 3]
    one = lambda x: spark.createDataFrame([(w,) for w in x] + [(None,)], "name string").selectExpr("name", "1 as gram", "2 as rank")
    got = {(r.asked, r.name): r.ratio for r in lookup.alike(one(asked), one(names), least).collect()}
    ratio = {(a, b): difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a in set(asked) for b in set(names)}
    assert got == {k: v for k, v in ratio.items() if v >= least} and len(got) > 10


def test_fuzzy_places_equal_the_lookup_in_memory(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abcdefghklmn") for _ in range(r.randint(8, 12))) for _ in range(20)]
    names += [w[:-1] + "x" for w in names[3:8]] + [w.strip() or "abcdef" for w in words(9, 15)]
    rows = [(str(i), "" if i < 3 else str(i % 3), "1" if i < 3 else "2", "huyện" if i % 2 else "quận", w) for i, w in enumerate(names)]
    g = geo.Gazetteer(rows)
    asked = []
    for k in range(60):
        w = list(r.choice(names))
        w[r.randrange(len(w))] = r.choice("xa")
        asked.append((k, "".join(w), 2, r.choice([None, "huyện", "quận"]), [str(r.randrange(3))] if r.random() < 0.3 else [str(names.index("".join(w)) % 3) if "".join(w) in names else "0"] if r.random() < 0.2 else []))
    df = spark.createDataFrame(asked, "ask int, name string, level int, unit string, parents array<string>")
    got = {x.ask: x.code for x in lookup.fuzzy_places(df, spark.createDataFrame(rows, "code string, parent string, level string, unit string, name string")).collect()}
    want = {k: c[0] for k, n, _, u, p in asked if (c := g.fuzzy(geo.fold_place(n), ("district",), u, {"province": set(p), "x": {"always"}}))}
    assert got == want and len(got) > 10


def test_planned_paths_hold_what_an_address_says(spark):
    rows = [("p", "", "1", "tỉnh", "P")] + [(f"d{i}", "p", "2", "huyện" if i % 2 else "quận", f"D{i}") for i in range(4)] + [(f"c{i}", f"d{i % 4}", "3", "xã" if i % 3 else "phường", f"C{i}") for i in range(40)]
    paths = geo.paths(spark.createDataFrame(rows, "code string, parent string, level string, unit string, name string"))
    masked = [(d, f"e{k}", *x) for d in range(30) for k, x in enumerate([("commune", "xã", "A", ["district:B"], []), ("district", "huyện", "B", [], ["p"]), ("commune", "phường", "C", [], ["d2"]), ("commune", "xã", "Z", [], ["d1", "d2"]), ("hamlet", "thôn", "H", ["district:B"], None)])]
    df = spark.createDataFrame(masked, "doc_id long, entity_id string, role string, unit string, marker string, chain array<string>, anchors array<string>")
    got = {}
    for r in lookup.plan_paths(df, paths).collect():
        got.setdefault(r.doc_id, {})[r.entity_id] = (r.name, r.reason)
    for d, e in got.items():
        i, j = int(e["e0"][0][1:]), int(e["e1"][0][1:])
        assert i % 4 == j and j % 2 and i % 3 and int(e["e2"][0][1:]) % 12 == 6 and e["e3"] == (None, "invalid_location_hierarchy") and e["e4"] == (None, None)
    assert len({e["e0"] for e in got.values()}) > 5 and len(got) == 30
    assert lookup.plan_paths(df.limit(0), paths).collect() == []
    assert {r.reason for r in lookup.plan_paths(df, paths.limit(0)).collect()} == {"invalid_location_hierarchy"}


def slow_names(docs, names):
    """Every known name at every place, by its letters without spaces."""
    bare = lambda x: "".join(c for c in x.lower() if c not in " \t")
    forms = {}
    for n in set(names) - {None}:
        forms.setdefault(bare(n), set()).add(n)
    out = []
    for d, text in docs:
        found = set()
        for b, ns in forms.items():
            for start in range(len(text or "")) if len(ns) == 1 and len(b) >= 3 else ():
                end, got = start, ""
                while end < len(text) and len(got) < len(b):
                    got += "" if text[end] in " \t" else text[end].lower() if len(text[end].lower()) == 1 else text[end]
                    end += 1
                edge = lambda c: not (c.isalnum() or c == "_")
                if got == b and text[start] not in " \t" and (start == 0 or edge(text[start - 1])) and (end == len(text) or edge(text[end])):
                    found.add((start, end, next(iter(ns))))
        out += [(d, s, e, text[s:e], n) for s, e, n in found if not any(x <= s and e <= y and (x, y) != (s, e) for x, y, _ in found)]
    return sorted(out, key=str)


def test_known_names_equal_a_search_at_every_place(spark):
    r = random.Random(3)
    names = ["Tân Phú", "Tân Phú Đông", "phú đông", "An Hòa", "A n hòa", "ab", "abc", "ABD ", "xaabc", "e f g h i j k l m n", None, "Đông Khê"] + ["".join(r.choice("abc") for _ in range(r.randint(3, 6))) for _ in range(12)]
    pieces = ["Tân  Phú", "tânphú đông", "PHÚ ĐÔNG", "an hòa", "abc", "abd", "xa abc", "x aabc", "efghi jklmn", "efghi\njklmn", "Đôn\tg Kh ê", ", ", ". ", " ", "\n", "_", "z", "abcabc", "İ"] + [n for n in names[12:]]
    docs = [(i, "".join(r.choice(pieces) for _ in range(r.randint(1, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "ab"), (103, "  a b c  "), (104, "x" * 50_000 + " abc")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as one", "2 as gram")
    got = lookup.find_names(d, spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == slow_names(docs, names) and got.count() > 30
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert lookup.find_names(d, spark.createDataFrame([], "name string")).collect() == [] and lookup.find_names(d.limit(0), spark.createDataFrame([("abc",)], "name string")).collect() == []


def test_alike_asks_few_pairs_of_many_names(spark, monkeypatch):
    """Only names that share most of their letters are compared, however many there are of the same letters."""
    r = random.Random(3)
    names = ["".join(r.choice("bcdf") for _ in range(10)) for _ in range(1500)]
    asked = [w[:4] + w[5:] for w in names[:50]]
    one = lambda x: spark.createDataFrame([(w,) for w in x], "name string")
    seen = spark.sparkContext.accumulator(0)

    def counted(a, b):
        seen.add(len(a))
        return ratios(a, b)

    ratios = lookup._ratios
    monkeypatch.setattr(lookup, "_ratios", counted)
    got = {(x.asked, x.name) for x in lookup.alike(one(asked), one(names), 0.9).collect()}
    assert got == {(a, b) for a in asked for b in names if difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9} and len(got) >= 50
    assert seen.value <= 3 * len(got)


@pytest.mark.parametrize("keys", [3, 40])
def test_alike_by_pairs_of_letters_loses_no_long_name(spark, monkeypatch, keys):
    monkeypatch.setattr(lookup, "NAME_KEYS", keys)
    asked, names = [w * 2 for w in words(4, 40) if len(w) >= 4], [w * 2 for w in words(4, 60) if w]
    one = lambda x: spark.createDataFrame([(w,) for w in x], "name string")
    got = {(r.asked, r.name) for r in lookup.alike(one(asked), one(names), 0.78).collect()}
    assert got == {(a, b) for a in set(asked) for b in set(names) if difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.78}


def test_alike_in_memory_compares_few_places(monkeypatch):
    """Only places of the roles and unit asked for, that share most letters, are compared with a name."""
    r = random.Random(7)
    rows = [("p", "", "1", "tỉnh", "Lam Son")] + [(f"c{i}", "p", "3", "xã", "".join(r.choice("abcdefghiklmnopq") for _ in range(8))) for i in range(3000)]
    g, made = geo.Gazetteer(rows), []
    exact = difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a, **k: made.append(1) or exact(*a, **k))
    assert g.fuzzy("vo abcdef", ("province", "district"), "thành phố", {}) == [] and not made
    name = rows[5][4][:4] + rows[5][4][5:]
    want = sorted((x, c) for c, *_, n in rows if (x := exact(None, name, n.lower(), autojunk=False).ratio()) >= geo.FUZZY - geo.MARGIN)
    assert sorted(g.alike(name, ("commune",), "xã")) == want and want and len(made) < 100


def test_known_names_of_letters_whose_case_changes_more(spark):
    """Small letters that are words where the capital is none, or that go by what stands around, move no place."""
    docs = [(1, "Ɤ Blue ring, ꟋBLUE  RING"), (2, "ΟΔΟΣ ΟΔΟΣ Blue ring"), (3, "\t İİ Blue\tring İ"), (4, " \t"), (5, "___"), (6, "BLUE ring" + "  z" * 1300 + " blue ring  ")]
    got = lookup.find_names(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("blue ring",), ("no",)], "name string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == slow_names(docs, ["blue ring", "no"]) and got.count() == 6


def test_known_names_look_only_where_words_begin(spark):
    """What lies within words is not compared, so that the cost goes by words and not by letters."""
    docs = spark.createDataFrame([(1, "aabluering " * 1000 + "blue ring")], "doc_id long, text string")
    assert [r.start for r in lookup.find_names(docs, spark.createDataFrame([("blue ring",)], "name string")).collect()] == [11_000]
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    nodes = store.planGraph(last).allNodes()
    made = [m.accumulatorId() for n in (nodes.apply(i) for i in range(nodes.size())) if n.name() == "Generate" for m in (n.metrics().apply(k) for k in range(n.metrics().size())) if m.name() == "number of output rows"]
    assert made and all(store.executionMetrics(last).apply(k) == "1" for k in made)
