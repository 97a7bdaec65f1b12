import re
from collections import defaultdict

import pytest

from docloom.llm import line_templates as L


def slow(rows, min_docs=L.MIN_DOCS, most_part=L.MOST_PART):
    """The same by plain loops: (id, text) -> text, dropped."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0], str(r[1])))
    masked = lambda line: "".join("<*>" if re.search("[0-9]", x) else x for x in re.split(r"([ \t\x0b\f\r])", line))
    lines, total = [], {}
    for d, (_, text) in enumerate(docs):
        own = (text or "").split("\n")
        total[d] = sum(len(masked(x)) for x in own) + len(own) - 1
        for pos, line in enumerate(own):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in re.split(r"[ \t\x0b\f\r]+", line) if x)
            if w:
                lines.append((d, pos, w, len(masked(line))))

    def runs(w):
        n = len(w) - 3
        m = min(8, n)
        return [w[3 + i * n // m : 3 + (i + 1) * n // m] for i in range(m)] if m > 0 else []

    alike = lambda a, b: len(a) == len(b) and a[:3] == b[:3] and 2 * sum(x == y for x, y in zip(runs(a), runs(b))) > len(runs(a))
    leaves, template = defaultdict(list), {}
    for _, _, w, _ in lines:
        if w not in template:
            earlier = next((x for x in leaves[len(w), w[:3]] if alike(w, x)), w)
            template[w] = template.get(earlier, w)
            leaves[len(w), w[:3]].append(w)
    seen = defaultdict(set)
    for d, _, w, _ in lines:
        seen[template[w]].add(d)
    gone = defaultdict(dict)
    for d, pos, w, chars in lines:
        t = template[w]
        if len(seen[t]) >= (max(10, min_docs) if len(w) < 5 else min_docs) and d != min(seen[t]):
            gone[d][pos] = chars
    out = {}
    for d, (i, text) in enumerate(docs):
        own = gone[d] if most_part is None or most_part * sum(gone[d].values()) <= total[d] else {}
        out[i, text] = ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in own) if own else text, len(own))
    return sorted(((i, *out[i, t]) for i, t in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    own = lambda i: " ".join(f"word{chr(97 + i % 26)}{chr(97 + i * k % 26)}{chr(97 + k)}" for k in range(60))
    log = lambda a, b: f"user {a} logged in from host {b} today"
    made = [(i, f"{own(i)}\n{log(i, 'h' * i)}\nAll rights reserved.\n\n  tail  of\t{i}") for i in range(12)]
    made += [(20, log(1, "a") + "\n" + log(2, "b")), (21, None), (22, ""), (23, "\n\n"), (None, log(3, "q") + "\n" + own(3)), (None, "alone here")]
    # One leaf, two templates, each with a field of its own, and the one of lesser ids is not the larger.
    made += [(30 + i, f"{own(40 + i)}\nwe met at the old mill near {'p' * (i + 1)} on a warm day in may") for i in range(6)]
    made += [(40 + i, f"{own(50 + i)}\nwe met at no time and said {'q' * (i + 1)} was wrong about nearly every thing here") for i in range(6)]
    made += [(46 + i, f"{own(60 + i)}\nwe met at no time {'and never thought of it again at all since that very' if i else 'x'} afternoon") for i in range(2)]
    # Lines that share their first words only are not alike, however many there are.
    made += [(50 + i, own(70 + i) + "\nthe court finds " + " ".join(chr(97 + i) * (k + 2) for k in range(3))) for i in range(6)]
    made += [(60 + i, own(2) + "\n" + own(4) + f"\n{own(80 + i)}") for i in range(7)]  # copies of a document: over a third recurs
    made += [(70, "w " * 5000 + "\nlast line of a very long one"), (71, "w " * 5000), (71, "w " * 5000), (72, "a1" * 200_000 + " " + "b" * 200_000)]
    return made


@pytest.mark.parametrize("how", [{}, {"min_docs": 2, "most_part": None}, {"min_docs": 3}])
def test_equals_loops(spark, rows, how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as dropped", "2 as id", "3 as version", "4 as lines_dropped", "5 as r0").repartition(3)
    got = L.drop_recurring_lines(df, **how)
    assert got.columns == ["doc_id", "text", "dropped", "id", "version", "r0", "lines_dropped"]
    want = slow(rows, **how)
    assert sorted(((r.doc_id, r.text, r.lines_dropped) for r in got.collect()), key=str) == want and sum(n > 0 for _, _, n in want) > 10


def test_what_stays(spark, rows):
    left = {i: n for i, _, n in slow(rows)}
    assert left[35] == left[45] == 1 and not left[47] and not any(left[i] for i in range(50, 56)) and not any(left[i] for i in range(60, 67))


def test_lines_that_share_their_beginning_only(spark):
    pairs = ["The court finds that damages apply", "The court finds no liability here", "We went to the market today", "We went to see grandmother alone"]
    rows = [(10 * i + k, f"{x}\n" + f"{'ab' * (10 * i + k + 1)} " * 30) for i, x in enumerate(pairs) for k in range(1)]
    got = L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, most_part=None)
    assert {r.doc_id: r.text for r in got.collect()} == dict(rows)


def test_an_alike_line_is_found_behind_others_of_the_same_runs(spark):
    # The last two agree in three of four runs, but each two neighbours of these came up before in lines that agree in two only.
    ends = ["a b z w", "q b c v", "a b c y", "a b c x"]
    rows = [(i, f"some three words {x}\n{'ab' * (i + 1)}") for i, x in enumerate(ends)]
    got = L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, most_part=None)
    assert sorted((r.doc_id, r.text, r.lines_dropped) for r in got.collect()) == slow(rows, min_docs=2, most_part=None)
    assert [n for _, _, n in slow(rows, min_docs=2, most_part=None)] == [0, 0, 0, 1]


def test_more_leaves_than_are_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_LEAVES", 1)
    got = L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text, r.lines_dropped) for r in got.collect()), key=str) == slow(rows)


def test_no_python_on_the_executors(spark, rows):
    got = L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_empty(spark):
    assert L.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_its_sql_finds_the_same(spark, rows):
    import duckdb

    ends = ["a b z w", "q b c v", "a b c y", "a b c x"] * 2
    made = {i: t for i, t in rows if i is not None} | {100 + i: f"some three words {x}\n{'ab' * (i + 1)}" for i, x in enumerate(ends)} | {200 + i: "long line " + "word " * 200_000 + str(i) for i in range(6)}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = sorted((r.doc_id, r.lines_dropped, r.text) for r in L.drop_recurring_lines(df, most_part=None).collect())
    assert got == sorted(con.execute(L.ORACLE_SQL).fetchall()) and sum(n for _, n, _ in got) > 20


def test_how_many_documents_short_lines_need(spark):
    df = spark.createDataFrame([(i, f"see you\n{'ab' * (i + 1)} {'cd' * (i + 1)}") for i in range(6)], "doc_id long, text string")
    assert [sum(r.lines_dropped for r in L.drop_recurring_lines(df, most_part=None, **how).collect()) for how in ({}, {"short": (5, 6)}, {"short": (2, 100)})] == [0, 5, 5]
