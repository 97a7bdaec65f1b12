"""Pairs by tiles, and caps that act where pairs are made."""

import itertools

import pytest
from pyspark.sql import functions as F

from docloom.operators import datasets, evaluate, pairs


def mentions(spark, sizes):
    rows = [(d, 5 * i, 5 * i + 3, f"w{i % 3}", "PER" if i % 4 else "ORG", f"e{i % 5}", "m") for d, n in sizes.items() for i in range(n)]
    rows += [(1, 0, 3, "w0", "PER", "e9", "m"), (None, 0, 3, "w", "PER", "e", "m"), (1, 7, 9, "x", None, "e", "m")]
    return rows, spark.createDataFrame(rows, "doc_id long, start int, end int, surface string, label string, entity_id string, marker string")


@pytest.mark.parametrize("tile", [1024, 8, 2])
@pytest.mark.parametrize("keys", [[], ["label"]])
def test_tiles_make_each_pair_once(spark, monkeypatch, tile, keys):
    monkeypatch.setattr(pairs, "TILE", tile)
    rows, df = mentions(spark, {1: 37, 2: 5, 3: 1})
    got = sorted((r.doc_id, r.start_a, r.end_a, r.start_b, r.end_b, r.entity_id_a, r.entity_id_b) for r in pairs.candidates(df, keys, keep=("entity_id",)).collect())
    want = sorted(
        (a[0], *a[1:3], *b[1:3], a[5], b[5])
        for a, b in itertools.permutations(rows, 2)
        if a[0] == b[0] and a[0] is not None and a[1:3] < b[1:3] and (not keys or a[4] == b[4] and a[4] is not None)
    )
    assert got == want


@pytest.mark.parametrize("tile", [1024, 8])
def test_caps_do_not_depend_on_tiles(spark, monkeypatch, tile):
    rows, df = mentions(spark, {1: 60, 2: 9})
    docs = spark.createDataFrame([(1, "x" * 400), (2, "y" * 60), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(pairs, "TILE", 1024)
    one = [sorted(map(str, f.collect())) for f in (datasets.raw_pairs(df, docs, cap=20), datasets.natural_pairs(df, docs, cap=20)[0])]
    monkeypatch.setattr(pairs, "TILE", tile)
    two = [sorted(map(str, f.collect())) for f in (datasets.raw_pairs(df, docs, cap=20), datasets.natural_pairs(df, docs, cap=20)[0])]
    assert one == two and all(one) and "context_a='" in one[0][0]


def test_pairs_are_capped_before_the_shuffle(spark):
    _, df = mentions(spark, {1: 60})
    both = pairs.candidates(df, [], keep=("entity_id",))
    plan = pairs.best(both, 3, ["doc_id"], F.col("start_a"), F.col("start_b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Join") and "Partial" in plan


def test_no_mentions(spark):
    _, df = mentions(spark, {})
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert datasets.raw_pairs(df.limit(0), docs).collect() == [] and datasets.natural_pairs(df.limit(0), docs)[0].collect() == []


def test_columns_of_any_names_stay(spark):
    rows = [(1, i, i % 2, i // 2 + 1, "p", "n", "r") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, pair_id int, label int, rank int, _p string, _n string, _r string")
    got = pairs.balanced(df, 6)
    assert got.columns == df.columns and got.count() == 6 and {(r._p, r._n) for r in got.collect()} == {("p", "n")}
    one = evaluate.one_per_document(df.drop("rank"), "label", 3, "pair_id")
    assert {(r.pair_id, r._r) for r in one.collect()} == {(0, "r"), (1, "r")}
