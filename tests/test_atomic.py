"""Tables that are shown at once, and counters of the pass that writes."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import atomic


def lines(path):
    return sorted((json.loads(x) for f in path.glob("part-*.jsonl") for x in f.read_text("utf-8").splitlines()), key=str)


def test_all_tables_are_shown_at_once(spark, tmp_path):
    a = spark.range(50).selectExpr("id", "if(id % 7 = 0, null, concat('é\\n', id)) as text").repartition(5)
    atomic.write_tables(spark, {"a": a, "b": spark.createDataFrame([(1, 2.5)], "x int, y double"), "none": a.limit(0)}, f"file://{tmp_path}/out")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]
    assert lines(tmp_path / "out" / "a") == sorted((r.asDict() for r in a.collect()), key=str) and lines(tmp_path / "out" / "b") == [{"x": 1, "y": 2.5}]
    with pytest.raises(Exception, match="out"):
        atomic.write_tables(spark, {"a": a}, f"file://{tmp_path}/out")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def failing(x):
        if x == 40:
            raise ValueError("no")
        return str(x)

    bad = spark.range(60).repartition(6).select("id", failing("id").alias("text"))
    with pytest.raises(Exception, match="no"):
        atomic.write_tables(spark, {"good": spark.range(5), "bad": bad}, f"file://{tmp_path}/out")
    assert not [p for p in tmp_path.iterdir() if ".building-" not in p.name]  # a task that outlives the job may still write there


def test_what_an_attempt_left_is_not_shown(tmp_path):
    w = atomic.TablesWriter(f"file://{tmp_path}/out")
    row = lambda t, v: {"table": t, "value": v}

    def breaks():
        yield row("a", "half")
        raise RuntimeError("lost executor")

    for _ in range(2):
        with pytest.raises(RuntimeError):
            w.write(breaks())
    again = w.write(iter([row("a", "one"), row("b", "two")]))
    w.write(iter([row("a", "a task that ran twice")]))
    assert not (tmp_path / "out").exists()
    w.commit([again, None, w.write(iter([]))])
    assert [(p.parent.name, p.read_text()) for p in sorted((tmp_path / "out").rglob("*.jsonl"))] == [("a", "one\n"), ("b", "two\n")]
    v = atomic.TablesWriter(f"file://{tmp_path}/other")
    v.abort([])
    v.write(iter([row("a", "x")]))
    v.abort([None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_counters_of_the_pass_that_writes(spark, tmp_path):
    df = spark.range(100).repartition(4)
    got = atomic.observed(df, f"file://{tmp_path}/o", {"rows": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0), "most": F.max("id")})
    assert got == {"rows": 100, "even": 50, "most": 99} and spark.read.parquet(f"file://{tmp_path}/o").count() == 100
    assert atomic.observed(df.limit(0), f"file://{tmp_path}/p", {"rows": F.count("*"), "most": F.max("id")}) == {"rows": 0, "most": None}
