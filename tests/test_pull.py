"""Rows pulled from files of lines within bounds, each once over restarts."""

import json

from docloom.streaming import pull


def run(spark, tmp_path, **how):
    rows = pull.lines(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state/progress.json", **how)
    q = rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    return sizes


def test_each_row_once_within_bounds(spark, tmp_path):
    lines = [f"é{i}" if i % 9 else "" for i in range(57)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:20]) + "\n", "utf-8")
    (tmp_path / "in" / "b.txt").write_text("\r\n".join(lines[20:21]), "utf-8")
    (tmp_path / "in" / "c.txt").write_text("\n".join(lines[21:]) + ("\n" if not lines[-1] else ""), "utf-8")
    out = lambda: sorted((r.row, r.value) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = list(enumerate(lines))
    assert run(spark, tmp_path, batch=10, seconds=0) == []
    assert run(spark, tmp_path, batch=10, most=25) == [10, 10, 5] and out() == want[:25]
    assert run(spark, tmp_path, batch=10, most=25) == [] and out() == want[:25]
    assert run(spark, tmp_path, batch=7, most=40) == [7, 7, 1] and run(spark, tmp_path, batch=100) == [17] and out() == want


def test_until_a_target(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n" * 200)
    seen = []
    rows = pull.lines(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/progress.json", batch=20)
    q = rows.writeStream.foreachBatch(lambda df, _: seen.append(df.count())).option("checkpointLocation", f"file://{tmp_path}/c").start()
    pull.until(q, lambda: sum(seen) >= 60, every=0.01)
    assert not q.isActive and 60 <= sum(seen) <= 200 and set(seen) == {20}


def test_no_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("")
    assert run(spark, tmp_path, batch=5) == []


def test_late_lines_are_read_from_a_mark_near_them(tmp_path):
    file = tmp_path / "a.txt"
    file.write_bytes(b"".join(b"%d %s\r\n" % (i, b"x" * (i % 3000)) for i in range(12000)))
    marks = [list(m) for m in pull.marks(f"file://{file}")]
    reader = pull.PullReader({"files": json.dumps([[f"file://{file}", 12000, marks]]), "batch": "10", "progress": f"file://{tmp_path}/p.json"})
    assert len(marks) >= 3
    for first in (0, marks[0][0] - 1, marks[0][0], 7001, 11990):
        (part,) = reader.partitions({"row": first}, {"row": first + 10})
        assert part.at == max([0] + [b for m, b in marks if m <= first])
        assert list(reader.read(part)) == [(i, f"{i} " + "x" * (i % 3000)) for i in range(first, first + 10)]


def test_shares_pull_side_by_side(spark, tmp_path):
    lines = [f"{i}\rx" if i % 5 else "" for i in range(57)]  # a lone carriage return ends no line
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("\n".join(lines[:30]).encode() + b"\n")
    (tmp_path / "in" / "b.txt").write_bytes(b"")
    (tmp_path / "in" / "c.txt").write_bytes("\r\n".join(lines[30:]).encode())
    found = pull.files(spark, f"file://{tmp_path}/in")
    assert [n for _, n, _ in found] == [30, 27]
    out = lambda: sorted((r.row, r.value) for k in range(3) for r in spark.read.schema("row long, value string").parquet(f"file://{tmp_path}/out/{k}").collect())
    want = list(enumerate(lines))
    for most, sizes in ((25, [[8, 8, 3], [6], []]), (None, [[], [8, 5], [8, 8, 3]])):
        started = []
        for k in range(3):
            rows = pull.lines(spark, found, f"file://{tmp_path}/p{k}.json", batch=8, most=most, share=(k, 3))
            started.append(rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out/{k}").option("checkpointLocation", f"file://{tmp_path}/c{k}").start())
        for q in started:
            q.processAllAvailable()
        assert [[p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] for q in started] == sizes
        for q in started:
            q.stop()
        assert out() == want[:most]


def test_plain_renames_are_for_local_checkpoints_and_end(spark, tmp_path):
    name = "spark.sql.streaming.checkpointFileManagerClass"
    before = spark.conf.get(name, None)
    with pull.plain_renames(spark, f"file://{tmp_path}/c"):
        assert spark.conf.get(name).endswith(".FileSystemBasedCheckpointFileManager")
        test_each_row_once_within_bounds(spark, tmp_path)
    assert spark.conf.get(name, None) == before
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.m.link./c", f"file://{tmp_path}/c")
    with pull.plain_renames(spark, "viewfs://m/c"):
        assert spark.conf.get(name, None) == before
