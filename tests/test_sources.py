import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import readers, writers
from docloom.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, header="Đầu trang"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


BODY = "<w:p><w:r><w:t>Ông Lê Văn </w:t></w:r><w:r><w:t>Nam nói</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>ô bảng</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"


def test_docx(spark, tmp_path):
    data = docx(BODY)
    parts = readers.docx_parts(data)
    assert [p["text"] for p in parts] == ["Ông Lê Văn Nam nói", "ô bảng", "Đầu trang"]
    whole = "\n".join(p["text"] for p in parts)
    assert all(whole[p["start"] : p["end"]] == p["text"] for p in parts)
    a = whole.index("Lê Văn Nam")
    new = readers.rewrite_docx(data, [{"start": a, "end": a + 10, "original": "Lê Văn Nam", "replacement": "Lê Văn N"}])
    assert [p["text"] for p in readers.docx_parts(new)] == ["Ông Lê Văn N nói", "ô bảng", "Đầu trang"]
    with pytest.raises(ValueError):
        readers.rewrite_docx(data, [{"start": 15, "end": 22, "original": whole[15:22], "replacement": ""}])
    (tmp_path / "a.docx").write_bytes(data)
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = readers.docx_texts(spark, f"file://{tmp_path}").collect()
    assert sorted((r.part_no is None, r.text) for r in rows if r.error is None)[0][1] == "Ông Lê Văn Nam nói" and sum(r.error is not None for r in rows) == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('﻿{"id":"a","n":1}\n\n{"id":"b","n":2}\nbroken\n{"id":"a","n":3}\n', encoding="utf-8")
    df = readers.json_lines(spark, f"file://{tmp_path}/x.jsonl", "id string, n int")
    assert [(r.line_no, r.id, r.n) for r in df.orderBy("line_no").collect()] == [(1, "a", 1), (3, "b", 2), (4, None, None), (5, "a", 3)]
    assert [r.line_no for r in readers.json_lines(spark, f"file://{tmp_path}/x.jsonl", "id string", offset=1, limit=2).collect()] == [3]
    assert {r.id: r.n for r in readers.latest_by_id(df.where("id is not null"), "id").collect()} == {"a": 3, "b": 2}
    with pytest.raises(ValueError):
        readers.assert_unique(df.where("id is not null"), "id")


def test_checked_and_aligned(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    a.write.parquet(f"file://{tmp_path}/p")
    assert readers.parquet_checked(spark, f"file://{tmp_path}/p", ["text"]).count() == 2
    with pytest.raises(ValueError):
        readers.parquet_checked(spark, f"file://{tmp_path}/p", ["nope"])
    b = readers.with_text_hash(a).drop("text")
    assert readers.align(readers.with_text_hash(a), b, ["doc_id", "source_sha256"]).count() == 2
    with pytest.raises(ValueError):
        readers.align(a, b.where("doc_id = 1"), ["doc_id"])
    assert readers.record_text(a.withColumnRenamed("text", "content"))[1] == "content"
    assert len(readers.content_hashes(spark, f"file://{tmp_path}/p", "*.parquet").first().sha256) == 64


def test_plain_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿chào", encoding="utf-8")
    assert readers.plain_texts(spark, f"file://{tmp_path}/a.txt").first().text == "chào"
    with pytest.raises(Exception, match="too large"):
        readers.plain_texts(spark, f"file://{tmp_path}/a.txt", most_bytes=2).collect()


def test_publish(spark, tmp_path):
    at = f"file://{tmp_path}/set"
    d = spark.createDataFrame([(1, "train", "é"), (2, "test", None)], "doc_id long, split string, text string")
    writers.publish(spark, {"pairs": d}, at, {"rows": 2}, partition_by={"pairs": ["split"]})
    assert spark.read.parquet(f"{at}/pairs").where("split = 'train'").count() == 1
    with pytest.raises(FileExistsError):
        writers.publish(spark, {"pairs": d}, at, {})
    writers.publish(spark, {"pairs": d.limit(1)}, at, {"rows": 1}, replace=True)
    assert json.loads((tmp_path / "set/manifest.json").read_text())["rows"] == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        writers.publish(spark, {"pairs": bad}, f"file://{tmp_path}/other", {})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    writers.json_lines(d, f"file://{tmp_path}/lines")
    lines = sorted(x for f in (tmp_path / "lines").glob("part*") for x in f.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"doc_id": 1, "split": "train", "text": "é"}, {"doc_id": 2, "split": "test", "text": None}]


def test_streams(spark, tmp_path):
    schema = "doc_id long, text string, category string"
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, " ", "y")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/in")
    source = lambda: ingest.documents(spark, f"file://{tmp_path}/in", schema)
    run = lambda: ingest.ingest(ingest.fresh_texts(source()), f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    run()
    out = lambda: sorted(r.text for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert out() == ["a", "b"]
    spark.createDataFrame([(5, "b", "x"), (6, "c", "x")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    assert out() == ["a", "b", "c"]
    cap = lambda: ingest.ingest_capped(source(), f"file://{tmp_path}/capped", f"file://{tmp_path}/c2", {"x": 4}).awaitTermination()
    cap()
    spark.createDataFrame([(7, "d", "x"), (8, "e", "z")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    cap()
    got = spark.read.parquet(f"file://{tmp_path}/capped").groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in got} == {"x": 4, "y": 1, "z": 1}


def test_caps_and_pools_survive_restarts(spark, tmp_path):
    schema = "doc_id long, category string, reasons array<string>"
    r, parts = random.Random(1), []
    for k in range(4):
        parts.append([(100 * k + i, r.choice(["x", "y", "z", None]), r.choice([["a"], ["a", "b", "b"], [], None, ["c", None]])) for i in range(30)])
    parts[3].append(parts[0][0])  # a document that comes again
    source = lambda: ingest.documents(spark, f"file://{tmp_path}/in", schema)
    had = spark.createDataFrame([("y", 20)], "group string, had long")
    for part in parts:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        ingest.ingest_capped(source(), f"file://{tmp_path}/capped", f"file://{tmp_path}/c1", {"x": 11, "y": 25}, had=had).awaitTermination()
        changes = ingest.pool_changes(source(), F.col("reasons"), 5)
        ingest.with_state_on_disk(spark, lambda: ingest.ingest(changes, f"file://{tmp_path}/pools", f"file://{tmp_path}/c2")).awaitTermination()  # noqa: B023
    rows = [x for part in parts for x in part]
    of = lambda g: [x[0] for x in rows if x[1] == g]
    got = [tuple(x) for x in spark.read.parquet(f"file://{tmp_path}/capped").select("doc_id", "category").collect()]
    assert sorted(d for d, g in got if g == "x") == sorted(of("x")[:11]) or len([1 for _, g in got if g == "x"]) == 11
    assert sum(g == "y" for _, g in got) == 5 and sorted(d for d, g in got if g in ("z", None)) == sorted(of("z") + of(None))
    # Within a batch the first by id are taken, so all of the first batch come before those of later ones.
    batch = lambda d: d // 100
    assert max(batch(d) for d, g in got if g == "x") <= min(batch(d) for d in set(of("x")) - {d for d, g in got if g == "x"})
    rank = lambda d: hashlib.sha256(f"42\x1f{d}".encode()).hexdigest()
    want = {}
    for reason in "abc":
        for d in sorted({str(x[0]) for x in rows if x[2] and reason in x[2]}, key=rank)[:5]:
            want.setdefault(d, []).append(reason)
    assert {x.doc_id: x.reasons for x in ingest.pool_records(spark.read.parquet(f"file://{tmp_path}/pools")).collect()} == want


def test_event_windows_as_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 05:00:00", "b")]
    spark.createDataFrame(rows, "event_id long, t string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "event_type").write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(f"file://{tmp_path}/e")
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("windows_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n) for r in spark.table("windows_out").collect()] == [("a", 2)]


def test_align_all(spark):
    from docloom.operators import quality

    a = spark.createDataFrame([(1, "x", "h1"), (2, "y", None)], "id int, text string, sha string")
    b = spark.createDataFrame([(2, None, 5), (1, "h1", 6)], "id int, sha string, n int")
    c = spark.createDataFrame([(1, 0.5), (2, 0.1)], "id int, score double")
    got = readers.align_all({"a": a, "b": b, "c": c}, ["id"], [("sha", "a", "b")])
    assert got.columns == ["id", "text", "sha", "n", "score"] and sorted(map(tuple, got.collect())) == [(1, "x", "h1", 6, 0.5), (2, "y", None, 5, 0.1)]
    with pytest.raises(ValueError, match="differ"):
        readers.align_all({"a": a, "b": b.withColumn("sha", b.n.cast("string"))}, ["id"], [("sha", "a", "b")])
    with pytest.raises(ValueError, match="sizes"):
        readers.align_all({"a": a, "c": c.limit(1)}, ["id"])
    with pytest.raises(ValueError):
        readers.align_all({"a": a, "c": spark.createDataFrame([(1, 0.5), (1, 0.1)], c.schema)}, ["id"])
    q = "reconstruction_quality"
    own = spark.createDataFrame([(1, "own"), (2, None), (3, None)], f"doc_id int, {q} string")
    other = spark.createDataFrame([(1, "audit"), (2, "audit")], own.schema)
    made = spark.createDataFrame([(i, "made") for i in (1, 2, 3)], own.schema)
    assert sorted(map(tuple, quality.with_fallback(own, other, made).collect())) == [(1, "own"), (2, "audit"), (3, "made")]
    assert sorted(map(tuple, quality.with_fallback(own.drop(q), other, made).collect())) == [(1, "audit"), (2, "audit"), (3, "made")]
