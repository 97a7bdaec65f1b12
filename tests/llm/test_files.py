import base64
import gzip
import hashlib
import os

import numpy as np
import public_tokenizers as P
import pytest

from docloom.llm import token_scan as S
from docloom.llm import warc as W
from docloom.llm.byte_bpe import Codec

RANKS = P.path("byte_bpe_50k.tiktoken")
S_FOLDER = "file:///tmp/docloom-test-ids-that-do-not-fit"


def slow_warc(rows, least):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same, default=None) if len(body) >= least and sum((h or "") == (html or "") for _, _, h in rows) > 1 else None
        revisit = first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


PAGES = [(5, "http://a/", "<p>x</p>"), (3, "http://b/\r\nX: y", "<p>x</p>"), (3, "http://b/", "<p>x</p>"), (9, None, None), (8, "u", ""), (None, "n", "<p>x</p>"), (None, "n", "alone"), (None, "m", "alone"), (4, "é", "ü\r\n\r\nWARC/1.1\r\n" * 5000), (7, "z", "one")]


@pytest.mark.parametrize("least", [0, 5])
def test_deduplicated(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as id", "3 as first").repartition(3)
    assert sorted(map(tuple, W.deduplicated(df, least).collect()), key=str) == slow_warc(PAGES, least)


def test_archives_are_read_back(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 100)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    written = W.write_archives(df, f"file://{tmp_path}/w")
    assert written.count() > 3
    assert W.read_archives(W.listed(spark, f"file://{tmp_path}/w")).count() == len(PAGES)
    (tmp_path / "w" / "part-000000-00000-of-a-lost-attempt.warc.gz").write_bytes((tmp_path / "w" / sorted(f for f in os.listdir(tmp_path / "w") if f.startswith("part"))[0]).read_bytes())
    got = W.read_archives(written, payloads=True).where("record_type = 'response'").collect()
    os.remove(tmp_path / "w" / "part-000000-00000-of-a-lost-attempt.warc.gz")
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(h or "" for i, _, h in PAGES if (i, h) not in [(5, "<p>x</p>"), (None, "<p>x</p>"), (9, None)])
    raw = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in sorted(os.listdir(tmp_path / "w")) if f.endswith(".warc.gz"))
    assert len({h["warc-record-id"] for h, _ in W.parse(raw)}) >= len(PAGES) - 1


def test_broken_archives():
    with pytest.raises(ValueError):
        list(W.parse(b"HTTP/1.1\r\n\r\n"))
    with pytest.raises(ValueError):
        list(W.parse(W.record(1, "u", b"x", "y", None)[:-4] + b"zzzz"))


def test_a_revisit_without_response_is_an_error(spark):
    records = spark.createDataFrame([(1, None, "revisit", "ABC", 9, None)], "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long")
    with pytest.raises(Exception, match="no response has the payload ABC"):
        W.resolve(records).collect()


def test_very_long_payloads(spark):
    rows = [(1, "u", "x" * 20_000_000), (2, "v", "x" * 20_000_000), (3, "w", "y" * 20_000_000)]
    got = sorted(map(tuple, W.deduplicated(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(1, 20_000_000, "response", None), (2, 20_000_000, "revisit", 1), (3, 20_000_000, "response", None)]


def test_no_pages(spark):
    assert W.deduplicated(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def slow_scan(ids, end):
    out, at = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((i - at, True))
            at = i + 1
    return out + [(len(ids) - at, False)] * (at < len(ids))


@pytest.mark.parametrize("width,block", [(2, 1), (2, 7), (4, 64), (2, 10_000)])
def test_count_tokens(spark, tmp_path, width, block):
    r = np.random.RandomState(block)
    want = set()
    files = {"a": r.randint(0, 12, 500), "b": np.full(40, 7), "c": np.full(9, 3), "d": np.empty(0, int), "e": np.array([7]), "f": np.concatenate((r.randint(0, 9, 300), np.zeros(200, int), [7]))}
    for name, ids in files.items():
        ids.astype(f"<u{width}").tofile(tmp_path / f"{name}.bin")
        want |= {(f"{name}.bin", k, n, e) for k, (n, e) in enumerate(slow_scan(ids.tolist(), 7))}
    got = S.count_tokens(spark, f"file://{tmp_path}", separator=7, width=width, block_tokens=block)
    assert {tuple(x) for x in got.collect()} == want


def test_document_tokens(spark):
    rows = [(i, "some words " * (i * 7 % 50)) for i in range(60)] + [(None, "x"), (3, None), (3, ""), (1, "<|endoftext|> here"), (2, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as nth", "3 as file").repartition(3)
    codec = Codec(RANKS, P.PATTERN)
    got = S.document_tokens(df, RANKS, P.PATTERN, file_tokens=500)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == sorted(((i, len(codec.encode(t or ""))) for i, t in rows), key=str)
    assert S.document_tokens(df.limit(0), RANKS, P.PATTERN).collect() == []


def test_ids_that_do_not_fit(spark):
    with pytest.raises(Exception, match="do not fit into 2 bytes"):
        S.write_token_files(spark.createDataFrame([(1, "x")], "doc_id long, text string"), S_FOLDER, RANKS, P.PATTERN, separator=70_000)


def test_long_blanks_and_leftovers(spark, tmp_path):
    rows = [(1, " " * 2_000_000), (2, "a\n" + "\n" * 1_000_000 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    codec = Codec(RANKS, P.PATTERN)
    assert sorted((r.doc_id, r.n_tokens) for r in S.document_tokens(df, RANKS, P.PATTERN).collect()) == [(i, len(codec.encode(t))) for i, t in rows]
    np.array([1, 2, 7], "<u2").tofile(tmp_path / "left.bin")
    files = spark.createDataFrame([(f"file://{tmp_path}/left.bin", 6)], "path string, length long")
    np.array([7, 7], "<u2").tofile(tmp_path / "of-a-lost-attempt.bin")
    assert [tuple(r) for r in S.count_tokens(spark, f"file://{tmp_path}", separator=7, files=files).collect()] == [("left.bin", 0, 2, True)]
