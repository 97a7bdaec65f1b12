import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from docloom.llm import byte_bpe as B

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "plain words here", "a  b\n\n c ", "don't", "日本語 12", "😀 x", "<|endoftext|>", "x" * 3000, "word, 12 " * 400, "  nb   x"]


def merged(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[x] for x in parts]


@pytest.mark.parametrize("long_chars", [B.LONG_CHARS, 5])
def test_encode_and_decode(long_chars):
    codec, ranks = B.Codec(RANKS, P.PATTERN, long_chars), B.load_ranks(RANKS)
    for text in TEXTS:
        ids = codec.encode(text).tolist()
        if len(text) < 500:
            assert ids == [i for m in regex.findall(P.PATTERN, text) for i in merged(m.encode(), ranks)]
        assert ids == tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
        assert codec.decode(np.array(ids, np.int64)) == text.encode()


@pytest.mark.parametrize("blank", [" ", "\n", " \n", "\t\u3000\x85 ", "\r\n\n"])
@pytest.mark.parametrize("around", [("", ""), ("a", "b"), ("x.", "\x1c"), ("", "'s"), ("9", " z")])
def test_white_space_equals_the_library(blank, around, monkeypatch):
    monkeypatch.setattr(B, "LONG_BLANKS", 7)
    codec = B.Codec(RANKS, P.PATTERN)
    for n in (1, 2, 3, 6, 7, 8, 20, 3000):
        text = around[0] + blank * n + around[1] + blank * 9 + "end" + blank * n
        assert codec.encode(text).tolist() == codec.encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 1_500_000, " \n" * 600_000, "a" + "\t " * 600_000 + "b"])
def test_very_long_white_space(text):
    codec = B.Codec(RANKS, P.PATTERN)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_very_long_texts():
    codec = B.Codec(RANKS, P.PATTERN)
    for text in ("é" * 500_000, "日本" * 300_000, "12" * 400_000, "word " * 400_000, "-" * 500_000):
        assert codec.decode(codec.encode(text)) == text.encode()


def test_round_trip(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(None, None), (1, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as id")
    enc = B.encode(df, RANKS, P.PATTERN)
    got = {(r.doc_id, r.decoded_sha256, r.n_tokens) for r in enc.collect()}
    codec = B.Codec(RANKS, P.PATTERN)
    assert got == {(i, hashlib.sha256((x or "").encode()).hexdigest(), len(codec.encode(x or ""))) for i, x in rows}
    assert sorted(bytes(r.bytes) for r in B.decode(enc, RANKS, P.PATTERN).collect()) == sorted((x or "").encode() for _, x in rows)


def test_empty_table(spark):
    assert B.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).collect() == []
