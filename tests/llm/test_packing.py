import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing as K

FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def bins(plan):
    out = defaultdict(list)
    for length, first, n, each, sequence, offset in plan.arrays().tolist():
        for i in range(n):
            out[sequence + i // each].append((offset + i % each * length, length))
    return out


def check(counts, capacity):
    plan = K.Plan(dict(counts), capacity)
    made = bins(plan)
    assert sorted(made) == list(range(plan.sequences))
    assert Counter(x for b in made.values() for _, x in b) == Counter(counts)
    for b in made.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return plan


def fewest(items, capacity):
    """The fewest bins, by trying everything."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    r = np.random.RandomState(seed)
    items = sorted(r.randint(3 if seed % 2 else 1, 21, 9).tolist(), reverse=True)
    plan = check(Counter(items), 20)
    assert plan.sequences <= fewest(items, 20) + (plan.fixed < plan.sequences)
    if plan.fixed == plan.sequences:
        assert plan.sequences == fewest(items, 20)


@pytest.mark.parametrize("seed", range(5))
def test_large_histogram(seed):
    r = np.random.RandomState(seed)
    counts = Counter(np.clip(r.lognormal(5.5, 1, 200_000).astype(int), 1, 1024).tolist())
    plan = check(counts, 1024)
    assert plan.sequences <= -(-sum(k * n for k, n in counts.items()) // 1024) * 1.01 + 1
    assert len(plan.segments) < 8 * 1024


def test_no_counts():
    assert K.Plan({}, 8).sequences == 0


TEXTS = [
    None, "", " ", "a", "  two  spaces", "tab\tand\nlines\n\n end ", "don't we'll I'd", "x <|endoftext|> y", "é ü ñ ß", "日本語 テキスト 12 3", "nb  sp   em",
    " lead", "trail ", "a \nb", "word " * 3000, "z" * 5000, "emoji 😀 😀😀 ok", "1234 56789 0", "!!! ?? --", "İK ẞ", "mixed̀ marks é",
]


def test_encoder_equals_the_tokenizer():
    t = Tokenizer.from_file(FILES[0])
    got = K.Encoder(*FILES).batch(pa.array(TEXTS, pa.string()))
    assert [x.tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_pack_documents(spark):
    t = Tokenizer.from_file(FILES[0])
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(i + 100, f"copy of many words {i % 7} " * (i % 90)) for i in range(300)] + [(None, "no id"), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as length", "1 as rank", "2 as id").repartition(5)
    got = K.pack_documents(df, *FILES).collect()
    want = Counter()
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        n = -(-len(ids) // 1024)
        first = len(ids) - 1024 * (n - 1)
        for k in range(n):
            a = first + 1024 * (k - 1) if k else 0
            want[i, k, a, first + 1024 * k - a, zlib.crc32(ids[a : first + 1024 * k].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(spark):
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect() == []
