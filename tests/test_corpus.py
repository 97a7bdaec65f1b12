import datetime
import hashlib
import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.operators import curate, ocr, quality, spans, split


def docs(spark, n=60):
    return spark.createDataFrame([(i, f"text {i % 50}", "ab"[i % 2], f"f{i % 7}") for i in range(n)], "doc_id long, text string, lang string, family string")


def test_hash_split_is_that_of_the_hash(spark):
    for r in split.hash_split(docs(spark), 0.2, 0.3).collect():
        u = int(hashlib.sha256(f"42\x1f{r.doc_id}".encode()).hexdigest()[:16], 16) / 2**64
        assert r.split == ("test" if u < 0.3 else "validation" if u < 0.5 else "train")
    with pytest.raises(ValueError):
        split.hash_split(docs(spark), 0.5, 0.5)


def test_stratified_split_does_not_depend_on_order(spark):
    d = docs(spark, 100).withColumn("family", F.lit(None).cast("string"))
    a = {tuple(r) for r in split.stratified_split(d, ["lang"]).collect()}
    assert a == {tuple(r) for r in split.stratified_split(d.orderBy(F.col("doc_id").desc()).repartition(5), ["lang"]).collect()}
    assert Counter(s for _, s in a) == {"train": 80, "validation": 10, "test": 10}


def test_a_family_of_three_is_in_all_splits(spark):
    rows = [(i, f"s{i}", "rare") for i in range(3)] + [(i, "big", "usual") for i in range(3, 60)]
    got = dict(map(tuple, split.stratified_split(spark.createDataFrame(rows, "doc_id long, stratum string, family string"), ["stratum"], "family").collect()))
    assert {got[0], got[1], got[2]} == {"train", "validation", "test"}


def test_assigned(spark):
    d = docs(spark, 40)
    s = split.hash_split(d, 0.3, 0.3).select("doc_id", "split")
    assert split.assert_assigned(d, s).count() == 40
    with pytest.raises(ValueError, match="without a split"):
        split.assert_assigned(d, s.where("doc_id <> 3"))


def test_top_k_and_pools(spark):
    top = curate.top_k_per_stratum(docs(spark), [F.col("lang")], 5).collect()
    want = {x: sorted(range(i, 60, 2), key=lambda d: hashlib.sha256(f"42\x1f{d}".encode()).hexdigest())[:5] for i, x in enumerate("ab")}
    assert {r.doc_id for r in top} == {d for v in want.values() for d in v}
    pool = curate.challenge_pool(docs(spark), F.array("lang", "family"), 3).collect()
    assert Counter(x for r in pool for x in r.reasons)["a"] == 3
    assert curate.dedup_texts(docs(spark)).count() == 50


def test_window_group_limit_is_planned(spark):
    plan = curate.top_k_per_stratum(docs(spark), [F.col("lang")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_dates_and_lengths(spark):
    today = F.lit(datetime.date(2024, 1, 1))
    rows = spark.createDataFrame([("2024-01-02T00:00",), ("2024-01-01",), ("soon",), (None,)], "d string")
    assert [r[0] for r in rows.select(curate.in_future(F.col("d"), today)).collect()] == [True, False, False, False]
    assert spark.range(1).select(curate.long_enough(F.lit("  ab  "), 2, 6), curate.long_enough(F.lit("  ab  "), 3), curate.long_enough(F.lit("  ab  "), 2, 5)).first() == (True, False, False)


def test_vietnamese_features(spark):
    text = "Nguyên đơn: ông A; bà Nguyễn Thị B1, NLQ2, công ty X trú tại xã Y; sau đây gọi tắt N.V.C. Số tiền H 150.000 đồng."
    r = curate.feature_profile(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules.VI_FEATURES).first()
    assert (r.person_context, r.procedural_code, r.organization_marker, r.address_marker, r.alias_language, r.dotted_initial, r.numbered_marker, r.full_name_marker) == (1, 1, 1, 1, 1, 1, 1, 1)
    assert r.relevant == 1 and r.primary_challenge == "alias_language"


@pytest.mark.parametrize("target", [0, 1, 2, 20, 45, 1000])
def test_diversity_caps_equal_a_fold(spark, target):
    rows = [(i, "x" if i % 3 else "Unknown" if i % 2 else f"y{i % 4}", "address_marker" if i % 5 < 3 else "simple") for i in range(100)]
    df = spark.createDataFrame([*rows, (None, "x", "simple")], "position long, category string, primary_challenge string").repartition(7)
    got = {r.position: r.accepted for r in curate.diversity_caps(df, target).collect()}
    counts, addresses = Counter(), 0
    for i, c, f in rows:
        fits = sum(counts.values()) < target and counts[c] < math.ceil(0.35 * target) and (c != "Unknown" or counts[c] < math.ceil(0.25 * target)) and (f != "address_marker" or addresses < math.ceil(0.6 * target))
        counts[c] += fits
        addresses += fits and f == "address_marker"
        assert got[i] == fits
    assert got[None] is False and curate.diversity_caps(df.limit(0), 5).collect() == []


def test_diversity_caps_find_families_once_to_count_and_once_to_mark(spark):
    """To deal candidates by ranges, Spark reads them twice."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def family(i):
        seen.add(1)
        return "address_marker" if i % 2 else "simple"

    df = spark.range(0, 100, 1, 4).select(F.col("id").alias("position"), F.lit("x").alias("category"), family("id").alias("primary_challenge"))
    got = {r.position: r.accepted for r in curate.diversity_caps(df, 20).select("position", "accepted").collect()}
    assert [i for i in range(100) if got[i]] == [0, 1, 2, 3, 4, 5, 6] and seen.value <= 200


def test_a_primary_challenge_needs_no_counts(spark):
    texts = ["also known as A.B.", "A.B. 1.5", "x@y.z", "1.5", " A ", "none", ""]
    df = curate.feature_profile(spark.createDataFrame([(x,) for x in texts], "text string"), rules.EN_FEATURES)
    found = curate.primary_challenge(rules.EN_FEATURES, lambda c: F.col("text").rlike(rules.EN_FEATURES[c]))
    rows = df.select("primary_challenge", found.alias("found")).collect()
    assert all(r.primary_challenge == r.found for r in rows) and len({r.found for r in rows}) > 3


def test_semantic_rejections(spark):
    text = "trả H15.000 đồng, hợp đồng số B2 và C3/4; người D25 nói"
    at = lambda s: (text.index(s), text.index(s) + len(s), s)
    reps = [("e1", *at("H15")), ("e2", *at("B2")), ("e3", *at("C3")), ("e4", *at("D25")), ("e5", 0, 3, "xyz"), ("e6", 5, 500, "q")]
    ents = [("e4", "PER", "D25")]
    df = spark.createDataFrame([(text, ents, reps)], "t string, e array<struct<entity_id:string,label:string,marker:string>>, r array<struct<entity_id:string,start:int,end:int,original:string>>")
    got = df.select(curate.semantic_rejections(F.col("t"), F.col("e"), F.col("r"))).first()[0]
    assert got == ["compound_literal_number_collision", "document_identifier_collision", "invalid_replacement_span", "numeric_amount_boundary_collision", "source_span_mismatch", "unsupported_large_numeric_suffix"]


def test_quality(spark):
    d = spark.createDataFrame([(1, 3, True), (2, 0, None), (3, 1, True), (4, 2, False)], "doc_id long, replacements int, roundtrip_verified boolean")
    r = spark.createDataFrame([(3, "numeral_or_alias", 2), (3, "unheard_of", 1), (4, "roundtrip_failed", 1)], "doc_id long, reason string, n long")
    got = {x.doc_id: x for x in quality.score(d, r).collect()}
    assert (got[1].quality_score, got[1].quality_tier, got[1].eligible, got[1].reasons) == (100, "clean", True, [])
    assert (got[2].quality_score, got[2].quality_tier, got[2].eligible, got[2].reasons) == (80, "review", False, ["insufficient_replacements"])
    assert (got[3].quality_score, got[3].quality_tier, got[3].eligible) == (100 - 24 - 10, "review", True)
    assert (got[4].quality_score, got[4].quality_tier, got[4].eligible, got[4].hard_fail_reasons) == (0, "reject", False, ["roundtrip_failed"])


PIECES = st.lists(st.tuples(st.text("ab é😀\n", max_size=4), st.text("xyzß", min_size=1, max_size=4), st.text("QRđ😀", max_size=3)), max_size=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PIECES)
def test_rewriting_can_be_undone(spark, pieces):
    text, edits, want = "", [], ""
    for plain, old, new in pieces:
        text += plain
        want += plain
        edits.append((1, len(text), len(text) + len(old), old, new))
        text += old
        want += new
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    e = spark.createDataFrame(edits, "doc_id long, start int, end int, original string, replacement string")
    r = spans.rewrite(d, e).first()
    assert r.rewritten == want and r.roundtrip_ok
    assert all(r.rewritten[x.target_start : x.target_end] == x.replacement for x in r.edits)


def test_overlapping_edits(spark):
    d = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    e = spark.createDataFrame([(1, 0, 3, "abc", "X"), (1, 2, 4, "cd", "Y"), (1, 4, 6, "ef", "Z")], "doc_id long, start int, end int, original string, replacement string")
    assert spans.rewrite(d, e).first().rewritten == "abcdZ"
    wrong = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("zz").alias("original"), F.lit("").alias("replacement")))
    with pytest.raises(Exception, match="do not match"):
        d.select(spans.apply_edits(F.col("text"), wrong)).collect()


def test_word_mentions_equal_found_spans(spark):
    d = spark.createDataFrame([(1, "😀 A bc\nA é A"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end, r.surface) for r in spans.word_mentions(d, [("CAP", "^[A-Z]$")]).collect()}
    assert got == {(1, 2, 3, "A"), (1, 7, 8, "A"), (1, 11, 12, "A")}
    assert got == {(r.doc_id, r.start, r.end, r.surface) for r in spans.find_spans(d, {"CAP": "[A-Z]"}).collect()}


def test_spacing_model(spark):
    lines = ["hợp đồng mua bán nhà đất được công chứng"] * 6 + ["người bị kiện trình bày tại phiên tòa"] * 6
    model = ocr.train(spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "doc_id long, text string"))
    m = ocr.Model({r.key: r.n for r in model["grams"].collect()}, {r.key: r.n for r in model["contexts"].collect()}, {r.key: r.n for r in model["words"].collect()}, model["meta"].first()[0])
    texts = ["hợp đồng", "xyz", "người bị kiện"]
    got = {r.doc_id: r.mean_log_probability for r in ocr.mean_log_probability(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(got[i] == pytest.approx(m.mean(t)) for i, t in enumerate(texts)) and got[0] > got[1]
    text, starts, ends, joins = ocr.repair(m, "hợp đ ồng  mua\r\nbán A nhà")
    assert text == "hợp đồng mua\nbán A nhà" and [j["parts"] for j in joins] == [2]
    a = text.index("đồng")
    s, e = ocr.source_span(starts, ends, a, a + 4)
    assert "hợp đ ồng  mua\r\nbán A nhà"[s:e] == "đ ồng"


@given(st.text("a é\t\r\n​ 😀", max_size=30))
def test_spacing_offsets(text):
    plain, starts, ends = ocr.normalize_spacing(text)
    assert len(plain) == len(starts) == len(ends) and "  " not in plain and "\r" not in plain
    assert all(c == text[s] or c in " \n" for c, s in zip(plain, starts))
    assert all(a < b for a, b in zip(starts, ends)) and all(b <= a for b, a in zip(ends, starts[1:]))


def test_ranks_without_sorting_a_group(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows = split.ranks(df, "g", "h").collect()
    for g in (None, "g"):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.h)
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and {r.n for r in mine} == {len(mine)}


def test_first_retained(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", False), (4, None, False)], "line long, text string, bad boolean")
    assert sorted(r.line for r in curate.first_retained(df, F.col("bad")).collect()) == [2, 4]


def test_large_spacing_models_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Ab cd\nef"), (2, "é日 😀x"), (3, ""), (4, None), (1, "more of one"), (5, "zzz"), (None, "ab")], "doc_id long, text string")
    model = ocr.train(docs.where("doc_id <= 2"))
    score = lambda: {r.doc_id: round(r.mean_log_probability, 9) for r in ocr.mean_log_probability(docs, model).collect()}
    small = score()
    monkeypatch.setattr(ocr, "MODEL_GRAMS", 0)
    assert score() == small and set(small) == {1, 2, 5, None}
    empty = ocr.train(docs.limit(0))
    monkeypatch.setattr(ocr, "MODEL_GRAMS", 100)
    assert empty["grams"].count() == 0 and set(ocr.mean_log_probability(docs, empty).toPandas()["mean_log_probability"].round(6)) == {-2.772589}


def test_word_mentions_by_first_kind(spark):
    df = spark.createDataFrame([(1, "ab A  12 (a)\nA.b\n", 7), (2, None, 8), (3, "", 9), (None, "x ab", 1)], "doc_id long, text string, n int")
    got = spans.word_mentions(df, [("CAP", "^[A-Z]$"), ("NUM", "^[0-9]+$"), ("LOW", "^(a|ab)$"), ("ANY", "^[a-z]+$")], keep=("n",))
    assert got.columns == ["doc_id", "n", "label", "start", "end", "surface", "word_no"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 7, "LOW", 0, 2, "ab", 0), (1, 7, "CAP", 3, 4, "A", 1), (1, 7, "NUM", 6, 8, "12", 3), (None, 1, "ANY", 0, 1, "x", 0), (None, 1, "LOW", 2, 4, "ab", 1)], key=str)


def test_curating_nulls_ties_and_clashing_names(spark):
    rows = [(1, "x", "a", 5), (2, "x", None, 5), (3, None, None, 5), (None, "y", "a", 5), (4, "y", " ", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, _rank int")
    assert {r.doc_id for r in curate.dedup_texts(df).collect()} == {1, 4}
    got = curate.top_k_per_stratum(df, [curate.stratum(F.col("kind"))], 1)
    assert got.columns == [*df.columns, "stable_rank"] and got.count() == 2 and {r["_rank"] for r in got.collect()} == {5}
    assert curate.top_k_per_stratum(df.limit(0), [F.col("kind")], 1).collect() == [] and curate.dedup_texts(df.limit(0)).collect() == []
    assert [r.ok for r in df.select(curate.long_enough(F.col("text"), 1).alias("ok")).collect()] == [True, True, None, True, True]


def test_workers_get_texts_in_small_batches(spark):
    """Batches went by rows alone, 10,000 of them, whatever the size of the texts."""
    from docloom.operators import ner

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(3000).coalesce(1).selectExpr("id as doc_id", "repeat('x', 5000) as text")
    tagged = ner.tag(docs, lambda texts: [[{"label": "X", "start": 0, "end": 1, "surface": "x", "score": float(sum(map(len, texts)))}] for _ in texts])
    assert tagged.selectExpr("max(entities[0].score)").first()[0] < 8 << 20


def test_normal_texts_come_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(ocr, "NORMAL_CHARS", 10)
    texts = ["a\r\n\r b", "", None, "x  \t​ \n", "dài và dài hơn mười chữ", "\r"]
    made = ocr.normalize_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [(r.text, r.source_starts, r.source_ends, r.joins) for r in made] == [(*ocr.normalize_spacing(t or ""), []) for t in texts]
    assert made[0].text == "a\n\n b" and made[0].source_starts == [0, 1, 3, 4, 5] and made[0].source_ends == [1, 3, 4, 5, 6] and made[3].text == "x \n"
