"""Places, roles, markers and plans of Vietnamese sentences, with the rows that they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import anonymize, geo, markers, ner, roles
from docloom.plans import pipelines

CASES = []


def cases(columns: str, rows: list[tuple]):
    """What a function of (spark) must return, by its columns."""
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def register(f):
        CASES.append((f, names, rows))
        return f

    return register


# ---- places -------------------------------------------------------------------------------------------------------

GAZETTEER = [
    ("1", "", "1", "tỉnh", "Lâm Sơn"), ("2", "", "1", "tỉnh", "Hải Vân"), ("3", "", "1", "thành phố", "Sông Đà"),
    ("11", "1", "2", "huyện", "Ea H'leo"), ("12", "1", "2", "thị xã", "Mỹ Xuân"), ("21", "2", "2", "huyện", "Đồng Tâm"), ("13", "1", "2", "huyện", "Đồng Tâm"), ("31", "3", "2", "quận", "Tây Hà"),
    ("111", "11", "3", "xã", "Cư Mốt"), ("131", "13", "3", "xã", "Tân Lập"), ("211", "21", "3", "xã", "Tân Lập"), ("311", "31", "3", "phường", "Bạch Mai"),
]
PLACES = {
    1: "ngụ tại xã Tân Lập, huyện [MENTION]Đồng Tâm[/MENTION], tỉnh Hải Vân",
    2: "ngụ tại [MENTION]x ã Tân Lập[/MENTION],hu yện Đồng Tâm,t ỉnh Lâm Sơn",
    3: "về huyện [MENTION]Ea H’leo[/MENTION] năm ngoái",
    4: "huyện [MENTION]Đồng Tâm[/MENTION] thì chưa rõ",
    5: "ở [MENTION]Bạch Mai[/MENTION]",
    6: "tại thành phố [MENTION]Sông Đà[/MENTION]. Huyện Đồng Tâm",
    7: "tại [MENTION]phường Bạch Mai, quận Tây Hà[/MENTION]",
    8: "ở huyện [MENTION]Đồng Tâmm[/MENTION], tỉnh Hải Vân",
    9: "gặp nhau ở [MENTION]nhà cũ[/MENTION]",
}


def _gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "code string, parent string, level string, unit string, name string")


@cases("case_no INTEGER, folded VARCHAR", [(1, "ea h leo"), (2, "xa a huyen b"), (3, "thanh pho x thi tran y"), (4, "phuong 3 quan 5"), (5, "tp hue"), (6, "xa dan"), (7, "")])
def folded_places(spark):
    """Punctuation separates words, and unit words that a space splits are mended; other words are not."""
    rows = [(1, "Ea H'leo"), (2, "xã A,huyện B"), (3, "Thành ph ố X; th ị tr ấn Y"), (4, "ph ường 3 - qu ận 5"), (5, "TP.Huế"), (6, "xa đàn"), (7, None)]
    df = spark.createDataFrame(rows, "case_no int, place string")
    return df.select("case_no", T.fold_place(F.col("place")).alias("folded"))


@cases("case_no INTEGER, level VARCHAR, code VARCHAR, provinces VARCHAR, ambiguous BOOLEAN", [
    (1, "district", "21", "2", False), (2, "commune", "131", "1", False), (3, "district", "11", "1", False), (4, "district", None, "", True), (5, "commune", "311", "3", False),
    (6, "province", "3", "3", False), (7, "address", None, "3", False), (8, "district", "21", "2", False), (9, None, None, "", False),
])
def place_signatures(spark):
    m = spark.createDataFrame([(k, "LOC", v) for k, v in PLACES.items()], "case_no int, label string, context string")
    p = F.col("place")
    return geo.signatures(m, _gazetteer(spark)).select("case_no", p["level"].alias("level"), p["code"].alias("code"), F.array_join(p["province"], ",").alias("provinces"), p["ambiguous"].alias("ambiguous"))


@cases("a INTEGER, b INTEGER, decision VARCHAR", [(1, 2, "block"), (1, 3, "block"), (1, 8, "link"), (1, 9, "defer"), (4, 9, "defer"), (5, 6, "block"), (3, 9, "defer")])
def place_decisions(spark):
    """Decisions over signatures that are parsed from contexts."""
    m = spark.createDataFrame([(k, "LOC", v) for k, v in PLACES.items()], "case_no int, label string, context string")
    signed = geo.signatures(m, _gazetteer(spark)).select("case_no", "place")
    asked = spark.createDataFrame([(1, 2), (1, 3), (1, 8), (1, 9), (4, 9), (5, 6), (3, 9)], "a int, b int")
    both = asked.join(signed.select(F.col("case_no").alias("a"), F.col("place").alias("pa")), "a").join(signed.select(F.col("case_no").alias("b"), F.col("place").alias("pb")), "b")
    return both.select("a", "b", geo.rule_decision(F.lit("LOC"), F.lit("LOC"), F.col("pa"), F.col("pb")).alias("decision"))


# ---- roles, markers and plans -------------------------------------------------------------------------------------

SESSION = """Hội đồng gồm:
Thẩm phán: ông Vũ Đức Kiên
Nguyên đơn: bà Đinh Thu Sương, nghề giáo viên.
Bà Đinh Thu Sương gửi đơn cho Tòa án nhân dân huyện.
Nơi nhận:
Thư ký Hà Kiều My
"""


def _at(text: str, surface: str, nth: int = 0) -> int:
    at = -1
    for _ in range(nth + 1):
        at = text.index(surface, at + 1)
    return at


@cases("start INTEGER, label VARCHAR, role VARCHAR", [(_at(SESSION, "Vũ Đức Kiên"), "PER", "court_personnel"), (_at(SESSION, "Đinh Thu Sương"), "PER", "party"), (_at(SESSION, "Đinh Thu Sương", 1), "PER", "party"), (_at(SESSION, "Tòa án nhân dân"), "ORG", "court_personnel"), (_at(SESSION, "Hà Kiều My"), "PER", "court_personnel")])
def court_role_cases(spark):
    found = [("Vũ Đức Kiên", 0, "PER"), ("Đinh Thu Sương", 0, "PER"), ("Đinh Thu Sương", 1, "PER"), ("Tòa án nhân dân", 0, "ORG"), ("Hà Kiều My", 0, "PER")]
    m = spark.createDataFrame([(1, label, a := _at(SESSION, s, n), a + len(s)) for s, n, label in found], "doc_id long, label string, start int, end int")
    return roles.classify_mentions(m, spark.createDataFrame([(1, SESSION)], "doc_id long, text string")).select("start", "label", "role")


MARKED = [(1, "Bà Đinh Thu S1 cùng ông Vũ Đức K1 ở xã M. S1 nhớ, K1 quên."), (2, "Hồ sơ không có tên."), (3, None), (4, "Mã số K7, loại B.")]


@cases("doc_id BIGINT, candidates BIGINT, replacements INTEGER, roundtrip_ok BOOLEAN", [(1, 5, 5, True), (2, 0, 0, True), (3, 0, 0, False), (4, 0, 0, True)])
def marker_cases(spark):
    """Marked names are found, linked and replaced, and every text but a null one comes back from its rewriting."""
    done, _, _ = markers.reconstruct(spark.createDataFrame(MARKED, "doc_id long, text string"))
    return done.select("doc_id", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), "replacements", F.coalesce("roundtrip_ok", F.lit(False)).alias("roundtrip_ok"))


PLANS = {
    1: ("Vũ Hà Đông gặp Vũ Hà Dong.", [("P1", "PER", "Vũ Hà Đông", 0), ("P2", "PER", "Vũ Hà Dong", 0)]),
    2: ("Đỗ Minh Hải bán xe. Hồ Thu Hải mua xe. Hải cười, Hải khóc.", [("P1", "PER", "Đỗ Minh Hải", 0), ("P1", "PER", "Hải", 2), ("P2", "PER", "Hồ Thu Hải", 0), ("P2", "PER", "Hải", 3)]),
    3: ("Nhà ở số 7 ngõ Hoa, phường Bạch Mai, thành phố Sông Đà.", [("L1", "LOC", "ngõ Hoa, phường Bạch Mai, thành phố Sông Đà", 0)]),
    4: ("Đến thành phố Vô Danh.", [("L1", "LOC", "thành phố Vô Danh", 0)]),
    5: ("Không có ai.", []),
}


@cases("doc_id BIGINT, status VARCHAR, anonymized_text VARCHAR", [
    (1, "ready", "Vũ Hà Đ1 gặp Vũ Hà D1."), (2, "ready", "Đỗ Minh H1 bán xe. Hồ Thu H2 mua xe. H1 cười, H2 khóc."), (3, "ready", "Nhà ở ngõ M, phường N, thành phố Sông Đà."), (4, "needs_review", None), (5, "ready", "Không có ai."),
])
def plan_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in PLANS.items()], "doc_id long, text string")
    rows = [(i, c, label, a := _at(t, s, n), a + len(s), s, False) for i, (t, found) in PLANS.items() for c, label, s, n in found]
    m = spark.createDataFrame(rows, "doc_id long, cluster_id string, label string, start int, end int, surface string, preserve boolean")
    return anonymize.plan_documents(docs, m, _gazetteer(spark)).select("doc_id", "status", "anonymized_text")


def careless(texts: list[str]) -> list[list[dict]]:
    """A tagger of names that fails on texts with a certain word."""
    if any("hỏng" in t for t in texts):
        raise RuntimeError("unreadable")
    return ner.rule_tagger({"PER": r"[A-Z]\w+ [A-Z]\w+ [A-Z]\w+"})(texts)


GATE = [(1, "Le Van Nam ra về."), (2, "Tran Thi Hoa, bản hỏng."), (4, None)]


@cases("doc_id BIGINT, status VARCHAR, reason VARCHAR, anonymized BOOLEAN, released BOOLEAN", [(1, "ready", None, True, False), (2, "needs_review", "ner_inference_error, RuntimeError: unreadable", False, False), (4, "ready", None, True, False)])
def anonymization_gate(spark):
    """A document whose names are not all known needs review and holds back the batch; nothing of it is released."""
    out = pipelines.anonymize_batch(spark.createDataFrame(GATE, "doc_id long, text string"), careless)
    reason = F.when(F.col("status") != "ready", F.get("entities", F.lit(0))["reason"])
    return out.select("doc_id", "status", reason.alias("reason"), F.col("anonymized_text").isNotNull().alias("anonymized"), F.col("released_text").isNotNull().alias("released"))


@cases("doc_id BIGINT, released_text VARCHAR", [(1, "Le Van N ra về."), (2, "Tran Thi H đã ký."), (3, "")])
def anonymization_release(spark):
    """Where every document is ready, all of them are released."""
    rows = [(1, "Le Van Nam ra về."), (2, "Tran Thi Hoa đã ký."), (3, None)]
    return pipelines.anonymize_batch(spark.createDataFrame(rows, "doc_id long, text string"), careless).select("doc_id", "released_text")


@pytest.mark.parametrize("f,names,rows", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_cases(spark, f, names, rows):
    assert sorted((tuple(r[n] for n in names) for r in f(spark).collect()), key=str) == sorted(rows, key=str)


def test_texts_of_roles_do_not_pass_the_driver(spark):
    """A short key's text looks small to Spark; broadcast, all texts went through the driver."""
    from docloom.operators import roles

    docs = spark.range(3).selectExpr("id as doc_id", "concat('Thẩm phán: Vũ Đức ', id, repeat(' nói', 50)) as text")
    found = docs.selectExpr("doc_id", "'PER' as label", "11 as start", "19 as end", "text as context")
    made = roles.classify_mentions(found, docs)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.role) for r in made.collect()) == [(i, "court_personnel") for i in range(3)]


def test_folding_goes_letter_by_letter():
    from docloom.operators import roles

    for text in ("ΟΔΟΣ ĐẠI İstanbul", "Thẩm phán ĐẶNG", "ẞß ﬁ ǅ Ⅷ Å", ""):
        assert len(roles._folded(text)) == len(text)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i) not in "İΣ").translate(roles._FOLD)
    assert every.lower() == "".join(c.lower() if len(c.lower()) == 1 else c for c in every)


def test_marker_cases_hold_null_texts_and_numbers_of_documents(spark, tmp_path):
    from docloom.plans import case_queries

    spark.range(24).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.doc_id: (r.replacements, r.roundtrip_ok, r.candidates) for r in case_queries.marker_cases(spark, str(tmp_path)).collect()}
    assert got == {k: (0 if k % 4 == 0 else 5, k % 12 != 4, 0 if k % 4 == 0 else 5) for k in range(24)}
