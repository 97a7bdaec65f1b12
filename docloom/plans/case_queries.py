"""Queries over sentences that are made of the given tables' rows: court decisions, places and plans, with SQL that states what each holds.

The driver's documents hold no court decisions, so keys of customers, suppliers, nations and regions are spelt as names and put
into Vietnamese sentences, a text for each row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import anonymize, geo, markers, ner, pairs, roles, scoring
from docloom.plans import fixtures as X
from docloom.plans import pipelines

QUERIES = {}
SQL = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_DIGITS, _LETTERS = "0123456789", "abcdefghik"


def spelt(start: str, key: str) -> Column:
    """A capitalised word that spells the number in ``key``."""
    return F.concat(F.lit(start), F.translate(F.col(key).cast("string"), _DIGITS, _LETTERS))


def spelt_sql(start: str, key: str) -> str:
    return f"('{start}' || translate(CAST({key} AS VARCHAR), '{_DIGITS}', '{_LETTERS}'))"


def filled(template: str, **words: Column) -> Column:
    """A sentence with words in place of {names}."""
    made = F.lit(template)
    for name, word in words.items():
        made = F.replace(made, F.lit("{" + name + "}"), word)
    return made


def filled_sql(template: str, **words: str) -> str:
    made = "'" + template.replace("'", "''") + "'"
    for name, word in words.items():
        made = f"replace({made}, '{{{name}}}', {word})"
    return made


# ---- places -------------------------------------------------------------------------------------------------------


def _gazetteer(spark, sf_dir):
    t = lambda n: X.table(spark, sf_dir, n)
    row = lambda df, p, key, up, level, unit, name: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("code"), up.alias("parent"), F.lit(level).alias("level"), F.lit(unit).alias("unit"), name.alias("name"))
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = row(t("region"), "r", "r_regionkey", F.lit(""), "1", "tỉnh", F.concat(F.lit("Lâm "), spelt("R", "r_regionkey")))
    n = row(t("nation"), "n", "n_nationkey", code("r", "n_regionkey"), "2", "huyện", F.concat(F.lit("Đồng "), spelt("N", "n_nationkey")))
    return r.unionByName(n).unionByName(row(t("supplier"), "s", "s_suppkey", code("n", "s_nationkey"), "3", "xã", F.concat(F.lit("Tân "), spelt("S", "s_suppkey"))))


#: Kinds of sentences about a supplier's place, its level, and what of its path they tell.
_PLACES = {
    1: ("ngụ tại xã Tân {s}, huyện [MENTION]Đồng {n}[/MENTION], tỉnh Lâm {r}", "district", "n"),
    2: ("ngụ tại [MENTION]x ã Tân {s}[/MENTION],hu yện Đồng {n},t ỉnh Lâm {r}", "commune", "s"),
    3: ("về [MENTION]Đồng {n}[/MENTION] năm ngoái", "district", "n"),
    4: ("tại tỉnh [MENTION]Lâm {r}[/MENTION]. Xã Tân {s}", "province", "r"),
    5: ("tại [MENTION]xã Tân {s}, huyện Đồng {n}[/MENTION]", "address", None),
    6: ("gặp nhau ở [MENTION]nhà cũ[/MENTION] tại Tân {s}", None, None),
}


def _placed(spark, sf_dir):
    """(kind, s, n, r, label, context): each supplier in each kind of sentence."""
    t = lambda n: X.table(spark, sf_dir, n)
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    words = {"s": spelt("S", "s_suppkey"), "n": spelt("N", "n_nationkey"), "r": spelt("R", "n_regionkey")}
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), filled(v[0], **words).alias("context")) for k, v in _PLACES.items()]))
    return rows.select("s_suppkey", "n_nationkey", "n_regionkey", F.lit("LOC").alias("label"), made.alias("x")).select("s_suppkey", "n_nationkey", "n_regionkey", "label", "x.*")


_KINDS = "k AS (SELECT * FROM (VALUES (1, 'district'), (2, 'commune'), (3, 'district'), (4, 'province'), (5, 'address'), (6, NULL)) AS t(kind, level)), s AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_CODE = "CASE WHEN kind IN (1, 3) THEN 'n' || n_nationkey WHEN kind = 2 THEN 's' || s_suppkey WHEN kind = 4 THEN 'r' || n_regionkey END"


@query(f"""SELECT s_suppkey, 'xa tan ' || lower({spelt_sql("S", "s_suppkey")}) || ' huyen dong ' || lower({spelt_sql("N", "s_nationkey")}) || ' tp hue phuong ' || (s_nationkey % 7) AS folded FROM supplier""")
def folded_places(spark, sf_dir):
    """Punctuation separates words, and unit words that a space splits are mended."""
    place = filled("x ã Tân {s},HUYỆN  Đồng {n}; TP.Huế - ph ường {k}", s=spelt("S", "s_suppkey"), n=spelt("N", "s_nationkey"), k=(F.col("s_nationkey") % 7).cast("string"))
    return X.table(spark, sf_dir, "supplier").select("s_suppkey", T.fold_place(place).alias("folded"))


@query(f"""WITH {_KINDS} SELECT s_suppkey, kind, level, {_CODE} AS code, CASE WHEN kind = 6 THEN '' ELSE 'r' || n_regionkey END AS provinces, false AS ambiguous FROM s, k""")
def place_signatures(spark, sf_dir):
    p = F.col("place")
    found = geo.signatures(_placed(spark, sf_dir), _gazetteer(spark, sf_dir))
    return found.select("s_suppkey", "kind", p["level"].alias("level"), p["code"].alias("code"), F.array_join(p["province"], ",").alias("provinces"), p["ambiguous"].alias("ambiguous"))


@query(f"""WITH {_KINDS}, p AS (SELECT *, {_CODE} AS code FROM s, k)
SELECT a.s_suppkey, a.kind AS a, b.kind AS b, b.s_suppkey AS other, CASE WHEN a.kind = 6 OR b.kind = 6 THEN 'defer' WHEN a.n_regionkey <> b.n_regionkey THEN 'block'
WHEN a.kind = 5 AND b.kind = 5 THEN CASE WHEN a.s_suppkey <> b.s_suppkey THEN 'block' ELSE 'link' END WHEN a.kind = 5 OR b.kind = 5 THEN 'defer' WHEN a.level = b.level AND a.code = b.code THEN 'link' ELSE 'block' END AS decision
FROM p a JOIN p b ON b.s_suppkey IN (a.s_suppkey, a.s_suppkey + 1)""")
def place_decisions(spark, sf_dir):
    """Decisions over signatures that are parsed from sentences, of a supplier with itself and the next one."""
    signed = geo.signatures(_placed(spark, sf_dir), _gazetteer(spark, sf_dir)).select("s_suppkey", "kind", "place")
    a = signed.select("s_suppkey", F.col("kind").alias("a"), F.col("place").alias("pa"), F.explode(F.array("s_suppkey", F.col("s_suppkey") + 1)).alias("other"))
    b = signed.select(F.col("s_suppkey").alias("other"), F.col("kind").alias("b"), F.col("place").alias("pb"))
    return a.join(b, "other").select("s_suppkey", "a", "b", "other", geo.rule_decision(F.lit("LOC"), F.lit("LOC"), F.col("pa"), F.col("pb")).alias("decision"))


# ---- roles, markers and plans -------------------------------------------------------------------------------------

_SESSION = """Hội đồng gồm:
Thẩm phán: ông Vũ Đức {k}
Nguyên đơn: bà Đinh Thu {s}, nghề giáo viên.
Bị đơn: ông Lý Gia {b}, ngụ cùng huyện.
Người làm chứng: bà Mai Thị {w} có mặt.
Tòa án nhân dân huyện thụ lý.
Nơi nhận:
Thư ký Hà Kiều {m}
"""
#: Mentions of a session: surface, label, role, and the procedural role that the nearest cue gives.
_PRESENT = [
    ("Vũ Đức {k}", "PER", "court_personnel", None), ("Đinh Thu {s}", "PER", "party", "plaintiff"), ("Lý Gia {b}", "PER", "party", "defendant"),
    ("Mai Thị {w}", "PER", "party", "witness"), ("Tòa án nhân dân", "ORG", "court_personnel", None), ("Hà Kiều {m}", "PER", "court_personnel", None),
]
_WORDS = {"k": "K", "s": "S", "b": "B", "w": "W", "m": "M"}
_IN_SQL = {k: spelt_sql(v, "c_custkey") for k, v in _WORDS.items()}


def _sessions(spark, sf_dir):
    """(docs, mentions): a session for each customer."""
    words = {k: spelt(v, "c_custkey") for k, v in _WORDS.items()}
    docs = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_custkey", filled(_SESSION, **words).alias("text"))
    surface = F.explode(F.array(*[F.struct(filled(s, **words).alias("surface"), F.lit(label).alias("label")) for s, label, _, _ in _PRESENT]))
    found = docs.select("doc_id", "text", surface.alias("x")).select("doc_id", "text", "x.*").withColumn("start", F.expr("locate(surface, text)") - 1)
    return docs.select("doc_id", "text"), found.withColumn("end", F.col("start") + F.length("surface"))


_ROLES = " UNION ALL ".join(f"""SELECT c_custkey, strpos(text, {filled_sql(s, **_IN_SQL)}) - 1 AS "start", '{label}' AS label, '{role}' AS role, {f"'{cue}'" if cue else "CAST(NULL AS VARCHAR)"} AS cue FROM t""" for s, label, role, cue in _PRESENT)


@query(f"""WITH t AS (SELECT c_custkey, {filled_sql(_SESSION, **_IN_SQL)} AS text FROM customer), r AS ({_ROLES}) SELECT c_custkey AS doc_id, CAST("start" AS INTEGER) AS "start", label, role, cue FROM r""")
def court_role_cases(spark, sf_dir):
    """Court personnel and parties by titles and sections, and the procedural roles of parties by cues."""
    docs, found = _sessions(spark, sf_dir)
    known = roles.classify_mentions(pairs.mention(found, F.col("text"), 60).drop("text"), docs)
    return known.select("doc_id", "start", "label", "role", scoring.nearest_role(F.col("context"), 25).alias("cue"))


_MARKED = "Bà Đinh Thu S{i} cùng ông Vũ Đức K{i} ở xã M. S{i} nhớ, K{i} quên."


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 5 END AS replacements, c_custkey % 12 <> 4 AS roundtrip_ok, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 5 END AS BIGINT) AS candidates FROM customer")
def marker_cases(spark, sf_dir):
    """Marked names are found, linked and replaced, numbers of documents are not, and every text but a null one comes back from its rewriting."""
    key = F.col("c_custkey")
    bare = F.when(key % 12 == 0, F.lit("Hồ sơ không có tên.")).when(key % 12 == 8, filled("Mã số K{i}, loại B.", i=(key % 9 + 1).cast("string")))
    text = F.when(key % 4 == 0, bare).otherwise(filled(_MARKED, i=(key % 9 + 1).cast("string")))
    done, _, _ = markers.reconstruct(X.table(spark, sf_dir, "customer").select(key.alias("doc_id"), text.alias("text")))
    return done.select("doc_id", "replacements", F.coalesce("roundtrip_ok", F.lit(False)).alias("roundtrip_ok"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


#: Texts, the mentions of their clusters, and the texts that plans give; {h} and {t} begin with H, {l} with L.
_PLANS = [
    ("Vũ Hà {h} bán xe. {h} cười.", [("P1", "PER", "Vũ Hà {h}", 0), ("P1", "PER", "{h}", 1)], "Vũ Hà H bán xe. H cười."),
    ("Đỗ Minh {h} bán xe. Hồ Thu {t} mua xe.", [("P1", "PER", "Đỗ Minh {h}", 0), ("P2", "PER", "Hồ Thu {t}", 0)], "Đỗ Minh H bán xe. Hồ Thu H mua xe."),
    ("Lê Thu {l} ký, ông Đỗ Minh {h} nhận.", [("P1", "PER", "Lê Thu {l}", 0), ("P2", "PER", "Đỗ Minh {h}", 0)], "Lê Thu L ký, ông Đỗ Minh H nhận."),
    ("Nhà ở xã Tân {s}, huyện Đồng {n}.", [("L1", "LOC", "xã Tân {s}, huyện Đồng {n}", 0)], "Nhà ở xã M, huyện N."),
    ("Đến thành phố Vô {v}.", [("L1", "LOC", "thành phố Vô {v}", 0)], None),
    ("Không có ai.", [], "Không có ai."),
]


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 6 = 4 THEN 'needs_review' ELSE 'ready' END AS status, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, _, t) in enumerate(_PLANS) if t) + " END AS anonymized_text FROM supplier")
def plan_cases(spark, sf_dir):
    words = {"h": spelt("H", "s_suppkey"), "t": F.concat(spelt("H", "s_suppkey"), F.lit("u")), "l": spelt("L", "s_suppkey"), "s": spelt("S", "s_suppkey"), "n": spelt("N", "s_nationkey"), "v": spelt("Z", "s_suppkey")}
    kind = F.col("s_suppkey") % len(_PLANS)
    text = F.element_at(F.array(*[filled(t, **words) for t, _, _ in _PLANS]), (kind + 1).cast("int"))
    rows = X.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", kind.alias("kind"), text.alias("text"))
    part = "array<struct<cluster_id:string,label:string,surface:string,nth:int>>"
    found = [F.array(*[F.struct(F.lit(c).alias("cluster_id"), F.lit(label).alias("label"), filled(s, **words).alias("surface"), F.lit(n).alias("nth")) for c, label, s, n in ms]).cast(part) for _, ms, _ in _PLANS]
    m = rows.select(F.col("s_suppkey").alias("doc_id"), "text", F.explode(F.element_at(F.array(*found), (F.col("kind") + 1).cast("int"))).alias("x")).select("doc_id", "text", "x.*")
    first = F.expr("locate(surface, text)")
    again = F.expr("locate(surface, text, locate(surface, text) + 1)")
    m = m.withColumn("start", F.when(F.col("nth") == 0, first).otherwise(again) - 1).withColumn("end", F.col("start") + F.length("surface"))
    docs = rows.select(F.col("s_suppkey").alias("doc_id"), "text")
    made = anonymize.plan_documents(docs, m.select("doc_id", "cluster_id", "label", "start", "end", "surface", F.lit(False).alias("preserve")), _gazetteer(spark, sf_dir))
    return made.select("doc_id", "status", "anonymized_text")


def careless(texts: list[str]) -> list[list[dict]]:
    """A tagger of names that fails on texts with a certain word."""
    if any("hỏng" in t for t in texts):
        raise RuntimeError("unreadable")
    return ner.rule_tagger({"PER": r"[A-Z]\w+ [A-Z]\w+ [A-Z]\w+"})(texts)


@query(f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 1 THEN 'needs_review' ELSE 'ready' END AS status, CASE WHEN c_custkey % 5 = 1 THEN 'ner_inference_error, RuntimeError: unreadable' END AS reason,
CASE WHEN c_custkey % 5 = 1 THEN NULL WHEN c_custkey % 5 = 2 THEN '' ELSE 'Le Van N ra, ' || {spelt_sql("x", "c_custkey")} || ' ở.' END AS anonymized_text, false AS released FROM customer""")
def anonymization_gate(spark, sf_dir):
    """A document whose names are not all known needs review and holds back the batch; nothing of it is released."""
    key = F.col("c_custkey")
    text = F.when(key % 5 == 1, F.concat(F.lit("Tran Thi Hoa, bản hỏng "), spelt("x", "c_custkey"))).when(key % 5 != 2, F.concat(F.lit("Le Van Nam ra, "), spelt("x", "c_custkey"), F.lit(" ở.")))
    out = pipelines.anonymize_batch(X.table(spark, sf_dir, "customer").select(key.alias("doc_id"), text.alias("text")), careless)
    reason = F.when(F.col("status") != "ready", F.get("entities", F.lit(0))["reason"])
    return out.select("doc_id", "status", reason.alias("reason"), "anonymized_text", F.col("released_text").isNotNull().alias("released"))


@query(f"""SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 5 = 2 THEN '' ELSE 'Le Van N ra về, ' || {spelt_sql("y", "s_suppkey")} || ' chờ Le Van N.' END AS released_text FROM supplier""")
def anonymization_release(spark, sf_dir):
    """Where every document is ready, all of them are released."""
    text = F.when(F.col("s_suppkey") % 5 != 2, F.concat(F.lit("Le Van Nam ra về, "), spelt("y", "s_suppkey"), F.lit(" chờ Le Van Nam.")))
    return pipelines.anonymize_batch(X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text")), careless).select("doc_id", "released_text")
