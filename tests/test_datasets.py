import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import cluster, datasets, geo, lookup, names, ner, pairs
from docloom.plans import pipelines
from docloom.sources import readers
from tests.test_linking import GAZ

SOURCE = "Ông Nguyễn Văn A và bà Trần Thị A khai. A nói với A. Ở xã B."
SPANS = [("PER_0001", "Nguyễn Văn A", 4, " Nguyễn Văn An"), ("PER_0002", "Trần Thị A", 23, "Trần Thị Ánh"), ("PER_0001", "A", 40, "An"), ("PER_0002", "A", 50, "Ánh"), ("LOC_0001", "B", 58, "Tân Phú")]
ENTITIES = [("PER_0001", "PER", "A", "person"), ("PER_0002", "PER", "A", "person"), ("LOC_0001", "LOC", "B", "commune")]


@pytest.fixture(scope="module")
def joined(spark):
    docs = spark.createDataFrame([(1, SOURCE), (2, "không")], "doc_id long, text string")
    reps = [(e, e[:3], s, s + len(o), o, r) for e, o, s, r in SPANS] + [("GHOST", "PER", 0, 3, "Ông", "x"), ("PER_0001", "PER", 0, 3, "sai", "x")]
    maps = spark.createDataFrame([(1, SOURCE, ENTITIES, reps), (2, "không", [], [])], "doc_id long, text string, entities array<struct<entity_id:string,label:string,marker:string,role:string>>, replacements array<struct<entity_id:string,label:string,start:int,end:int,original:string,replacement:string>>")
    return docs, datasets.aligned(docs, readers.with_text_hash(maps).drop("text"))


def test_positions_of_the_fixture():
    assert all(SOURCE[s : s + len(o)] == o for _, o, s, _ in SPANS)


def test_mentions_of_source_and_target(spark, joined):
    _, j = joined
    m = datasets.map_mentions(j)
    assert sorted((r.start, r.surface, r.entity_id, r.role) for r in m.collect())[0] == (4, "Nguyễn Văn A", "PER_0001", "person") and m.count() == 5
    target = SOURCE
    for _, o, s, r in reversed(SPANS):
        target = target[:s] + r + target[s + len(o) :]
    good = j.withColumn("replacements", F.filter("replacements", lambda r: r["entity_id"] != "GHOST")).where("doc_id = 1")
    for r in datasets.map_mentions(good, target=True).collect():
        assert target[r.start : r.end] == r.surface and r.surface == r.surface.strip()


def test_raw_and_natural_pairs(spark, joined):
    docs, j = joined
    m = datasets.map_mentions(j)
    raw = datasets.raw_pairs(m, docs).collect()
    assert sum(r.label for r in raw) == 2 and {r.difficulty for r in raw if not r.label} <= {"same_label_surface", "same_label_name_overlap", "same_label", "cross_label"}
    natural, out = datasets.natural_pairs(m, docs)
    rows = natural.collect()
    assert sum(r.label for r in rows) == 2 and len(rows) == 6 and {r.mention_label for r in rows} == {"PER"} and out.count() == 0
    assert {r.difficulty for r in rows if not r.label} == {"same_label_surface", "same_label_name_overlap"}
    assert "entity_id" not in natural.columns and "role_a" not in natural.columns
    datasets.assert_private(natural, spark.createDataFrame([(1, "Ánh")], "doc_id long, s string"), ["surface_a", "surface_b", "context_a"], "s")
    with pytest.raises(ValueError):
        datasets.assert_private(natural, spark.createDataFrame([(1, "Trần")], "doc_id long, s string"), ["surface_a", "surface_b", "context_a"], "s")


def test_shared_aliases(spark, joined):
    _, j = joined
    got = datasets.shared_alias_variants(j, rate=0.999)
    r = got.first()
    assert {r.recipient, r.donor} == {"PER_0001", "PER_0002"} and r.alias == {"PER_0001": "An", "PER_0002": "Ánh"}[r.donor] or r.alias == "An"
    new = datasets.with_shared_aliases(j, got).first()
    assert [x.replacement for x in new.replacements if x.entity_id == r.recipient and len(x.original) == 1] == [r.alias]
    assert datasets.shared_alias_variants(j, rate=0.0).count() == 0


def test_publish_dataset(spark, joined, tmp_path):
    docs, j = joined
    natural, _ = datasets.natural_pairs(datasets.map_mentions(j), docs)
    split = spark.createDataFrame([(1, "train"), (2, "test")], "doc_id long, split string")
    counts = datasets.publish(spark, f"file://{tmp_path}/d", natural, docs.withColumn("secret", F.lit("x")), split)
    assert sum(c["pairs"] for c in counts) == 6 and {c["split"] for c in counts} == {"train"}
    assert "secret" not in spark.read.parquet(f"file://{tmp_path}/d/documents").columns
    assert spark.read.parquet(f"file://{tmp_path}/d/pairs").where("split = 'train'").count() == 6


def test_known_names():
    k = names.KnownNames([("xã", "Tân Phú"), ("xã", "Tân"), ("huyện", "Ninh Lộc"), ("huyện", "Hai"), ("huyện", "H ai")])
    t = "ở xã Tân P hú, huyện NinhLộc và xã A"
    assert [(r["original"], r["normalized"]) for r in k.repairs(t, 0, len(t))] == [("Tân P hú", "Tân Phú"), ("NinhLộc", "Ninh Lộc")]
    assert k.chain(", xã Tân Phú, huyện B, tỉnh nào đó") == ["xã tân phú", "huyện b"] and k.chain("nói xã A") == []
    assert k.at("Hai", 0, "huyện") is None and k.at("Tân Phúc", 0, "xã") == ("Tân", 3)


def test_repairs_and_forms(spark):
    g = spark.createDataFrame(GAZ, "code string, parent string, level string, unit string, name string")
    d = spark.createDataFrame([(1, "trú xã Bình H òa nhé")], "doc_id long, text string")
    m = spark.createDataFrame([(1, "LOC", 4, 16)], "doc_id long, label string, start int, end int")
    assert [tuple(r) for r in names.repair_spans(m, d, g).collect()] == [(1, 7, 16, "Bình H òa", "Bình Hòa")]
    assert spark.createDataFrame([("éﬁ",), (None,)], "x string").select(names.unicode_form(F.col("x")), names.unicode_form(F.col("x"), "NFKC")).collect()[0] == ("éﬁ", "éfi")


def test_masked_addresses_get_one_path(spark):
    g = spark.createDataFrame(GAZ, "code string, parent string, level string, unit string, name string")
    rows = [(1, "L1", "commune", "xã", "X", ["district:y"], ["01"]), (1, "L2", "district", "huyện", "y", [], []), (1, "L3", "commune", "phường", "Q", [], ["01"])]
    masked = spark.createDataFrame(rows, "doc_id long, entity_id string, role string, unit string, marker string, chain array<string>, anchors array<string>")
    got = {r.entity_id: (r.name, r.reason) for r in lookup.plan_paths(masked, geo.paths(g)).collect()}
    assert got["L1"][0] in ("Bình Hòa", "Hòa Bình Thạnh") and got["L2"] == ("Ninh Lộc", None) and got["L3"] == (None, "invalid_location_hierarchy")


def test_anonymize_batch(spark):
    docs = spark.createDataFrame([(1, "Thẩm phán: ông Lê Văn Minh. Nguyên đơn: ông Trần Văn Nam. Trần Văn Nam khai.")], "doc_id long, text string")
    tagger = ner.rule_tagger({"PER": r"(?:Lê Văn Minh|Trần Văn Nam)"})
    out = pipelines.anonymize_batch(docs, tagger).first()
    assert out.status == "ready" and out.released_text == "Thẩm phán: ông Lê Văn Minh. Nguyên đơn: ông Trần Văn N. Trần Văn N khai."


def test_anonymize_batch_of_a_document_of_many_mentions(spark, monkeypatch):
    monkeypatch.setattr(cluster, "GROUP_LINKS", 3)
    docs = spark.createDataFrame([(1, "ông Lê Nam. " * 40), (2, "ông Lê Nam khai.")], "doc_id long, text string")
    got = {r.doc_id: r for r in pipelines.anonymize_batch(docs, ner.rule_tagger({"PER": "Lê Nam"})).collect()}
    assert got[1].status == "ready" and got[1].released_text == "ông Lê N. " * 40 and got[2].released_text == "ông Lê N khai."


def test_equal_names_are_clustered_without_their_pairs(spark, monkeypatch):
    """As all pairs cluster them; pairs are made only where titles, last names or places stand in the way."""
    docs = spark.createDataFrame([(1, "ông Lê Nam, bà Lê Nam, Lê Nam. " * 3), (2, "ông Võ An khai. " * 40), (3, "Võ An, võ an, Võ An và UBND.")], "doc_id long, text string")
    rows = [(d, "PER" if n != "UBND" else "ORG", m.start(), m.end(), m.group()) for d, text in docs.collect() for n in ("Lê Nam", "Võ An", "võ an", "UBND") for m in re.finditer(n, text)]
    m = spark.createDataFrame([*rows, (3, "PER", 0, 5, "Võ An"), (3, " ", 7, 12, "võ an")], "doc_id long, label string, start int, end int, surface string")
    key = lambda df: sorted((x.doc_id, x.mention_no, x.cluster_id, x.preserve) for x in df.collect())
    made, whole = [], pairs.candidates
    monkeypatch.setattr(pairs, "candidates", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    got, by_pairs = key(pipelines.predict(docs, m, 0.8)), key(pipelines.predict(docs, m, 0.8, pipelines._same))
    assert got == by_pairs and len(got) > 50
    assert {x.doc_id for x in made[0].collect()} == {1, 3} and made[0].count() < 50 < made[1].count()


def test_reconstruct_batch(spark):
    docs = spark.createDataFrame([(1, "Ông Nguyễn Văn A1 và A1 nói."), (2, "không")], "doc_id long, text string")
    got = {r.doc_id: r for r in pipelines.reconstruct_batch(docs, ner.rule_tagger({"PER": "ông xyz"})).collect()}
    assert got[1].quality_tier == "clean" and got[1].quality_score == 100 and got[1].per_mentions == 2
    assert got[2].reasons == ["insufficient_replacements"] and got[2].quality_tier == "review"


def test_sweeps(spark):
    m = spark.createDataFrame([(1, i, "PER", s, 10 * i, 10 * i + 5, g) for i, (s, g) in enumerate([("Lê An", "x"), ("Lê An", "x"), ("Võ An", "y")])], "doc_id long, mention_no int, label string, surface string, start int, end int, gold string")
    links = spark.createDataFrame([(1, 0, 1, 0.9, "score"), (1, 0, 2, 0.4, "score"), (1, 1, 2, 0.4, "score")], "doc_id long, i int, j int, score double, decision string")
    best = pipelines.threshold_by_clusters(m, links, [0.3, 0.6, 0.95]).first()
    assert best.threshold == 0.6 and best.b3_f1 == 1.0
    docs = spark.createDataFrame([(1, "x" * 40)], "doc_id long, text string")
    got = pipelines.cutoff_by_clusters(m, docs, lambda df: F.lit(0.9), 0.5, [0.0, 0.5]).collect()
    assert got[0].cutoff == 0.5 and got[0].b3_f1 == 1.0
