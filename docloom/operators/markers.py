"""Markers: masked names in decisions, such as ``Nguyễn Văn A``, ``xã B`` or ``NLQ1``: finding, typing, linking and rewriting them.

One Arrow stage finds tokens of the grammar with their offsets and neighbourhoods. Typing is then one chain of conditions
over columns, and linking is a row of passes over windows of (document, marker).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import rules
from docloom.functions import text as T
from docloom.operators import spans as S
from docloom.sources.steps import small_batches

LEFT, RIGHT = 150, 120
_DOTTED = rf"(?:[A-ZĐ]\.){{1,5}}[A-ZĐ](?:{rules.ORDINAL})?"
_PAIRS = rf"(?:Th|Ph|Tr|Ng|Ch|Kh|Nh)(?:[ \t]*{rules.ORDINAL})?"
TOKEN = rf"(?<![A-ZĐ\d_])(?:NLQ\s*\d+|NLC\s*\d+|{_DOTTED}|[IVX]{{2,6}}|{_PAIRS}|[A-ZĐ](?:[ \t]*{rules.ORDINAL})?)(?!\w)"

#: Common family names, by which a row of capitalised words is taken for a name; a parameter of ``detect``.
FAMILY_NAMES = (
    "Nguyễn", "Trần", "Lê", "Phạm", "Hoàng", "Huỳnh", "Phan", "Vũ", "Võ", "Đặng", "Bùi", "Đỗ", "Hồ", "Ngô", "Dương", "Lý",
    "Mai", "Đinh", "Trịnh", "Đoàn", "Lâm", "Trương", "Cao", "Châu", "Tạ", "Hà", "Thái", "Lương", "Tô", "Đào", "Tống", "Quách",
)
GIVEN_NAMES = (
    "An", "Anh", "Bình", "Bảo", "Châu", "Chi", "Cường", "Dung", "Dũng", "Đạt", "Đức", "Giang", "Hà", "Hạnh", "Hải", "Hòa", "Khánh", "Khoa",
    "Lan", "Linh", "Long", "Mai", "Minh", "Nam", "Nga", "Nhung", "Oanh", "Phong", "Phúc", "Quang", "Quân", "Sơn", "Tâm", "Thanh", "Thảo", "Toàn", "Trang", "Tuấn",
    "Uyên", "Vân", "Việt", "Xuân", "Yến",
)
PLACE_NAMES = ("An Hòa", "Bình Minh", "Đông Sơn", "Hưng Thịnh", "Long Khánh", "Phú Mỹ", "Tân Lập", "Thanh Bình", "Vĩnh An", "Xuân Lộc")
ORG_NAMES = ("An Phát", "Bình Minh", "Đại Thành", "Hưng Long", "Minh Khang", "Phú Gia", "Tân Tiến", "Thành Công")

_NUMBERED_UNITS = ("house_number", "floor", "room", "parcel", "road_number")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, surface, left, right) of every token of the grammar, with up to 150 and 120 characters beside it."""
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(TOKEN)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                for m in pattern.finditer(text):
                    rows.append(i)
                    out.append((m.start(), m.end(), m.group(), text[max(0, m.start() - LEFT) : m.start()], text[m.end() : m.end() + RIGHT]))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "start", "end", "surface", "left", "right"])

    small_batches()
    return frame.mapInArrow(run, f"id {kind}, start int, end int, surface string, left string, right string").withColumnRenamed("id", id_col)


def _ends_with(c: Column, words, group: int = 1) -> Column:
    """The one of the words, lower-cased with single spaces, that the text ends with, or null."""
    return F.nullif(T.normalize(F.regexp_extract(c, rf"(?iU)(?<!\w)({rules.any_of(words)})\s*$", group)), F.lit(""))


def detect(docs: DataFrame, observations: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", family_names: tuple[str, ...] = FAMILY_NAMES) -> DataFrame:
    """Typed candidates: (id, start, end, surface, marker, label, role, person_anchor, name_prefix, encoding_scheme, link_status, link_evidence, gender, ..., review_reasons).

    ``observations`` (id, label, start, end) of a tagger type what grammar leaves open. Rejections come first, then codes,
    addresses, organisations, names, titles, and last the tagger.
    """
    found = tokens(docs, id_col, text_col).withColumn("marker", F.regexp_replace("surface", r"(?U)\s+", ""))
    if observations is not None:
        seen = observations.select(F.col(id_col).alias("_id"), F.col("label").alias("_label"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        held = found.select(id_col, "start", "end").join(seen, (F.col(id_col) == F.col("_id")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")))
        held = held.groupBy(id_col, "start", "end").agg(F.sort_array(F.collect_set("_label")).alias("seen"))
        found = found.join(held, [id_col, "start", "end"], "left")
    else:
        found = found.withColumn("seen", F.lit(None).cast("array<string>"))
    left, right, marker = F.col("left"), F.col("right"), F.col("marker")
    suffix = T.numeric_suffix(marker)
    before = F.right(left, F.lit(1))
    identifier = rf"(?iU)(?:{rules.any_of(rules.IDENTIFIER_WORDS)})\b[^.;:\n]{{0,80}}\bsố\s*$"
    rejected = F.coalesce(
        F.when(before.rlike(r"(?U)[\p{Lu}\d]"), "inside_uppercase_word_or_identifier"),
        F.when(before.isin("/", "_") | (marker.isin("V") & right.rlike(r"(?U)^/[Vv](?!\w)")), "abbreviation_or_identifier"),
        F.when(left.rlike(rf"(?iU)(?:{rules.any_of(rules.NONENTITY_WORDS)})\s*$"), "technical_or_enumeration_context"),
        F.when(left.rlike(identifier), "document_identifier_context"),
        F.when(suffix.isNotNull() & right.rlike(r"^\s*/\s*\d"), "compound_literal_number"),
        F.when(left.rlike(r"(?:Page|PHẦN|MỤC)\s*$"), "section_number"),
    )
    families = "|".join(family_names)
    prefix = F.nullif(F.trim(F.regexp_extract(left, rf"(?U)(?<!\w)((?:{families})(?:[ \t]+\p{{Lu}}\p{{Ll}}*){{0,4}})[ \t]+$", 1)), F.lit(""))
    found = found.withColumns({"rejected": rejected, "unit": _ends_with(left, rules.ADDRESS_UNITS), "form": _ends_with(left, rules.ORG_FORMS), "prefix": prefix, "suffix": suffix})
    outside = F.when(F.col("prefix").isNotNull(), F.regexp_replace(left, r"(?U)(\p{Lu}\p{Ll}*[ \t]+){1,5}$", "")).otherwise(left)
    declared = F.nullif(T.normalize(F.regexp_extract(outside, rf"(?iU)({rules.any_of(rules.PARTIES)})\s*:\s*(?:(?:ông|bà|anh|chị|cháu)\s*)?$", 1)), F.lit(""))
    found = found.withColumns({"title": _ends_with(outside, rules.PERSON_TITLES), "declaration": declared})
    code = marker.rlike(r"^(NLQ|NLC)\d+$")
    ok, one_seen = F.col("rejected").isNull(), F.when(F.size("seen") == 1, F.col("seen")[0])
    unit_role = F.coalesce(*[F.when(F.col("unit") == u, F.lit(r)) for u, r in rules.ADDRESS_UNITS.items()])
    chain = lambda code_, address, org, name, said, tagged, none: F.when(~ok, none).when(code, code_).when(F.col("unit").isNotNull(), address).when(F.col("form").isNotNull(), org).when(F.col("prefix").isNotNull(), name).when(F.col("title").isNotNull() | F.col("declaration").isNotNull(), said).when(F.size("seen") > 0, tagged).otherwise(none)
    lit = F.lit
    code_label = F.when(F.col("form").isNotNull(), "ORG").when(F.col("title").isNotNull() | marker.startswith("NLC") | right.rlike(r"(?iU)^\s*[,;]?\s*sinh năm\s*:?\s*\d{4}"), "PER").otherwise("UNKNOWN")
    initial = F.when(suffix.isNotNull(), "numbered_initial").otherwise("name_initial")
    alias = F.when(F.contains(marker, lit(".")), "dotted_initials").otherwise("whole_name_alias")
    typed = found.withColumns({
        "label": chain(code_label, F.when(unit_role.isin(*_NUMBERED_UNITS), "ADDR").otherwise("LOC"), lit("ORG"), lit("PER"), lit("PER"), F.coalesce(one_seen, lit("UNKNOWN")), lit("UNKNOWN")),
        "role": chain(F.when(marker.startswith("NLC"), "witness").otherwise("related_party"), unit_role, lit("organization"), lit("person"), lit("person"), F.when(one_seen == "PER", "person").otherwise("unknown"), lit("unknown")),
        "encoding_scheme": chain(lit("procedural_code"), lit("component_alias"), lit("component_alias"), initial, alias, alias, lit("unconfirmed")),
        "link_status": F.when(~ok, "rejected_nonentity").otherwise(chain(lit("unresolved_type"), lit("typed"), lit("typed"), lit("explicit_anchor"), lit("typed"), F.when(F.size("seen") == 1, "typed").otherwise("type_conflict"), lit("unconfirmed_marker"))),
        "link_evidence": F.coalesce("rejected", chain(lit("explicit_procedural_code"), lit("direct_address_grammar"), lit("direct_organization_grammar"), lit("contiguous_name_prefix"), lit("direct_person_grammar"), F.when(F.size("seen") == 1, "ner_observation").otherwise("unconfirmed"), lit("unconfirmed"))),
        "person_anchor": chain(F.concat(lit("code:"), marker), lit(None), lit(None), T.normalize(F.col("prefix")), lit(None), lit(None), lit(None)),
        "name_prefix": chain(lit(None), lit(None), lit(None), F.col("prefix"), lit(None), lit(None), lit(None)),
        "parents": F.when(ok & F.col("unit").isNotNull(), T.normalize(F.regexp_extract(F.regexp_replace(right, r"(?s)[;\n.!?].*$", ""), r"^\s*,\s*(.*)$", 1))),
    })
    dotted = ok & (F.col("label") == "PER") & F.contains(marker, lit("."))
    typed = typed.withColumns({
        "encoding_scheme": F.when(dotted, "dotted_initials").otherwise(F.col("encoding_scheme")),
        "person_anchor": F.when(dotted, F.concat(lit("dotted:"), marker)).otherwise(F.col("person_anchor")),
        "link_status": F.when(dotted, "explicit_code").otherwise(F.col("link_status")),
        "gender": F.when(F.col("name_prefix").rlike(r"(?U)\bThị\b"), "female").when(F.col("name_prefix").rlike(r"(?U)\bVăn\b"), "male").otherwise(F.coalesce(*[F.when(F.col("title") == t, lit(g)) for t, g in rules.GENDER.items()])),
        "start": F.when((F.col("label") == "PER") & F.col("name_prefix").isNotNull(), F.col("start") - (F.length("left") - F.length(F.regexp_extract("left", rf"(?sU)^(.*?)(?<!\w)(?:{families})(?:[ \t]+\p{{Lu}}\p{{Ll}}*){{0,4}}[ \t]+$", 1)))).otherwise(F.col("start")),
        "marker_start": F.col("start"),
    })
    why = F.array(
        F.when(F.col("link_status") == "unconfirmed_marker", "unconfirmed_marker"),
        F.when(F.col("link_status") == "type_conflict", "conflicting_ner_types"),
        F.when(ok & F.col("unit").isNotNull() & ~code & marker.rlike(r"^(I+|IV|VI+|IX|XI+)$"), "numeral_or_alias"),
        F.when(ok & (F.col("role") == "road_number"), "road_number_or_alias"),
        F.when(ok & (suffix >= 20), "large_numeric_suffix_requires_repetition"),
        F.when((F.col("label") == "LOC") & F.col("unit").isNull(), "location_without_address_structure"),
        F.when((F.col("label") == "ORG") & F.col("form").isNull() & ~code, "organization_without_form"),
        F.when(ok & F.col("name_prefix").isNotNull() & right.rlike(r"(?U)^\s+[a-zđ](?!\w)"), "fragmented_initial"),
    )
    done = typed.withColumn("review_reasons", F.array_sort(F.filter(why, lambda x: x.isNotNull())))
    return done.drop("left", "right", "seen", "rejected", "prefix", "title")


def link(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Candidates with people's anchors: what one occurrence of a marker says about the others of its document."""
    peers = Window.partitionBy(id_col, "marker")
    known = lambda cond, c: F.array_compact(F.collect_set(F.when(cond, F.col(c))).over(peers))
    is_code, live = F.col("encoding_scheme") == "procedural_code", F.col("link_status") != "rejected_nonentity"

    # Codes take the one type that any occurrence shows.
    m = candidates.withColumn("_types", known(is_code & (F.col("label") != "UNKNOWN"), "label"))
    one = is_code & (F.size("_types") == 1)
    m = m.withColumns({
        "label": F.when(one, F.col("_types")[0]).when(is_code, "UNKNOWN").otherwise(F.col("label")),
        "link_status": F.when(one, "explicit_code").when(is_code, "unresolved_type").otherwise(F.col("link_status")),
        "review_reasons": _add(F.when(is_code & ~one, F.when(F.size("_types") == 0, "unknown_participant_type").otherwise("conflicting_participant_types"))),
    })
    # Numbered markers that are alone adopt the only anchor, if nothing else bears the marker.
    m = m.withColumns({"_anchors": known(~is_code & (F.col("label") == "PER"), "person_anchor"), "_labels": known(live & (F.col("label") != "UNKNOWN"), "label")})
    adopt = (F.col("link_status") == "unconfirmed_marker") & F.col("suffix").isNotNull() & (F.size("_anchors") == 1) & (F.size(F.array_except("_labels", F.array(F.lit("PER")))) == 0)
    m = m.withColumns({
        "label": F.when(adopt, "PER").otherwise(F.col("label")),
        "role": F.when(adopt, "person").otherwise(F.col("role")),
        "person_anchor": F.when(adopt, F.col("_anchors")[0]).otherwise(F.col("person_anchor")),
        "encoding_scheme": F.when(adopt, "numbered_initial").otherwise(F.col("encoding_scheme")),
        "link_evidence": F.when(adopt, "unique_marker_anchor").otherwise(F.col("link_evidence")),
        "review_reasons": F.when(adopt, F.array_remove("review_reasons", "unconfirmed_marker")).otherwise(F.col("review_reasons")),
        "link_status": F.when(adopt, "linked_by_unique_anchor").otherwise(F.col("link_status")),
    })
    # A large ordinal is believed if its marker recurs, for one person, and as nothing else.
    m = m.withColumns({"_live": F.count_if(live).over(peers), "_other": F.count_if(live & ~F.col("label").isin("PER", "UNKNOWN")).over(peers)})
    believed = live & (F.col("suffix") >= 20) & (F.col("_live") >= 2) & (F.size("_anchors") == 1) & (F.col("_other") == 0)
    m = m.withColumn("review_reasons", F.when(believed, F.array_remove("review_reasons", "large_numeric_suffix_requires_repetition")).otherwise(F.col("review_reasons")))
    # One declaration without an anchor, where there is none, is an anchor; then what is left takes the only one.
    loose = (F.col("label") == "PER") & F.col("person_anchor").isNull()
    m = m.withColumn("_declared", F.count_if(loose & F.col("declaration").isNotNull()).over(peers))
    alias = (F.size("_anchors") == 0) & (F.col("_declared") == 1)
    anchor = F.when(F.size("_anchors") == 1, F.col("_anchors")[0]).when(alias, F.concat(F.lit("alias:"), F.col("marker")))
    m = m.withColumns({
        "link_status": F.when(loose, F.when(F.size("_anchors") == 1, "linked_by_unique_anchor").when(alias, "declared_alias").otherwise("ambiguous_marker")).otherwise(F.col("link_status")),
        "review_reasons": _add(F.when(loose & anchor.isNull(), F.when(F.size("_anchors") > 1, "ambiguous_identity").otherwise("missing_identity_anchor"))),
        "person_anchor": F.when(loose, anchor).otherwise(F.col("person_anchor")),
    })
    return m.drop("_types", "_anchors", "_labels", "_live", "_other", "_declared")


def _add(reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.array_sort(F.array_distinct(F.array_append("review_reasons", reason)))).otherwise(F.col("review_reasons"))


def entities(linked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Linked mentions with ``entity_id``, numbered by label in order of first occurrence, and ``reconstructable``.

    People are one by marker and anchor, codes by code, places by unit and marker, address numbers also by what follows them,
    organisations by form and marker. Contradicting genders, and places under different parents, are flagged.
    """
    live = linked.where("link_status != 'rejected_nonentity'")
    alone = F.concat(F.lit("@"), F.col("start").cast("string"))
    key = (
        F.when(F.col("encoding_scheme") == "procedural_code", F.concat_ws("|", F.lit("code"), "marker"))
        .when((F.col("label") == "PER") & F.col("person_anchor").isNotNull(), F.concat_ws("|", "marker", "person_anchor"))
        .when(F.col("label") == "LOC", F.concat_ws("|", F.coalesce("unit", alone), "marker"))
        .when(F.col("label") == "ADDR", F.concat_ws("|", "unit", "marker", F.coalesce("parents", F.lit(""))))
        .when((F.col("label") == "ORG") & F.col("form").isNotNull(), F.concat_ws("|", "form", "marker"))
        .otherwise(alone)
    )
    keyed = live.withColumn("entity_key", F.concat_ws("#", "label", key))
    own = Window.partitionBy(id_col, "entity_key")
    distinct = lambda c: F.size(F.array_compact(F.collect_set(F.nullif(F.col(c), F.lit(""))).over(own)))
    keyed = keyed.withColumns({"_first": F.min("start").over(own), "_parents": distinct("parents"), "_genders": distinct("gender")})
    keyed = keyed.withColumn("review_reasons", _add(F.when((F.col("label") == "LOC") & (F.col("_parents") > 1), "conflicting_location_parents")))
    keyed = keyed.withColumn("review_reasons", _add(F.when((F.col("label") == "PER") & (F.col("_genders") > 1), "conflicting_name_prefixes")))
    number = F.dense_rank().over(Window.partitionBy(id_col, "label").orderBy("_first", "entity_key"))
    keyed = keyed.withColumn("entity_id", F.concat_ws("_", "label", F.lpad(number.cast("string"), 4, "0")))
    reasons = F.flatten(F.collect_list("review_reasons").over(own))
    return keyed.withColumns({"entity_reasons": F.array_sort(F.array_distinct(reasons)), "reconstructable": (F.size(reasons) == 0) & (F.col("label") != "UNKNOWN")}).drop("_first", "_parents", "_genders")


def synthetic_values(found: DataFrame, seed: str | int = 42, id_col: str = "doc_id", given: tuple[str, ...] = GIVEN_NAMES, places: tuple[str, ...] = PLACE_NAMES, orgs: tuple[str, ...] = ORG_NAMES) -> DataFrame:
    """(id, entity_id, synthetic_value) of reconstructable entities.

    People keep their name's beginning and get a given name of the marker's initial, others in a document different ones while
    they last; an entity without one is left out. Places and organisations take names of a pool, and numbers a small number.
    """
    spark = found.sparkSession
    one = found.where("reconstructable").groupBy(id_col, "entity_id", "label").agg(F.min_by("marker", "start").alias("marker"), F.max("name_prefix").alias("name_prefix"), F.min("start").alias("start"))
    one = one.withColumn("initial", T.initial_letter(F.col("marker")))
    pool = spark.createDataFrame([(g,) for g in given], "name string").withColumn("initial", T.initial_letter(F.col("name"))).groupBy("initial").agg(F.sort_array(F.collect_list("name")).alias("names"))
    turn = Window.partitionBy(id_col, "label", F.when(F.col("label") == "PER", F.col("initial"))).orderBy("start", "entity_id")
    placed = one.withColumn("turn", F.row_number().over(turn) - 1).join(F.broadcast(pool), "initial", "left")  # a fixed list of names
    pick = lambda names, n: F.get(names, F.pmod(F.hash(F.lit(str(seed)), F.col(id_col).cast("string")) + F.col("turn"), n).cast("int"))
    person = F.when(F.col("turn") < F.size("names"), F.concat_ws(" ", "name_prefix", pick(F.col("names"), F.size("names"))))
    fixed = lambda xs: pick(F.array(*[F.lit(x) for x in xs]), F.lit(len(xs)))
    value = F.when(F.col("label") == "PER", person).when(F.col("label") == "LOC", F.when(F.col("turn") < len(places), fixed(places))).when(F.col("label") == "ORG", F.when(F.col("turn") < len(orgs), fixed(orgs))).when(F.col("label") == "ADDR", (F.col("turn") + 1 + T.stable_slot(90, str(seed), F.col(id_col))).cast("string"))
    return placed.select(id_col, "entity_id", value.alias("synthetic_value")).where(F.col("synthetic_value").isNotNull())


def replacements(found: DataFrame, values: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity_id, label, start, end, original, replacement). Entities with an overlapping mention are left out whole.

    A mention of the marker alone gets the last word of a person's value, and a space where letters would touch.
    """
    joined = found.where("reconstructable").join(values, [id_col, "entity_id"])
    flagged = S.overlapping(joined, id_col).withColumn("_bad", F.bool_or("overlaps").over(Window.partitionBy(id_col, "entity_id"))).where("not _bad")
    text = docs.select(id_col, F.col(text_col).alias("_text"))
    full = flagged.join(text.hint("merge"), id_col)  # Spark takes texts that are made of short columns for small
    bare = (F.col("label") == "PER") & (F.col("start") == F.col("marker_start"))
    value = F.when(bare, F.element_at(F.split("synthetic_value", " "), -1)).otherwise(F.col("synthetic_value"))
    touch = lambda c: c.rlike(r"(?U)[\p{L}\d]")
    before, after = T.left_of(F.col("_text"), F.col("start"), 1), T.right_of(F.col("_text"), F.col("end"), 1)
    value = F.concat(F.when(touch(before), " ").otherwise(""), value, F.when(touch(after), " ").otherwise(""))
    original = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    return full.select(id_col, "entity_id", "label", "start", "end", original.alias("original"), value.alias("replacement"))


def reconstruct(docs: DataFrame, observations: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", seed: str | int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rewritten documents with audit columns, entities' mentions, replacements) of decisions, from detection to the round trip."""
    found = entities(link(detect(docs, observations, id_col, text_col), id_col), id_col)
    edits = replacements(found, synthetic_values(found, seed, id_col), docs, id_col, text_col)
    done = S.rewrite(docs, edits, id_col, text_col)
    audit = found.groupBy(id_col).agg(F.count("*").alias("candidates"), F.count_if(F.col("reconstructable")).alias("accepted"), F.array_sort(F.flatten(F.collect_set("entity_reasons"))).alias("entity_reasons"))
    return done.join(audit.hint("merge"), id_col, "left").withColumn("replacements", F.size("edits")), found, edits


def resolve_with(found: DataFrame, resolver, excerpts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ask an outside ``resolver`` about open mentions; off unless called.

    It maps frames (id, start, marker, excerpt, choices) to lists of (choice, quote). A choice counts only if it is among those offered and
    its quote of at least 12 characters stands in the excerpt; even then the mention goes to review.
    """
    import pandas as pd

    kind = dict(excerpts.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                answers = resolver(part)
            except Exception:  # an unreachable resolver abstains
                answers = [(None, None)] * len(part)
            good = [c if c is not None and c in list(o) and q and len(q) >= 12 and q in e else None for (c, q), o, e in zip(answers, part["choices"], part["excerpt"])]
            yield pd.DataFrame({id_col: part[id_col], "start": part["start"], "resolved": good})

    answers = excerpts.mapInPandas(run, f"`{id_col}` {kind}, start int, resolved string")
    joined = found.join(answers, [id_col, "start"], "left")
    settled = ("ambiguous_identity", "missing_identity_anchor", "unknown_participant_type", "conflicting_ner_types", "unconfirmed_marker")
    kept = F.array_except("review_reasons", F.array(*[F.lit(r) for r in settled]))
    yes = F.col("resolved").isNotNull()
    return joined.withColumns({
        "person_anchor": F.when(yes, F.col("resolved")).otherwise(F.col("person_anchor")),
        "link_status": F.when(yes, "linked_by_llm").otherwise(F.col("link_status")),
        "review_reasons": F.when(yes, F.array_sort(F.array_append(kept, F.lit("llm_decision_requires_review")))).otherwise(F.col("review_reasons")),
    }).drop("resolved")
