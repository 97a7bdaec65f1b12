"""Selecting documents: features, filters, deduplication, top-k per stratum, pools and caps.

An empty table gives an empty result everywhere. A null text has no features and is neither long enough nor anybody's copy; null
ids rank first, and nulls of a stratum make one stratum, that of the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import rules
from docloom.functions import text as T
from docloom.sources.steps import stored


def document_id(df: DataFrame, names: Iterable[str] = ("case_id", "doc_name", "official_document_id", "id"), fallback: Column | None = None) -> Column:
    """The first of the named columns that is there and not blank."""
    found = [T.blank(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*found, *([fallback.cast("string")] if fallback is not None else [F.lit(None).cast("string")]))


def with_default(df: DataFrame, names: Iterable[str], default: str = "Unknown") -> Column:
    """The first of the named columns that is there and not blank, or the default: categories, levels, metadata."""
    return T.first_present(*[F.col(n) for n in names if n in df.columns], default=default)


def unused(df: DataFrame, name: str) -> str:
    """The name, or if ``df`` has such a column the name with underscores that it has not."""
    while name in df.columns:
        name += "_"
    return name


def stratum(*columns: Column, default: str = "unknown") -> Column:
    return F.concat_ws("|", *[F.coalesce(T.blank(c), F.lit(default)) for c in columns])


def feature_profile(docs: DataFrame, features: dict[str, str], text_col: str = "text") -> DataFrame:
    """Add a count for each pattern, and ``relevant`` and ``primary_challenge``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumns({name: F.regexp_count(text, F.lit(pattern)).cast("int") for name, pattern in features.items()})
    relevant = F.greatest(*[F.col(c) for c in rules.RELEVANT if c in features]) > 0
    return counted.withColumns({"relevant": relevant.cast("int"), "primary_challenge": primary_challenge(features)})


def primary_challenge(features: Iterable[str], found: Callable[[str], Column] = lambda c: F.col(c) > 0) -> Column:
    """The first family, in order of precedence, that has a count, or that is ``found``."""
    return F.coalesce(*[F.when(found(c), F.lit(c)) for c in rules.CHALLENGES if c in features], F.lit("simple"))


def interest_score(procedural: Column, dotted: Column, address: Column, person: Column) -> Column:
    return 4 * procedural + 4 * dotted + 3 * address + F.least(person, F.lit(8))


def long_enough(text: Column, at_least: int, at_most: int | None = None) -> Column:
    """By the stripped length from below, and by the whole length from above."""
    fits = F.length(T.strip_space(text)) >= at_least
    return fits & (F.length(text) <= at_most) if at_most is not None else fits


def in_future(issued: Column, today: Column) -> Column:
    """Whether the date that the text begins with is after ``today``; an unreadable one is not."""
    return F.coalesce(F.try_to_date(F.substring(issued.cast("string"), 1, 10), "yyyy-MM-dd") > today, F.lit(False))


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text, that of the smallest id. Hashes of texts, not texts, are aggregated; so a common text does not gather in one task."""
    hashed = docs.select(F.col(id_col).alias("_id"), F.sha2(F.col(text_col), 256).alias("_hash"))
    first = hashed.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.min("_id").alias(id_col)).select(id_col)
    return docs.join(first, id_col, "left_semi")


def top_k_per_stratum(docs: DataFrame, strata: list[Column], k: int, seed: str | int = 42, id_col: str = "doc_id", total: int | None = None) -> DataFrame:
    """The k rows of each stratum with the smallest stable hash, which is added as ``stable_rank``; at most ``total`` in all."""
    ranked = docs.withColumn("stable_rank", F.substring(T.stable_hash(str(seed), F.col(id_col)), 1, 32))
    window = Window.partitionBy(*strata).orderBy("stable_rank", id_col)
    own = unused(docs, "_rank")
    kept = ranked.withColumn(own, F.row_number().over(window)).where(F.col(own) <= k).drop(own)
    return kept.orderBy("stable_rank", id_col).limit(total) if total is not None else kept


def challenge_pool(docs: DataFrame, reasons: Column, k: int, seed: str | int = 42, id_col: str = "doc_id") -> DataFrame:
    """(id, reasons): for each reason the k documents of the smallest hash; a document can be in several pools."""
    rows = docs.select(F.col(id_col), F.explode(F.array_distinct(reasons)).alias("reason"))
    window = Window.partitionBy("reason").orderBy(T.stable_hash(str(seed), F.col("reason"), F.col(id_col)), id_col)
    kept = rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k)
    return kept.groupBy(id_col).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def first_per_category(docs: DataFrame, categories: Column, k: int, id_col: str = "doc_id") -> DataFrame:
    """(id, categories): for each category its first k documents by id, merged."""
    rows = docs.select(F.col(id_col), F.explode(F.array_distinct(categories)).alias("category"))
    kept = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("category").orderBy(id_col))).where(F.col("_rank") <= k)
    return kept.groupBy(id_col).agg(F.sort_array(F.collect_set("category")).alias("categories"))


def not_seen(docs: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose keys is among ``seen``; used to resume."""
    for key in keys:
        docs = docs.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return docs


def strictly_clean(quality: Column, replacements: Column) -> Column:
    """Eligible with a full score, no reasons, a verified round trip, and at least one replacement."""
    return quality["eligible"] & (quality["quality_score"] == 100) & (F.size(quality["reasons"]) == 0) & quality["roundtrip_verified"] & (replacements >= 1)


def default_selected(selected: Column, quality: Column) -> Column:
    """What was selected, or else eligible rows of a score of 85 without reasons."""
    usual = quality["eligible"] & (quality["quality_score"] >= 85) & (F.size(quality["reasons"]) == 0)
    return F.coalesce(selected, usual, F.lit(False))


def challenge_categories(text: Column, reasons: Column, selected: Column, patterns: dict[str, str], wanted: list[str]) -> Column:
    """Signals of a rejected row in a fixed order: its marker families, then its wanted reasons. None for selected rows."""
    marks = [F.when(F.regexp_count(text, F.lit(p)) > 0, F.lit(f"marker_{n}")) for n, p in patterns.items()]
    why = [F.when(F.array_contains(reasons, r), F.lit(r)) for r in wanted]
    return F.when(selected, F.array().cast("array<string>")).otherwise(F.filter(F.array(*marks, *why), lambda x: x.isNotNull()))


def semantic_rejections(text: Column, entities: Column, replacements: Column) -> Column:
    """Reasons, sorted, against a row's replacements: broken spans, amounts, identifiers, compound numbers, lone large ordinals.

    ``entities`` are structs of entity_id, label, marker; ``replacements`` of entity_id, start, end, original.
    """
    identifier = rf"(?iU)(?:{rules.any_of(rules.IDENTIFIER_WORDS)})\b[^.;:\n]{{0,80}}\bsố\s*$"

    def of(r: Column) -> Column:
        valid = r["start"].isNotNull() & r["end"].isNotNull() & (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= F.length(text))
        same = F.substring(text, r["start"] + 1, r["end"] - r["start"]) == r["original"]
        numbered = T.number_suffix(r["original"]).isNotNull()
        after = T.right_of(text, r["end"], 40)
        found = F.array(
            F.when(numbered & after.rlike(r"^[.,]\d{3}"), F.lit("numeric_amount_boundary_collision")),
            F.when(numbered & T.left_of(text, r["start"], 150).rlike(identifier), F.lit("document_identifier_collision")),
            F.when(numbered & after.rlike(r"^\s*/\s*\d"), F.lit("compound_literal_number_collision")),
        )
        return F.when(~F.coalesce(valid, F.lit(False)), F.array(F.lit("invalid_replacement_span"))).when(~F.coalesce(same, F.lit(False)), F.array(F.lit("source_span_mismatch"))).otherwise(found)

    uses = lambda e: F.size(F.filter(replacements, lambda r: r["entity_id"] == e["entity_id"]))
    lone = F.transform(
        entities,
        lambda e: F.when((T.numeric_suffix(e["marker"]) >= 20) & (~(e["label"].eqNullSafe("PER")) | (uses(e) < 2)), F.lit("unsupported_large_numeric_suffix")),
    )
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.flatten(F.transform(replacements, of)), lone), lambda x: x.isNotNull())))


def first_retained(docs: DataFrame, rejected: Column, text_col: str = "text", order_col: str = "line") -> DataFrame:
    """Rows that are not rejected, and of equal texts among these the first; a rejected row is nobody's first.

    ``order_col`` tells rows apart. Hashes are aggregated and places joined back, so that a common text does not gather in one task.
    """
    kept = docs.where(~rejected)
    first = kept.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_hash"), order_col).groupBy("_hash").agg(F.min(order_col).alias(order_col))
    return kept.join(first.select(order_col), order_col, "left_semi")


def diversity_caps(candidates: DataFrame, target: int, order_col: str = "position", category_col: str = "category", family_col: str = "primary_challenge") -> DataFrame:
    """``candidates`` with ``accepted``: in order, while the whole, their category, the unknown category and address families keep below their shares.

    A group takes all its candidates until it is full, so what is accepted follows from the place at which each group fills. The next
    such place is found by counts of blocks of the order, added up, and then within the one block where some group fills
    first; from there on that group takes none, and counts are made anew. At most a few groups can fill before the target is
    reached, as each holds a fixed share of it. Places must differ; candidates without a place are not accepted. A null category or family is one of its own.
    """
    from math import ceil

    caps = {"category": ceil(0.35 * target), "unknown": min(ceil(0.35 * target), ceil(0.25 * target)), "address": ceil(0.60 * target), "all": target}
    category, address = F.coalesce(F.col(category_col), F.lit("")), F.coalesce(F.col(family_col) == "address_marker", F.lit(False))
    narrow = candidates.select(F.col(order_col).alias("place"), category.alias("category"), address.alias("address")).where("place is not null")
    # Written before it is dealt by ranges, which reads it twice: candidates may be costly.
    held = stored(stored(narrow, "diversity-candidates").repartitionByRange("place").withColumn("block", F.spark_partition_id()), "diversity-blocks")
    full: dict[tuple[str, str], object] = {}  # the places at which groups fill

    def open_(place: Column, category: Column, address: Column) -> Column:
        ends = [F.when((F.lit(kind) == "all") | ((F.lit(kind) == "address") & address) | ((F.lit(kind) == "category") & (category == name)), place <= at).otherwise(True) for (kind, name), at in sorted(full.items(), key=lambda g: g[0][0] != "all")]  # the whole first: past it nothing else is asked
        fits = F.lit(target > 0)
        for e in ends:
            fits = fits & e
        return fits

    cap = F.when(F.col("kind") == "category", F.when(F.col("name") == "Unknown", caps["unknown"]).otherwise(caps["category"])).when(F.col("kind") == "address", caps["address"]).otherwise(caps["all"])
    groups = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")), F.when(F.col("address"), F.struct(F.lit("address").alias("kind"), F.lit("").alias("name"))))
    group = F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("g")
    while ("all", "") not in full and target > 0:
        fits = held.where(open_(F.col("place"), F.col("category"), F.col("address")))
        counts = fits.groupBy("block", "category", "address").count()
        counts = counts.select("block", group, "count").groupBy("block", "g.kind", "g.name").agg(F.sum("count").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("kind", "name").orderBy("block"))
        reached = counts.withColumn("before", so_far - F.col("n")).where(F.col("before") + F.col("n") >= cap)
        for kind, name in full:
            reached = reached.where(~((F.col("kind") == kind) & (F.col("name") == name)))
        reached = stored(reached, "diversity-reached")
        first = reached.agg(F.min("block").alias("block")).first().block
        if first is None:
            break
        inside = fits.where(F.col("block") == first).select("place", group).select("place", "g.kind", "g.name").join(reached.where(F.col("block") == first).select("kind", "name", "before"), ["kind", "name"])
        number = F.row_number().over(Window.partitionBy("kind", "name").orderBy("place")) + F.col("before")
        filled = inside.withColumn("number", number).where(F.col("number") == cap).orderBy("place").limit(1).first()
        full[filled.kind, filled.name] = filled.place
    place = F.col(order_col)
    return candidates.withColumn("accepted", F.coalesce(open_(place, category, address), F.lit(False)) & place.isNotNull())
