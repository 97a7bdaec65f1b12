"""Quality of reconstructed documents: reasons, scores, tiers, selection and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules

VERSION = "quality-v2"


def penalties(spark) -> DataFrame:
    """(reason, unit, hard) for all known reasons."""
    return spark.createDataFrame([(r, u, r in rules.HARD_FAIL) for r, u in rules.PENALTIES.items()] + [("error", rules.DEFAULT_PENALTY, True)], "reason string, unit int, hard boolean")


def reasons_of(audit: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, reason, n) from an audit's errors, its own and its entities' reasons, mentions' reasons, failed round trips and overlaps.

    Columns that are not there count as empty: error, row_error, review_reasons, entity_reasons, mention_reasons
    (arrays of strings), roundtrip_verified, overlaps.
    """
    have = set(audit.columns)
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c), none) for c in ("review_reasons", "entity_reasons", "mention_reasons") if c in have]
    if "error" in have:
        lists.append(F.when(F.col("error").isNotNull(), F.array(F.lit("error"))).otherwise(none))
    if "row_error" in have:
        lists.append(F.when(F.col("row_error").isNotNull(), F.array(F.col("row_error"))).otherwise(none))
    if "roundtrip_verified" in have:
        lists.append(F.when(~F.col("roundtrip_verified"), F.array(F.lit("roundtrip_failed"))).otherwise(none))
    if "overlaps" in have:
        lists.append(F.array_repeat(F.lit("overlapping_replacement_spans"), F.coalesce(F.col("overlaps"), F.lit(0))))
    return audit.select(id_col, F.explode(F.concat(*lists) if lists else none).alias("reason")).groupBy(id_col, "reason").agg(F.count("*").alias("n"))


def score(docs: DataFrame, reasons: DataFrame, id_col: str = "doc_id", min_replacements: int = 1) -> DataFrame:
    """One row for each of ``docs`` (id, replacements, roundtrip_verified): score, tier, eligible, reasons and their counts and penalties.

    A reason costs its unit once, and twice if it came up more often. Too few replacements are a reason that costs 20.
    A null ``roundtrip_verified`` counts as verified.
    """
    table = F.broadcast(penalties(docs.sparkSession))  # the fixed table of reasons
    enough = F.coalesce(F.col("replacements"), F.lit(0)) >= min_replacements
    few = docs.where(~enough).select(id_col, F.lit("insufficient_replacements").alias("reason"), F.lit(1).cast("long").alias("n"))
    joined = reasons.select(id_col, "reason", "n").unionByName(few).join(table, "reason", "left")
    unit = F.when(F.col("reason") == "insufficient_replacements", 20).otherwise(F.coalesce("unit", F.lit(rules.DEFAULT_PENALTY)))
    cost = F.when(F.col("reason") == "insufficient_replacements", F.lit(20)).otherwise(F.least(unit * F.least(F.col("n"), F.lit(3)), unit * 2)).cast("int")
    per = joined.select(id_col, "reason", "n", cost.alias("cost"), F.coalesce("hard", F.lit(False)).alias("hard")).groupBy(id_col).agg(
        F.sum("cost").alias("cost"),
        F.sort_array(F.collect_list("reason")).alias("reasons"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "cost")))).alias("penalties"),
        F.sort_array(F.collect_list(F.when(F.col("hard"), F.col("reason")))).alias("hard_fail_reasons"),
    )
    none = F.array().cast("array<string>")
    whole = docs.join(per, id_col, "left")
    points = F.greatest(F.lit(0), F.lit(100) - F.coalesce("cost", F.lit(0))).cast("int")
    verified = F.coalesce(F.col("roundtrip_verified"), F.lit(True))
    eligible = verified & enough & (F.size(F.coalesce("hard_fail_reasons", none)) == 0)
    return whole.select(
        id_col,
        F.lit(VERSION).alias("quality_version"),
        points.alias("quality_score"),
        tier(points, eligible).alias("quality_tier"),
        eligible.alias("eligible"),
        verified.alias("roundtrip_verified"),
        F.coalesce(F.col("replacements"), F.lit(0)).alias("replacements"),
        F.coalesce("reasons", none).alias("reasons"),
        "reason_counts",
        F.coalesce("hard_fail_reasons", none).alias("hard_fail_reasons"),
        "penalties",
    )


def tier(points: Column, eligible: Column) -> Column:
    return F.when(eligible & (points >= 85), "clean").when(points >= 60, "review").otherwise("reject")


def selected(quality: Column, min_score: int = 85, allow_review: bool = False) -> Column:
    """Whether a row passes: by its score, and without reasons unless review is allowed. Eligibility is required as well."""
    fits = (quality["quality_score"] >= min_score) & quality["eligible"]
    return fits if allow_review else fits & (F.size(quality["reasons"]) == 0)


def report(scored: DataFrame, groups: list[str], is_selected: Column) -> DataFrame:
    """(scope, value, rows, selected): in all, by tier and by each of ``groups``, in one pass over grouping sets."""
    names = ["quality_tier", *groups]
    rows = scored.select(*[F.col(n).cast("string").alias(n) for n in names], is_selected.cast("int").alias("_selected"))
    sets = F.array(F.struct(F.lit("all").alias("scope"), F.lit("").alias("value")), *[F.struct(F.lit(n).alias("scope"), F.coalesce(F.col(n), F.lit("Unknown")).alias("value")) for n in names])
    return rows.select(F.explode(sets).alias("g"), "_selected").groupBy("g.scope", "g.value").agg(F.count("*").alias("rows"), F.sum("_selected").alias("selected"))


def reason_totals(reasons: DataFrame) -> DataFrame:
    """(reason, documents, n), the most frequent first."""
    return reasons.groupBy("reason").agg(F.count("*").alias("documents"), F.sum("n").alias("n")).orderBy(F.col("n").desc(), "reason")


def with_fallback(synthetic: DataFrame, audit: DataFrame, computed: DataFrame, quality_col: str = "reconstruction_quality", id_col: str = "doc_id") -> DataFrame:
    """``synthetic`` with the quality that is stated first: its own, the audit's, or the ``computed`` one; ids are distinct in the latter two."""
    side = lambda df, name: df.select(id_col, F.col(quality_col).alias(name))
    joined = synthetic.join(side(audit, "_of_audit"), id_col, "left").join(side(computed, "_computed"), id_col, "left")
    own = [F.col(quality_col)] if quality_col in synthetic.columns else []
    return joined.withColumn(quality_col, F.coalesce(*own, "_of_audit", "_computed")).drop("_of_audit", "_computed")
