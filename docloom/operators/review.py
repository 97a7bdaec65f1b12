"""Human review: mining what is worth it, sampling, queues, checks of annotations, and their evaluation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import evaluate as E
from docloom.operators.curate import dedup_texts

DECISIONS = ("entity", "not_entity", "unsure")
_PROVINCE = r"(?iU)(?:tỉnh|thành phố|tp\.)\s+(\p{Lu}\p{Ll}*(?:\s+\p{Lu}\p{Ll}*)*)"


def normalize_surface(value: str) -> str:
    """Compatibility forms made alike, lower case, single spaces."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip().lower()


def normalized_surface(c: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else normalize_surface(v))

    return F.pandas_udf(run, "string")(c)


def nearby_province(left: Column) -> Column:
    """The last province named on the left."""
    return F.try_element_at(F.regexp_extract_all(left, F.lit(_PROVINCE), 1), F.lit(-1))


def strata(mentions: DataFrame, id_col: str = "doc_id", entity_col: str = "entity_id") -> DataFrame:
    """(id, strata): what makes a document hard: a surface of several entities, an entity of several surfaces, people who share a last name, places of one name."""
    rows = mentions.select(id_col, entity_col, "label", T.normalize(F.col("surface")).alias("s"), F.try_element_at(T.tokens(F.col("surface")), F.lit(-1)).alias("last"), F.size(T.tokens(F.col("surface"))).alias("n"))
    found = lambda df, keys, what, name: df.groupBy(id_col, *keys).agg(F.count_distinct(what).alias("k")).where("k > 1").select(id_col, F.lit(name).alias("stratum")).distinct()
    parts = [
        found(rows, ["label", "s"], entity_col, "same_surface_many_entities"),
        found(rows, [entity_col], "s", "one_entity_many_surfaces"),
        found(rows.where("label = 'PER' and n > 1"), ["last"], entity_col, "shared_last_name"),
        found(rows.where("label = 'LOC'"), ["s"], entity_col, "same_place_name"),
    ]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy(id_col).agg(F.sort_array(F.collect_set("stratum")).alias("strata"))


def availability(listed: DataFrame) -> DataFrame:
    """(stratum, documents)."""
    return listed.select(F.explode("strata").alias("stratum")).groupBy("stratum").agg(F.count("*").alias("documents"))


def cover(listed: DataFrame, n: int, id_col: str = "doc_id", seed: str | int = 42) -> list:
    """n ids that together cover the strata: again and again the document with most strata not covered, then most strata, then by hash.

    Which documents can be chosen depends on their set of strata alone, so n candidates of each set, of which there are few,
    are all that is gathered.
    """
    key = F.array_join("strata", "|")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(T.stable_hash(str(seed), F.col(id_col))))
    rows = listed.withColumn("_rank", rank).where(F.col("_rank") <= n).withColumn("_hash", T.stable_hash(str(seed), F.col(id_col))).collect()
    chosen, covered, left = [], set(), list(rows)
    while left and len(chosen) < n:
        best = min(left, key=lambda r: (-len(set(r["strata"]) - covered), -len(r["strata"]), r["_hash"]))
        chosen.append(best[id_col])
        covered |= set(best["strata"])
        left.remove(best)
    return chosen


def controls(docs: DataFrame, n: int, id_col: str = "doc_id", seed: str | int = 42) -> DataFrame:
    """n documents by hash."""
    return docs.orderBy(T.stable_hash(str(seed), F.col(id_col)), id_col).limit(n)


def rejected_sample(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", count_col: str = "mentions", seed: str | int = 42, least: int = 4, most: int = 100) -> DataFrame:
    """n rejected documents with a workable number of mentions, of different texts, by hash."""
    fit = docs.where(F.col(count_col).between(least, most))
    return controls(dedup_texts(fit, id_col, text_col), n, id_col, seed)


def queue(docs: DataFrame, mentions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, mentions[{id, start, end, text}]): what annotators see, without strata, entities or scores. Raises if either side lacks documents."""
    for a, b in ((docs, mentions), (mentions, docs)):
        if not a.select(id_col).distinct().join(b.select(id_col).distinct(), id_col, "left_anti").isEmpty():
            raise ValueError("documents and mentions are not of the same documents")
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("start", "end"))
    ids = mentions.select(id_col, "start", "end", F.col("surface").alias("text")).distinct().withColumn("id", F.concat(F.lit("M"), F.lpad(nth.cast("string"), 4, "0")))
    listed = ids.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("id", "start", "end", "text"))).alias("mentions"))
    return docs.select(id_col, F.col(text_col).alias("text")).join(listed, id_col)


def annotation_errors(annotations: DataFrame, queued: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, errors) of annotations (id, status, decisions: map of mention to {decision, cluster_id}) against the queue; complete ones decide on all mentions."""
    joined = annotations.join(queued.select(id_col, "text", "mentions"), id_col, "left")
    ids = F.transform("mentions", lambda m: m["id"])
    entries = F.map_entries("decisions")
    errors = F.array(
        F.when(F.col("text").isNull(), "unknown document"),
        F.when(F.size(F.array_except(F.map_keys("decisions"), ids)) > 0, "unknown mention"),
        F.when(F.exists(entries, lambda e: ~e["value"]["decision"].isin(*DECISIONS)), "unknown decision"),
        F.when(F.exists(entries, lambda e: (e["value"]["decision"] == "entity") & (F.coalesce(e["value"]["cluster_id"], F.lit("")) == "")), "entity without cluster"),
        F.when((F.col("status") == "complete") & (F.size(F.array_except(ids, F.map_keys("decisions"))) > 0), "incomplete"),
        F.when(~F.col("status").isin("draft", "complete"), "unknown status"),
    )
    return joined.select(id_col, F.filter(errors, lambda x: x.isNotNull()).alias("errors")).where(F.size("errors") > 0)


def evaluate_rules(pairs: DataFrame, rules: dict[str, str], group_col: str = "sampling_group", label_col: str = "label") -> DataFrame:
    """Metrics of several rules' predictions, columns by name, by group of samples: one aggregate over rules laid out as rows."""
    long = pairs.select(F.col(group_col).alias("_g"), F.col(label_col).alias("_y"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(c).alias("p")) for n, c in rules.items()])).alias("x"))
    counted = long.groupBy(F.col("_g").alias(group_col), F.col("x.rule").alias("rule")).agg(*E.confusion(F.col("_y"), F.col("x.p")))
    return E.with_rates(counted)


def spans_by_priority(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mentions to show: of overlapping ones those with a marker, then longer, then of a higher score. Clashes chain, so this is a sweep for each document."""
    kind = dict(mentions.dtypes)[id_col]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.assign(_m=frame["marker"].isna(), _l=frame["start"] - frame["end"], _s=-frame["score"].fillna(0)).sort_values(["_m", "_l", "_s", "start"])
        taken: list[tuple[int, int]] = []
        keep = []
        for a, b in zip(ordered["start"], ordered["end"]):
            free = all(b <= x or y <= a for x, y in taken)
            keep.append(free)
            if free:
                taken.append((a, b))
        return ordered[keep][["id", "start", "end", "label", "surface"]]

    rows = mentions.select(F.col(id_col).alias("id"), "start", "end", "label", "surface", "marker", "score")
    return rows.groupBy("id").applyInPandas(one, f"id {kind}, start int, end int, label string, surface string").withColumnRenamed("id", id_col)


def diverse(rows: DataFrame, n: int, category_col: str, signature_col: str, order_col: str) -> DataFrame:
    """n rows: the first of each category, then others whose signature has not come."""
    one = rows.withColumn("_s", F.row_number().over(Window.partitionBy(signature_col).orderBy(order_col)))
    ranked = one.withColumn("_c", F.row_number().over(Window.partitionBy(category_col).orderBy(order_col)))
    kept = ranked.where("_s = 1 or _c = 1").orderBy(F.when(F.col("_c") == 1, 0).otherwise(1), order_col).limit(n)
    return kept.drop("_s", "_c")
