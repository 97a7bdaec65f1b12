"""Splitting documents into train, validation and test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

SPLITS = ("train", "validation", "test")


def _check_ratios(validation: float, test: float) -> None:
    if not (0 <= validation < 1 and 0 <= test < 1 and validation + test < 1):
        raise ValueError("ratios must not be negative and must add up to less than 1")


def hash_split(docs: DataFrame, validation: float = 0.1, test: float = 0.1, seed: str | int = 42, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Add ``split`` by where the id's hash falls: test is the lowest interval, validation the next. Rows of blank text are left out."""
    _check_ratios(validation, test)
    if text_col:
        docs = docs.where(F.length(T.strip_space(F.col(text_col))) > 0)
    from fractions import Fraction

    both = float(Fraction(str(validation)) + Fraction(str(test)))
    place = T.stable_u64(str(seed), F.col(id_col))
    return docs.withColumn("split", F.when(T.below_ratio(place, test), "test").when(T.below_ratio(place, both), "validation").otherwise("train"))


def ranks(df: DataFrame, group: str, hash_col: str, *ties: str) -> DataFrame:
    """Add ``rank`` in order of a hex hash within each group, and ``n``, the size of the group; no group is sorted in one task.

    Rows are counted by the first four digits of the hash; what comes before is a running sum over at most 65,536 counts
    of a group, and only rows that share the digits are sorted together.
    """
    keyed = df.withColumn("_part", F.substring(hash_col, 1, 4))
    counts = keyed.groupBy(group, "_part").agg(F.count("*").alias("_k"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_k").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_k").over(own).alias("n"))
    joined = keyed.join(placed, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    nth = F.row_number().over(Window.partitionBy(group, "_part").orderBy(hash_col, *ties))
    return joined.withColumn("rank", F.col("_before") + nth).drop("_part", "_g", "_p", "_before")


def stratified_split(docs: DataFrame, strata: list[str], family_col: str | None = None, validation: float = 0.1, test: float = 0.1, seed: str | int = 42, id_col: str = "doc_id") -> DataFrame:
    """(id, split): quotas within each stratum in the order of hashes, then a rescue for challenge families.

    A quota is the rounded-down share, and at least one in strata of ten or more. A family of three or more documents that has
    none in validation, then in test, gets its train document of the smallest hash moved there.
    """
    _check_ratios(validation, test)
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])
    family = F.col(family_col) if family_col else F.lit(None).cast("string")
    keyed = docs.select(F.col(id_col), stratum.alias("stratum"), family.alias("family"))
    keyed = keyed.withColumn("place", T.stable_hash(str(seed), F.col("stratum"), F.col(id_col)))
    ranked = ranks(keyed, "stratum", "place", id_col)
    # The shares are compared in whole numbers, as a tenth is not exact in doubles.
    quota = lambda ratio: F.when((F.col("n") >= 10) & F.lit(ratio > 0), F.greatest(F.floor(F.col("n") * F.lit(str(ratio)).cast("decimal(10,9)")), F.lit(1))).otherwise(F.floor(F.col("n") * F.lit(str(ratio)).cast("decimal(10,9)")))
    v, t = quota(validation), quota(test)
    split = F.when(F.col("rank") <= v, "validation").when(F.col("rank") <= v + t, "test").otherwise("train")
    split_docs = ranked.withColumn("split", split)
    if not family_col:
        return split_docs.select(id_col, "split")
    counts = split_docs.where(F.col("family").isNotNull()).groupBy("family").agg(F.count("*").alias("all"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    lacking = counts.where((F.col("all") >= 3) & ((F.col("validation") == 0) | (F.col("test") == 0)) & (F.col("train") > 0))
    spare = split_docs.where("split = 'train'").join(lacking.select("family", "validation", "test"), "family")
    order = Window.partitionBy("family").orderBy(T.stable_hash(str(seed), F.lit("challenge"), F.col("family"), F.col(id_col)), id_col)
    needed = F.filter(F.array(F.when(F.col("validation") == 0, F.lit("validation")), F.when(F.col("test") == 0, F.lit("test"))), lambda x: x.isNotNull())
    spare = spare.withColumn("turn", F.row_number().over(order)).where("turn <= 2").withColumn("moved", F.get(needed, F.col("turn") - 1))
    moved = spare.where(F.col("moved").isNotNull()).select(id_col, "moved")
    return split_docs.join(moved, id_col, "left").select(id_col, F.coalesce("moved", "split").alias("split"))


def assert_assigned(docs: DataFrame, assignment: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the split of ``assignment``; raises unless each document has one and all three splits are left."""
    missing = docs.join(assignment, id_col, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"documents without a split: {[r[0] for r in missing.select(id_col).limit(5).collect()]}")
    repeated = assignment.groupBy(id_col).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("documents with several splits")
    joined = docs.join(assignment.select(id_col, "split"), id_col)
    if joined.select("split").distinct().count() != len(SPLITS):
        raise ValueError("not all three splits have documents")
    return joined
