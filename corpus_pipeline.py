"""Corpus pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Each is
written as Parquet in the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._shared import materialize
from docloom.llm.line_templates import drop_recurring_lines
from docloom.llm.packing import pack_documents
from docloom.llm.simhash import one_of_each
from docloom.llm.toxicity import fit, score

#: Five-word shingles and a Jaccard similarity of 0.8 or more, computed from the shingles. For sets of equal size that
#: similarity is a cosine of 0.889 and so an angle of 0.1515 half turns: 78 of 512 planes, of a deviation of 8. The radius
#: of what is tried lies four of them above.
NEAR = {"shingle": 5, "planes": 512, "radius": 112, "bands": (48, 13), "similar": 0.8}


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not."""
    while name in docs.columns:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learnt from ``labels``, scores at 0.5 or more go. Null texts stay."""
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = _free(docs, "toxicity_score")
    return score(docs, machine, score_col=own).where(F.col(own) < 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for their first document; ``n_chars`` follows. A document of which nothing is left goes.

    A document that would lose over a third is a version of another and stays whole, so that near copies reach near_dedup as they are.
    """
    gone = _free(docs, "lines_gone")
    blank = lambda c: F.coalesce(F.length(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(0)) == 0
    dropped = drop_recurring_lines(docs, count_col=gone).where((F.col(gone) == 0) | ~blank(F.col("text")))
    return dropped.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return one_of_each(docs, **NEAR)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of the documents left, with its sequence and offset."""
    import public_tokenizers as tokenizers

    return pack_documents(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL expresses neither the trained scores nor connected components; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
