"""Tables of documents, mentions and pairs that the queries share, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.functions import text as T
from docloom.operators import curate, pairs, spans

KINDS = [
    ("EMAIL", "^[A-Za-z0-9_.]+@[A-Za-z0-9.]+$"),
    ("NUM", "^[0-9]{6,}[.,]?$"),
    ("CAP", "^[A-Z]$"),
    ("PER", "^[A-Z][a-z]{9,}[.,]?$"),
    ("ORG", "^(Licensed|License|Apache|Creative|Commons|GNU|MIT)[.,]?$"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.feature_profile(documents(spark, sf_dir), rules.EN_FEATURES)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the documents, with an entity: those of one label whose first four letters agree."""
    found = spans.word_mentions(documents(spark, sf_dir), KINDS)
    return found.withColumn("entity_id", F.concat_ws(":", "label", F.substring(F.lower("surface"), 1, 4)))


def mention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mentions of one label, with the entities of both, a label, a score and a prediction."""
    found = pairs.candidates(mentions(spark, sf_dir), ["label"], keep=("entity_id",))
    short, long = F.least(F.length("surface_a"), F.length("surface_b")), F.greatest(F.length("surface_a"), F.length("surface_b"))
    made = found.withColumns({
        "gold": (F.col("entity_id_a") == F.col("entity_id_b")).cast("int"),
        "score": F.floor(short / long * 1_000_000) / 1_000_000,
        "predicted": (T.normalize(F.col("surface_a")) == T.normalize(F.col("surface_b"))).cast("int"),
        "jaccard": T.jaccard(T.tokens(F.col("surface_a")), T.tokens(F.col("surface_b"))),
    })
    kind = F.when(F.col("gold") == 1, "positive").when(F.col("predicted") == 1, "same_label_surface").when(F.col("jaccard") > 0, "same_label_name_overlap").otherwise("same_label")
    return made.withColumns({"difficulty": kind, "pair_id": pairs.pair_id(F.col("doc_id"), F.col("start_a"), F.col("start_b"))})


def sql_hash(*parts: str, seed: str = "'42'") -> str:
    return f"sha256({' || chr(31) || '.join([seed, *(f'CAST({p} AS VARCHAR)' for p in parts)])})"


def sql_u64(*parts: str, seed: str = "'42'") -> str:
    return f"CAST('0x' || substr({sql_hash(*parts, seed=seed)}, 1, 16) AS UBIGINT)"


_CASE = " ".join(f"WHEN regexp_matches(surface, '{p}') THEN '{k}'" for k, p in KINDS)
MENTIONS_SQL = f"""
words_ AS (
  SELECT doc_id, unnest(w) AS surface, unnest(range(len(w))) AS word_no FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[ \n]') AS w FROM documents)
), placed_ AS (
  SELECT doc_id, surface, word_no, CASE {_CASE} END AS label,
    sum(length(surface) + 1) OVER (PARTITION BY doc_id ORDER BY word_no) - length(surface) - 1 AS at_ FROM words_
), mentions AS (
  SELECT doc_id, label, CAST(at_ AS INTEGER) AS "start", CAST(at_ + length(surface) AS INTEGER) AS "end", surface, CAST(word_no AS INTEGER) AS word_no,
    label || ':' || substr(lower(surface), 1, 4) AS entity_id FROM placed_ WHERE label IS NOT NULL
)"""
PAIRS_SQL = f"""{MENTIONS_SQL}, pairs AS (
  SELECT a.doc_id, a.label, a."start" AS start_a, a."end" AS end_a, a.surface AS surface_a, a.entity_id AS entity_id_a,
    b."start" AS start_b, b."end" AS end_b, b.surface AS surface_b, b.entity_id AS entity_id_b,
    CAST(a.entity_id = b.entity_id AS INTEGER) AS gold,
    floor(CAST(least(length(a.surface), length(b.surface)) AS DOUBLE) / greatest(length(a.surface), length(b.surface)) * 1000000) / 1000000 AS score,
    CAST(lower(a.surface) = lower(b.surface) AS INTEGER) AS predicted,
    CASE WHEN a.entity_id = b.entity_id THEN 'positive' WHEN lower(a.surface) = lower(b.surface) THEN 'same_label_surface' ELSE 'same_label' END AS difficulty,
    CAST(a.doc_id AS VARCHAR) || ':' || substr(sha256(CAST(a.doc_id AS VARCHAR) || chr(31) || CAST(a."start" AS VARCHAR) || chr(31) || CAST(b."start" AS VARCHAR)), 1, 20) AS pair_id
  FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.label = b.label AND a."start" < b."start"
)"""
FEATURES_SQL = "features AS (SELECT doc_id, lang, source, text, n_chars, " + ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS INTEGER) AS {n}" for n, p in rules.EN_FEATURES.items()) + " FROM documents)"
PRIMARY_SQL = "CASE " + " ".join(f"WHEN {c} > 0 THEN '{c}'" for c in rules.CHALLENGES) + " ELSE 'simple' END"
RELEVANT_SQL = "CAST(greatest(" + ", ".join(rules.RELEVANT) + ") > 0 AS INTEGER)"
