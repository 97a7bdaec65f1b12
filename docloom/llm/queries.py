"""The queries of this folder: each takes (spark, sf_dir) and runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, planes=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    docs = _table(spark, sf_dir, "documents")
    return pack_documents(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern(), capacity=1024)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode

    return encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern(), keep_ids=False)


#: Fixed values of the contract: the rules by which pages are judged.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_graph import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def _every_20th(name: str) -> Column:
    return F.col(name) % 20 == 0


def op5_pstable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pstable_ann import search

    return search(_table(spark, sf_dir, "embeddings"), _every_20th("vec_id"), k=20)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_templates import drop_recurring_lines

    return drop_recurring_lines(_table(spark, sf_dir, "documents"), most_part=None).select("doc_id", "lines_dropped", "text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import deduplicated

    return deduplicated(_table(spark, sf_dir, "pages"), min_bytes=0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_scan import document_tokens

    return document_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern()).select("doc_id", "n_tokens")


def op10_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .norm_topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), _every_20th("vec_id"), k=20, scale=64.0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import grafted, numbered, prefix_trie

    head = lambda c: F.crc32(c.cast("string").cast("binary")) % 9
    return prefix_trie(*grafted(numbered(_table(spark, sf_dir, "conversations")), lambda c: c - c % 5, head, 8))


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_packing, op3_byte_bpe, op4_url_graph, op5_pstable_ann, op6_line_templates, op7_warc, op8_toxicity, op9_token_scan, op10_norm_topk)
    return {f.__name__: f for f in (*every, op11_prefix_trie, op12_maxscore, op13_ngram_jaccard)}


def oracle_sql() -> dict[str, str]:
    from . import line_templates

    return {"op6_line_templates": line_templates.ORACLE_SQL, "op7_warc": WARC_SQL, "op10_norm_topk": TOP_K_SQL, "op11_prefix_trie": TRIE_SQL, "op12_maxscore": LEXICAL_SQL, "op13_ngram_jaccard": JACCARD_SQL}


#: Base32 of a hex digest, five bits a character.
WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
), e AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(hex, CAST((i * 5) // 4 AS INTEGER) + 1, 2) || CASE WHEN (i * 5) // 4 = 39 THEN '0' ELSE '' END)::INTEGER >> (3 - (i * 5) % 4)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM e
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
), g AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id FROM s LEFT JOIN least l ON s.doc_id = l.doc_id
"""

LEXICAL_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), n AS (
  SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), tf AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, corpus GROUP BY term
), scores AS (
  SELECT a.item_id, n.doc_id, n.r, CAST(sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * n.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM asked a JOIN tf ON a.term = tf.term JOIN weights w ON a.term = w.term JOIN n ON tf.r = n.r, corpus c
  GROUP BY a.item_id, n.doc_id, n.r
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

#: CRC-32 is reckoned digit by digit, bit by bit.
TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT i.c, t.pos, 0 AS part, t.x FROM ids i JOIN t ON t.c = i.c - i.c % 5 WHERE t.pos <= i.h
  UNION ALL
  SELECT i.c, t.pos, 1, t.x FROM ids i JOIN t ON t.c = i.c WHERE t.pos > i.h
), paths AS (
  SELECT i.c, coalesce(p.path, []) AS path FROM ids i LEFT JOIN (SELECT c, list(x ORDER BY part, pos) AS path FROM r GROUP BY c) p ON i.c = p.c
), prefixes AS (
  SELECT c, d, path[1:d] AS k, len(path) = d AS ends FROM (SELECT c, path, unnest(range(len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM prefixes GROUP BY k, d
), children AS (
  SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY k[1:d - 1]
), full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * octet_length(encode(n.k[n.d].text)) END AS saved FROM nodes n LEFT JOIN children c ON n.k = c.k
), above AS (
  SELECT k[1:e] AS k, n_children, saved FROM (SELECT k, n_children, saved, unnest(range(d + 1)) AS e FROM full_nodes)
), below AS (
  SELECT k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM above GROUP BY k
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON n.k = b.k LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""
