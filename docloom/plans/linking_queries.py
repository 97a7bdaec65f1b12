"""Queries over mentions: spans, pairs, scorers, metrics, clusters, places, plans and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import anonymize, cluster, curate, datasets, evaluate, geo, lookup, markers, names, ner, pairs, review, roles, scoring, spans
from docloom.plans import fixtures as X
from docloom.plans import pipelines
from docloom.sources.steps import new_folder, stored

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- spans --------------------------------------------------------------------------------------------------------


@query(f'WITH {X.MENTIONS_SQL} SELECT doc_id, label, "start", "end", surface, word_no FROM mentions')
def mention_words(spark, sf_dir):
    return X.mentions(spark, sf_dir).drop("entity_id")


@query(f'WITH {X.MENTIONS_SQL} SELECT doc_id, label, "start", "end", surface FROM mentions WHERE label IN (\'CAP\', \'PER\')')
def mention_spans(spark, sf_dir):
    """The Arrow stage finds the same words by patterns with look-arounds."""
    bounded = {k: rf"(?<![^ \n])(?:{p.strip('^$')})(?![^ \n])" for k, p in X.KINDS if k in ("CAP", "PER")}
    return spans.find_spans(X.documents(spark, sf_dir), bounded)


@query(f"""WITH {X.MENTIONS_SQL}, s AS (SELECT doc_id, label, "start", "end" + (CASE WHEN label = 'CAP' THEN 40 ELSE 0 END) AS "end" FROM mentions),
o AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lead("start") OVER (PARTITION BY doc_id ORDER BY "start", "end") AS nxt FROM s)
SELECT doc_id, "start", coalesce(reach > "start", false) OR coalesce(nxt < "end", false) AS overlaps FROM o""")
def span_overlaps(spark, sf_dir):
    wide = X.mentions(spark, sf_dir).withColumn("end", F.col("end") + F.when(F.col("label") == "CAP", 40).otherwise(0))
    return spans.overlapping(wide).select("doc_id", "start", "overlaps")


@query(f"""WITH {X.MENTIONS_SQL}, o AS (SELECT doc_id, greatest("start" - 30, 0) AS s, "end" + 30 AS e FROM mentions WHERE label = 'CAP')
SELECT m.doc_id, m."start", m.label, o.s AS outer_start FROM mentions m JOIN o ON m.doc_id = o.doc_id AND o.s <= m."start" AND o.e >= m."end" """)
def span_containment(spark, sf_dir):
    m = X.mentions(spark, sf_dir)
    outer = m.where("label = 'CAP'").select("doc_id", "label", F.greatest(F.col("start") - 30, F.lit(0)).alias("start"), (F.col("end") + 30).alias("end"))
    return spans.contained_in(m, outer).select("doc_id", "start", "label", "outer_start")


@query(f"""WITH {X.MENTIONS_SQL}, o AS (SELECT doc_id, greatest("start" - 30, 0) AS s, "end" + 30 AS e FROM mentions WHERE label = 'CAP')
SELECT m.doc_id, m."start", m.label FROM mentions m WHERE label <> 'CAP' AND NOT EXISTS (SELECT 1 FROM o WHERE m.doc_id = o.doc_id AND o.s < m."end" AND o.e > m."start")""")
def span_anti_overlap(spark, sf_dir):
    m = X.mentions(spark, sf_dir)
    taken = m.where("label = 'CAP'").select("doc_id", F.greatest(F.col("start") - 30, F.lit(0)).alias("start"), (F.col("end") + 30).alias("end"))
    return spans.without_overlap(m.where("label <> 'CAP'"), taken).select("doc_id", "start", "label")


@query(f"""WITH {X.MENTIONS_SQL}, p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS part_no FROM documents),
q AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY part_no) - length(line) - 1 AS s FROM p)
SELECT m.doc_id, m."start", CAST(q.part_no AS INTEGER) AS part_no, CAST(m."start" - q.s AS INTEGER) AS part_start FROM mentions m JOIN q ON m.doc_id = q.doc_id AND q.s <= m."start" AND q.s + length(q.line) >= m."end" """)
def spans_in_lines(spark, sf_dir):
    lines = X.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("part_no", "line"))
    end = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("part_no")) - 1
    parts = lines.withColumn("end", end).withColumn("start", F.col("end") - F.length("line")).drop("line")
    found = spans.spans_in_parts(X.mentions(spark, sf_dir), parts)
    return found.select("doc_id", "start", "part_no", F.col("part_start").cast("int").alias("part_start"))


@query(f"""WITH {X.MENTIONS_SQL} SELECT m.doc_id, m."start", substr(d.text, greatest(m."start" - 20, 0) + 1, least(m."start", 20)) || '[MENTION]' || m.surface || '[/MENTION]' || substr(d.text, m."end" + 1, 20) AS context
FROM mentions m JOIN documents d ON m.doc_id = d.doc_id""")
def mention_contexts(spark, sf_dir):
    m = X.mentions(spark, sf_dir).join(X.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return pairs.mention(m, F.col("text"), 20).select("doc_id", "start", "context")


@query(f"""WITH {X.MENTIONS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", label) AS k FROM mentions) SELECT doc_id, "start", 'M' || lpad(CAST(k AS VARCHAR), 4, '0') AS mention_id FROM n""")
def mention_numbers(spark, sf_dir):
    return spans.numbered(X.mentions(spark, sf_dir)).select("doc_id", "start", "mention_id")


@query(f"""WITH {X.MENTIONS_SQL}, f AS (SELECT *, min("start") OVER (PARTITION BY doc_id, entity_id) AS first_ FROM mentions) SELECT doc_id, "start", CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first_, entity_id) AS INTEGER) AS group_no FROM f""")
def entity_numbers(spark, sf_dir):
    return cluster.numbered_by_first(X.mentions(spark, sf_dir), "entity_id").select("doc_id", "start", "group_no")


# ---- pairs --------------------------------------------------------------------------------------------------------


@query(f"WITH {X.PAIRS_SQL} SELECT doc_id, label, start_a, start_b, gold, pair_id FROM pairs")
def pair_candidates(spark, sf_dir):
    return X.mention_pairs(spark, sf_dir).select("doc_id", "label", "start_a", "start_b", "gold", "pair_id")


@query(f"""WITH {X.PAIRS_SQL} SELECT pair_id, 1.0::DOUBLE AS same_label, CAST(lower(surface_a) = lower(surface_b) AS DOUBLE) AS same_surface, CAST(lower(surface_a) = lower(surface_b) AS DOUBLE) AS token_jaccard,
round(least(abs(length(surface_a) - length(surface_b)) / 20.0::DOUBLE, 1), 6) AS surface_length_gap, round(least(ln(1 + abs(start_a - start_b)) / 10.0::DOUBLE, 1), 6) AS log_distance,
CAST(contains(lower(surface_a), lower(surface_b)) OR contains(lower(surface_b), lower(surface_a)) AS DOUBLE) AS one_contains_other FROM pairs""")
def pair_features(spark, sf_dir):
    p = X.mention_pairs(spark, sf_dir)
    c = F.col
    made = pairs.surface_features(c("label"), c("label"), c("surface_a"), c("surface_b"), c("start_a"), c("start_b"), F.lit(None), F.lit(None))
    rounded = ("surface_length_gap", "log_distance")
    return p.select("pair_id", *[(F.round(v, 6) if k in rounded else v).alias(k) for k, v in made.items() if k in ("same_label", "same_surface", "token_jaccard", *rounded, "one_contains_other")])


_POSITIVE = f"(lower(surface_a) = lower(surface_b))::INTEGER, -abs(length(surface_a) - length(surface_b)), abs(start_a - start_b), {X.sql_hash('doc_id', 'start_a', 'start_b')}"


@query(f"WITH {X.PAIRS_SQL} SELECT doc_id, start_a, start_b, CAST(row_number() OVER (PARTITION BY doc_id, entity_id_a ORDER BY {_POSITIVE}) AS INTEGER) AS rank FROM pairs WHERE gold = 1 QUALIFY rank <= 3")
def positive_topk(spark, sf_dir):
    p = X.mention_pairs(spark, sf_dir).withColumnsRenamed({"entity_id_a": "entity_a", "entity_id_b": "entity_b"})
    return pairs.top_positives(p, 3).select("doc_id", "start_a", "start_b", "rank")


_PRIORITY = "CASE difficulty WHEN 'same_label_surface' THEN 0 WHEN 'same_label' THEN 5 ELSE 7 END"
_RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gold ORDER BY CASE WHEN gold = 1 THEN 0 ELSE {_PRIORITY} END, {X.sql_hash('pair_id')}) AS rank FROM pairs)"""


def _ranked(spark, sf_dir):
    order = F.when(F.col("gold") == 1, 0).otherwise(pairs.negative_priority(F.col("difficulty")))
    window = Window.partitionBy("doc_id", "gold").orderBy(order, T.stable_hash("42", F.col("pair_id")))
    return X.mention_pairs(spark, sf_dir).withColumn("rank", F.row_number().over(window))


@query(f"WITH {X.PAIRS_SQL}, {_RANKED} SELECT pair_id, difficulty, CAST(rank AS INTEGER) AS rank FROM ranked WHERE gold = 0 AND rank <= 10")
def negative_priority(spark, sf_dir):
    return _ranked(spark, sf_dir).where("gold = 0 and rank <= 10").select("pair_id", "difficulty", "rank")


@query(f"""WITH {X.PAIRS_SQL}, {_RANKED}, c AS (SELECT *, count_if(gold = 1) OVER (PARTITION BY doc_id) AS p, count_if(gold = 0) OVER (PARTITION BY doc_id) AS n FROM ranked)
SELECT pair_id, gold FROM c WHERE rank <= CASE WHEN gold = 1 THEN least(p, greatest(4, 8 - n)) ELSE least(n, greatest(4, 8 - p)) END""")
def balanced_pairs(spark, sf_dir):
    return pairs.balanced(_ranked(spark, sf_dir), 8, label_col="gold").select("pair_id", "gold")


@query(f"""WITH {X.MENTIONS_SQL}
SELECT m.doc_id, m.entity_id AS entity, m."start", o.entity_id AS other_entity, o."start" AS other_start FROM mentions m JOIN mentions o ON m.doc_id = o.doc_id AND m.entity_id <> o.entity_id
WHERE o."start" = (SELECT max(x."start") FROM mentions x WHERE x.doc_id = m.doc_id AND x.entity_id <> m.entity_id AND x."start" < m."start")
OR o."start" = (SELECT min(x."start") FROM mentions x WHERE x.doc_id = m.doc_id AND x.entity_id <> m.entity_id AND x."start" > m."start")""")
def nearest_cross_entity(spark, sf_dir):
    return pairs.nearest_across(X.mentions(spark, sf_dir))


@query(f"""WITH {X.MENTIONS_SQL}, m AS (SELECT doc_id, entity_id, "start" FROM mentions),
near AS (SELECT m.doc_id, m.entity_id AS e, m."start" AS s, o.entity_id AS oe, o."start" AS os FROM m JOIN m o ON m.doc_id = o.doc_id AND m.entity_id <> o.entity_id
  WHERE o."start" = (SELECT max(x."start") FROM m x WHERE x.doc_id = m.doc_id AND x.entity_id <> m.entity_id AND x."start" < m."start")
  OR o."start" = (SELECT min(x."start") FROM m x WHERE x.doc_id = m.doc_id AND x.entity_id <> m.entity_id AND x."start" > m."start")),
p AS (SELECT DISTINCT doc_id, least(e, oe) AS low, greatest(e, oe) AS high, least(s, os) AS a, greatest(s, os) AS b FROM near),
close AS (SELECT doc_id, low, high, a, b FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, low, high ORDER BY b - a, a) <= 3),
ends AS (SELECT doc_id, entity_id AS e, min("start") AS f, max("start") AS l FROM m GROUP BY 1, 2),
far AS (SELECT x.doc_id, x.e AS low, y.e AS high, CASE WHEN abs(y.l - x.f) >= abs(x.l - y.f) THEN least(x.f, y.l) ELSE least(y.f, x.l) END AS a,
  CASE WHEN abs(y.l - x.f) >= abs(x.l - y.f) THEN greatest(x.f, y.l) ELSE greatest(y.f, x.l) END AS b FROM ends x JOIN ends y ON x.doc_id = y.doc_id AND x.e < y.e)
SELECT * FROM close UNION SELECT * FROM far""")
def near_and_far_pairs(spark, sf_dir):
    return pairs.nearest_and_farthest(X.mentions(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), n AS (SELECT vec_id - 1 AS prev, embedding FROM embeddings)
SELECT e.vec_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(n.embedding, lambda x: x::DOUBLE)), 6) AS cosine,
round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: abs(e.embedding[i]::DOUBLE - n.embedding[i]::DOUBLE))), 4) AS l1 FROM e JOIN n ON e.vec_id = n.prev""")
def pair_vector_features(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    made = pairs.vector_features(F.col("a"), F.col("b"))
    joined = e.join(b, "vec_id")
    return joined.select("vec_id", F.round(made["cosine"], 6).alias("cosine"), F.round(F.aggregate(made["difference"], F.lit(0.0), lambda s, x: s + x), 4).alias("l1"))


# ---- scorers and metrics ------------------------------------------------------------------------------------------


@query(f"WITH {X.PAIRS_SQL} SELECT pair_id, predicted FROM pairs")
def baseline_predict(spark, sf_dir):
    p = X.mention_pairs(spark, sf_dir)
    made = scoring.exact_surface(F.lit("defer"), F.col("label"), F.col("label"), F.col("surface_a"), F.col("surface_b"))
    return p.select("pair_id", made.alias("predicted"))


_RATE = "CASE WHEN {b} = 0 THEN 0 ELSE {a}::DOUBLE / {b} END"
_SIX = "floor({x} * 1000000) / 1000000"
_RATES = ", ".join(
    f"{_SIX.format(x=_RATE.format(a=a, b=b))} AS {n}"
    for n, a, b in (("accuracy", "(tp + tn)", "(tp + fp + tn + fn)"), ("precision", "tp", "(tp + fp)"), ("recall", "tp", "(tp + fn)"), ("f1", "(2 * tp)", "(2 * tp + fp + fn)"))
)
_CELLS = "count_if(gold = 1 AND predicted = 1) AS tp, count_if(gold = 0 AND predicted = 1) AS fp, count_if(gold = 0 AND predicted = 0) AS tn, count_if(gold = 1 AND predicted = 0) AS fn"


def _rounded(df):
    """Six digits, cut off: a rate is one division, equal in both engines, while their ways to round half differ."""
    return df.withColumns({c: F.floor(F.col(c) * 1_000_000) / 1_000_000 for c in ("accuracy", "precision", "recall", "f1")})


@query(f"""WITH {X.PAIRS_SQL}, g AS (SELECT 'all' AS scope, '' AS value, {_CELLS} FROM pairs UNION ALL SELECT 'label', label, {_CELLS} FROM pairs GROUP BY label UNION ALL SELECT 'difficulty', difficulty, {_CELLS} FROM pairs GROUP BY difficulty)
SELECT scope, value, tp, fp, tn, fn, {_RATES} FROM g""")
def metrics_grouping_sets(spark, sf_dir):
    return _rounded(evaluate.grouped_metrics(X.mention_pairs(spark, sf_dir), ["label", "difficulty"], label_col="gold"))


@query(f"""WITH {X.PAIRS_SQL}, t AS (SELECT unnest(range(1, 20)) AS k), s AS (SELECT gold, score FROM pairs),
g AS (SELECT k / 20.0::DOUBLE AS threshold, count_if(gold = 1 AND score >= k / 20.0::DOUBLE) AS tp, count_if(gold = 0 AND score >= k / 20.0::DOUBLE) AS fp, count_if(gold = 0 AND score < k / 20.0::DOUBLE) AS tn, count_if(gold = 1 AND score < k / 20.0::DOUBLE) AS fn FROM t CROSS JOIN s GROUP BY k)
SELECT threshold, tp, fp, tn, fn, {_RATES} FROM g""")
def threshold_sweep(spark, sf_dir):
    return _rounded(evaluate.grid_sweep(X.mention_pairs(spark, sf_dir), label_col="gold"))


_SWEPT = f"""c AS (SELECT score AS threshold, count_if(gold = 1) AS p, count_if(gold = 0) AS n FROM pairs GROUP BY score UNION ALL SELECT 0.0, 0, 0 UNION ALL SELECT 1.0, 0, 0),
d AS (SELECT threshold, sum(p) AS p, sum(n) AS n FROM c GROUP BY threshold),
g AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(n) OVER () - sum(n) OVER w AS BIGINT) AS tn, CAST(sum(p) OVER () - sum(p) OVER w AS BIGINT) AS fn FROM d WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {X.PAIRS_SQL}, {_SWEPT} SELECT threshold, tp, fp, tn, fn, {_RATES} FROM g")
def threshold_sweep_exhaustive(spark, sf_dir):
    return _rounded(evaluate.exhaustive_sweep(X.mention_pairs(spark, sf_dir), label_col="gold"))


_F1, _ACCURACY, _PRECISION = (_RATE.format(a=a, b=b) for a, b in (("(2 * tp)", "(2 * tp + fp + fn)"), ("(tp + tn)", "(tp + fp + tn + fn)"), ("tp", "(tp + fp)")))


@query(f"""WITH {X.PAIRS_SQL}, t AS (SELECT unnest(range(1, 20)) AS k),
g AS (SELECT k / 20.0::DOUBLE AS threshold, count_if(gold = 1 AND score >= k / 20.0::DOUBLE) AS tp, count_if(gold = 0 AND score >= k / 20.0::DOUBLE) AS fp, count_if(gold = 0 AND score < k / 20.0::DOUBLE) AS tn, count_if(gold = 1 AND score < k / 20.0::DOUBLE) AS fn FROM t CROSS JOIN pairs GROUP BY k)
SELECT threshold, tp, fp, tn, fn, {_RATES} FROM g ORDER BY {_F1} DESC, {_ACCURACY} DESC, abs(threshold - 0.5), threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    """The threshold of the highest F1 of the sweep by twentieths."""
    return _rounded(evaluate.best_grid_threshold(evaluate.grid_sweep(X.mention_pairs(spark, sf_dir), label_col="gold")))


@query(f"WITH {X.PAIRS_SQL}, {_SWEPT} SELECT threshold, tp, fp, tn, fn, {_RATES} FROM g ORDER BY {_F1} DESC, {_PRECISION} DESC, threshold DESC LIMIT 1")
def best_threshold_exhaustive(spark, sf_dir):
    return _rounded(evaluate.best_exhaustive_threshold(evaluate.exhaustive_sweep(X.mention_pairs(spark, sf_dir), label_col="gold")))


@query(f"""WITH {X.PAIRS_SQL} SELECT count_if(gold = 0) AS negatives, count_if(gold = 0 AND predicted = 1) AS false_links, count_if(gold = 1) AS positives, count_if(gold = 1 AND predicted = 0) AS missed_links,
round(count_if(gold = 0 AND predicted = 1)::DOUBLE / nullif(count_if(gold = 0), 0), 6) AS false_link_rate, round(count_if(gold = 1 AND predicted = 0)::DOUBLE / nullif(count_if(gold = 1), 0), 6) AS missed_link_rate FROM pairs""")
def link_errors(spark, sf_dir):
    made = evaluate.error_summary(X.mention_pairs(spark, sf_dir), label_col="gold")
    return made.withColumns({c: F.round(c, 6) for c in ("false_link_rate", "missed_link_rate")})


@query(f"""WITH {X.PAIRS_SQL}, o AS (SELECT *, CASE WHEN gold = 0 AND predicted = 1 THEN 'fp' WHEN gold = 1 AND predicted = 0 THEN 'fn' WHEN gold = 1 THEN 'tp' ELSE 'tn' END AS outcome FROM pairs)
SELECT pair_id, outcome, CAST(row_number() OVER (PARTITION BY outcome ORDER BY CASE outcome WHEN 'fp' THEN -score WHEN 'fn' THEN score ELSE 0 END, pair_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 10""")
def confident_errors(spark, sf_dir):
    return evaluate.examples(X.mention_pairs(spark, sf_dir), 10, label_col="gold").select("pair_id", "outcome", "rank")


@query(f"""WITH {X.PAIRS_SQL}, s AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY difficulty, doc_id ORDER BY pair_id) = 1)
SELECT pair_id, difficulty FROM s QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY pair_id) <= 3""")
def example_per_document(spark, sf_dir):
    return evaluate.one_per_document(X.mention_pairs(spark, sf_dir), "difficulty", 3, "pair_id").select("pair_id", "difficulty")


@query(f"WITH {X.PAIRS_SQL} SELECT pair_id, round(1 / (1 + exp(-(-2.0::DOUBLE + 3.5::DOUBLE * predicted + 1.25::DOUBLE * score))), 6) AS score FROM pairs")
def logit_scores(spark, sf_dir):
    p = X.mention_pairs(spark, sf_dir)
    made = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in ("predicted", "score", "jaccard")]))
    weights = spark.createDataFrame([("predicted", 3.5), ("score", 1.25)], "feature string, weight double")
    return scoring.logistic_scores(p.select("pair_id", made.alias("features")), weights, -2.0).select("pair_id", F.round("score", 6).alias("score"))


@query(f"""WITH {X.PAIRS_SQL}, r AS (SELECT *, CASE WHEN start_a % 7 = 0 THEN 'link' WHEN start_a % 5 = 0 THEN 'block' ELSE 'defer' END AS rule FROM pairs)
SELECT pair_id, CAST(CASE rule WHEN 'link' THEN 1 WHEN 'block' THEN 0 ELSE (score >= 0.8)::INTEGER END AS INTEGER) AS predicted, CASE rule WHEN 'link' THEN 2.0 WHEN 'block' THEN -1.0 ELSE score END AS effective FROM r""")
def rule_first_predictions(spark, sf_dir):
    rule = F.when(F.col("start_a") % 7 == 0, "link").when(F.col("start_a") % 5 == 0, "block").otherwise("defer")
    p = X.mention_pairs(spark, sf_dir).withColumn("rule", rule)
    made = scoring.rule_first(F.col("label"), F.col("label"), F.col("rule"), F.lit(False), F.col("score"), 0.8)
    return p.select("pair_id", made.alias("predicted"), evaluate.effective_score(F.col("score"), F.col("rule")).alias("effective"))


@query(f"""WITH {X.MENTIONS_SQL}, p AS (SELECT * FROM mentions WHERE label = 'PER')
SELECT b.doc_id, b."start", min(a."start") AS root_start FROM p b JOIN p a ON a.doc_id = b.doc_id AND a."start" <= b."start" AND contains(a.surface, b.surface) GROUP BY 1, 2""")
def ordered_substring_roots(spark, sf_dir):
    return scoring.person_roots(X.mentions(spark, sf_dir)).select("doc_id", "start", "root_start")


# ---- clusters -----------------------------------------------------------------------------------------------------

_CLUSTERED = f"""{X.MENTIONS_SQL}, m AS (SELECT doc_id, entity_id AS gold, label || lower(surface) AS predicted FROM mentions),
cells AS (SELECT doc_id, gold, predicted, count(*) AS n FROM m GROUP BY 1, 2, 3),
g AS (SELECT doc_id, gold, sum(n) AS n FROM cells GROUP BY 1, 2), p AS (SELECT doc_id, predicted, sum(n) AS n FROM cells GROUP BY 1, 2),
docs AS (SELECT c.doc_id, CAST(sum(c.n) AS BIGINT) AS mentions, sum(c.n * c.n / p.n::DOUBLE) AS ps, sum(c.n * c.n / g.n::DOUBLE) AS rs, CAST(sum(c.n * (c.n - 1) / 2) AS BIGINT) AS tp FROM cells c JOIN g ON c.doc_id = g.doc_id AND c.gold = g.gold JOIN p ON c.doc_id = p.doc_id AND c.predicted = p.predicted GROUP BY c.doc_id),
gp AS (SELECT doc_id, sum(n * (n - 1) / 2) AS k FROM g GROUP BY doc_id), pp AS (SELECT doc_id, sum(n * (n - 1) / 2) AS k FROM p GROUP BY doc_id),
counts AS (SELECT docs.*, CAST(pp.k - tp AS BIGINT) AS fp, CAST(gp.k - tp AS BIGINT) AS fn FROM docs JOIN gp USING (doc_id) JOIN pp USING (doc_id))"""


def _clustered(spark, sf_dir):
    m = X.mentions(spark, sf_dir)
    return m.select("doc_id", F.col("entity_id").alias("gold"), F.concat("label", F.lower("surface")).alias("predicted"))


@query(f"WITH {_CLUSTERED} SELECT doc_id, mentions, tp, fp, fn, round(ps / mentions, 6) AS b3_precision, round(rs / mentions, 6) AS b3_recall, round(2 * (ps / mentions) * (rs / mentions) / (ps / mentions + rs / mentions), 6) AS b3_f1, {_SIX.format(x=_RATE.format(a='(2 * tp)', b='(2 * tp + fp + fn)'))} AS pair_f1, fp = 0 AND fn = 0 AS exact FROM counts")
def bcubed_docs(spark, sf_dir):
    made = evaluate.document_metrics(evaluate.cluster_counts(_clustered(spark, sf_dir)))
    return made.select("doc_id", "mentions", "tp", "fp", "fn", F.round("b3_precision", 6).alias("b3_precision"), F.round("b3_recall", 6).alias("b3_recall"), F.round("b3_f1", 6).alias("b3_f1"), (F.floor(F.col("pair_f1") * 1_000_000) / 1_000_000).alias("pair_f1"), "exact")


@query(f"""WITH {_CLUSTERED} SELECT count(*) AS documents, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
round(sum(ps) / sum(mentions), 6) AS b3_precision, round(sum(rs) / sum(mentions), 6) AS b3_recall, round(2 * (sum(ps) / sum(mentions)) * (sum(rs) / sum(mentions)) / (sum(ps) / sum(mentions) + sum(rs) / sum(mentions)), 6) AS b3_f1, round(count_if(fp = 0 AND fn = 0)::DOUBLE / count(*), 6) AS exact_accuracy FROM counts""")
def bcubed_corpus(spark, sf_dir):
    made = evaluate.corpus_metrics(evaluate.cluster_counts(_clustered(spark, sf_dir)))
    return made.select("documents", "mentions", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("b3_precision", "b3_recall", "b3_f1", "exact_accuracy")])


#: Complete linkage in SQL: in each round the clusters that prefer each other are joined, ties going to the first, and what lacks a
#: score between two clusters is dropped. A round keeps links (kind 0), sizes (kind 1) and the joins so far (kind 2).
_LINKAGE = f"""RECURSIVE {X.MENTIONS_SQL}, numbered AS (
  SELECT doc_id, entity_id, label, surface, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start") - 1 AS INTEGER) AS k FROM mentions
), scored AS (
  SELECT a.doc_id, a.k AS i, b.k AS j,
    floor(CASE WHEN lower(a.surface) = lower(b.surface) THEN 1 ELSE (CAST(a.entity_id = b.entity_id AS DOUBLE) + CAST(least(length(a.surface), length(b.surface)) AS DOUBLE) / greatest(length(a.surface), length(b.surface))) / 2 END * 1000) / 1000 AS score
  FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND a.label = b.label AND a.k < b.k
), rounds AS (
  SELECT 0 AS round, 0 AS kind, doc_id, i, j, score, CAST(1 AS BIGINT) AS n FROM scored WHERE score >= LEAST_
  UNION ALL SELECT 0, 1, doc_id, k, k, NULL, CAST(1 AS BIGINT) FROM numbered
  UNION ALL (
    WITH links AS (SELECT * FROM rounds WHERE kind = 0), sizes AS (SELECT * FROM rounds WHERE kind = 1), sides AS (
      SELECT doc_id, i AS v, i, j, score FROM links UNION ALL SELECT doc_id, j, i, j, score FROM links
    ), best AS (
      SELECT doc_id, i, j, score FROM sides QUALIFY row_number() OVER (PARTITION BY doc_id, v ORDER BY score DESC, i, j) = 1
    ), joins AS (
      SELECT doc_id, i, j, score FROM best GROUP BY doc_id, i, j, score HAVING count(*) = 2
    ), grown AS (
      SELECT s.doc_id, coalesce(x.i, s.i) AS i, CAST(sum(s.n) AS BIGINT) AS n FROM sizes s LEFT JOIN joins x ON s.doc_id = x.doc_id AND s.i = x.j GROUP BY 1, 2
    ), moved AS (
      SELECT l.doc_id, least(coalesce(x.i, l.i), coalesce(y.i, l.j)) AS i, greatest(coalesce(x.i, l.i), coalesce(y.i, l.j)) AS j, min(l.score) AS score, CAST(sum(l.n) AS BIGINT) AS n
      FROM links l LEFT JOIN joins x ON l.doc_id = x.doc_id AND l.i = x.j LEFT JOIN joins y ON l.doc_id = y.doc_id AND l.j = y.j WHERE coalesce(x.i, l.i) <> coalesce(y.i, l.j) GROUP BY 1, 2, 3
    )
    SELECT r.round + 1, 0, m.doc_id, m.i, m.j, m.score, m.n FROM moved m JOIN grown a ON m.doc_id = a.doc_id AND m.i = a.i JOIN grown b ON m.doc_id = b.doc_id AND m.j = b.i, (SELECT max(round) AS round FROM rounds) r WHERE m.n = a.n * b.n
    UNION ALL SELECT r.round + 1, 1, g.doc_id, g.i, g.i, NULL, g.n FROM grown g, (SELECT max(round) AS round FROM rounds) r WHERE EXISTS (SELECT 1 FROM links)
    UNION ALL SELECT r.round + 1, 2, x.doc_id, x.i, x.j, x.score, 0 FROM joins x, (SELECT max(round) AS round FROM rounds) r
  )
), joined AS (SELECT doc_id, j AS v, i AS into_, score FROM rounds WHERE kind = 2)"""


def _scored(spark, sf_dir):
    """All mentions, numbered, and scores of those of a label: equal surfaces, equal entities and how lengths compare."""
    m = X.mentions(spark, sf_dir)
    m = stored(m.withColumn("mention_no", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).cast("int")), "numbered")
    p = pairs.candidates(m, ["label"], keep=("mention_no", "entity_id"))
    short, long = F.least(F.length("surface_a"), F.length("surface_b")), F.greatest(F.length("surface_a"), F.length("surface_b"))
    alike = ((F.col("entity_id_a") == F.col("entity_id_b")).cast("double") + short / long) / 2
    score = F.floor(F.when(T.normalize(F.col("surface_a")) == T.normalize(F.col("surface_b")), 1.0).otherwise(alike) * 1000) / 1000
    return m, p.select("doc_id", F.col("mention_no_a").alias("i"), F.col("mention_no_b").alias("j"), score.alias("score"), F.lit("score").alias("decision"))


@query(f"""WITH {_LINKAGE.replace("LEAST_", "0.8")}, up AS (
  SELECT doc_id, k AS v, k AS root FROM numbered WHERE NOT EXISTS (SELECT 1 FROM joined j WHERE j.doc_id = numbered.doc_id AND j.v = numbered.k)
  UNION ALL SELECT j.doc_id, j.v, u.root FROM up u JOIN joined j ON u.doc_id = j.doc_id AND u.v = j.into_
) SELECT doc_id, v AS mention_no, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY root) AS INTEGER) AS cluster_no FROM up""")
def cluster_mentions(spark, sf_dir):
    """Complete linkage at 0.8, where chains of alike mentions keep single linkage from giving the same."""
    m, scored = _scored(spark, sf_dir)
    return cluster.cluster_documents(m, scored, 0.8).select("doc_id", "mention_no", "cluster_no")


@query(f"""WITH {_LINKAGE.replace("LEAST_", "0.05")}, t AS (SELECT k, k / 20.0::DOUBLE AS threshold FROM (SELECT unnest(range(1, 20)) AS k)), cut AS (
  SELECT t.k, j.doc_id, j.v, j.into_ FROM t JOIN joined j ON j.score >= t.threshold
), up AS (
  SELECT t.k AS step, n.doc_id, n.k AS v, n.k AS root FROM t, numbered n WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.k = t.k AND c.doc_id = n.doc_id AND c.v = n.k)
  UNION ALL SELECT u.step, c.doc_id, c.v, u.root FROM up u JOIN cut c ON u.step = c.k AND u.doc_id = c.doc_id AND u.v = c.into_
), named AS (SELECT u.step, u.doc_id, u.root, n.entity_id AS gold FROM up u JOIN numbered n ON u.doc_id = n.doc_id AND u.v = n.k),
cells AS (SELECT step, doc_id, gold, root, count(*) AS n FROM named GROUP BY ALL),
g AS (SELECT step, doc_id, gold, sum(n) AS n FROM cells GROUP BY ALL), p AS (SELECT step, doc_id, root, sum(n) AS n FROM cells GROUP BY ALL),
sums AS (SELECT step, sum(c.n) AS mentions, sum(c.n * c.n / p.n::DOUBLE) AS ps, sum(c.n * c.n / g.n::DOUBLE) AS rs, sum(c.n * (c.n - 1) / 2) AS tp FROM cells c JOIN g USING (step, doc_id, gold) JOIN p USING (step, doc_id, root) GROUP BY step),
gp AS (SELECT step, sum(n * (n - 1) / 2) AS k FROM g GROUP BY step), pp AS (SELECT step, sum(n * (n - 1) / 2) AS k FROM p GROUP BY step)
SELECT step / 20.0::DOUBLE AS threshold, CAST(mentions AS BIGINT) AS mentions, CAST(tp AS BIGINT) AS tp, CAST(pp.k - tp AS BIGINT) AS fp, CAST(gp.k - tp AS BIGINT) AS fn, round(ps / mentions, 6) AS b3_precision, round(rs / mentions, 6) AS b3_recall
FROM sums JOIN gp USING (step) JOIN pp USING (step)""")
def cluster_threshold_sweep(spark, sf_dir):
    """Metrics of clusters against entities at 19 thresholds; one clustering, cut at each."""
    m, scored = _scored(spark, sf_dir)
    made = pipelines.threshold_by_clusters(m.withColumn("gold", F.col("entity_id")), scored)
    return made.select("threshold", "mentions", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("b3_precision", "b3_recall")])


@query(f"""WITH {X.MENTIONS_SQL}, r AS (SELECT doc_id, entity_id, label, lower(surface) AS s FROM mentions),
st AS (SELECT DISTINCT doc_id, 'same_surface_many_entities' AS stratum FROM r GROUP BY doc_id, label, s HAVING count(DISTINCT entity_id) > 1
UNION SELECT DISTINCT doc_id, 'one_entity_many_surfaces' FROM r GROUP BY doc_id, entity_id HAVING count(DISTINCT s) > 1)
SELECT doc_id, string_agg(stratum, ',' ORDER BY stratum) AS strata FROM st GROUP BY doc_id""")
def review_strata(spark, sf_dir):
    return review.strata(X.mentions(spark, sf_dir)).select("doc_id", F.array_join("strata", ",").alias("strata"))


@query(f"WITH {X.MENTIONS_SQL} SELECT doc_id, CAST(count(*) AS INTEGER) AS mentions FROM mentions GROUP BY doc_id")
def review_queue(spark, sf_dir):
    m = X.mentions(spark, sf_dir)
    docs = X.documents(spark, sf_dir).join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    return review.queue(docs, m).select("doc_id", F.size("mentions").alias("mentions"))


# ---- places -------------------------------------------------------------------------------------------------------

_GAZ = """gaz AS (SELECT 'r' || r_regionkey AS code, '' AS parent, '1' AS level, 'tỉnh' AS unit, r_name AS name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, '2', 'huyện', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, '3', 'xã', s_name FROM supplier)"""


def _gazetteer(spark, sf_dir):
    t = lambda n: X.table(spark, sf_dir, n)
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda c, p, level, unit, name: [c.alias("code"), p.alias("parent"), F.lit(level).alias("level"), F.lit(unit).alias("unit"), F.col(name).alias("name")]
    r = t("region").select(*row(code("r", "r_regionkey"), F.lit(""), "1", "tỉnh", "r_name"))
    n = t("nation").select(*row(code("n", "n_nationkey"), code("r", "n_regionkey"), "2", "huyện", "n_name"))
    return r.unionByName(n).unionByName(t("supplier").select(*row(code("s", "s_suppkey"), code("n", "s_nationkey"), "3", "xã", "s_name")))


_PATHS = f"""{_GAZ}, paths AS (SELECT c.code AS commune_code, d.code AS district_code, p.code AS province_code FROM gaz c JOIN gaz d ON c.parent = d.code JOIN gaz p ON d.parent = p.code WHERE c.level = '3')"""


@query(f"WITH {_PATHS} SELECT * FROM paths")
def admin_paths(spark, sf_dir):
    return geo.paths(_gazetteer(spark, sf_dir)).select("commune_code", "district_code", "province_code")


@query(f"""WITH {_PATHS} SELECT code, code AS ancestor, 0 AS distance FROM gaz UNION ALL SELECT commune_code, district_code, 1 FROM paths UNION ALL SELECT commune_code, province_code, 2 FROM paths
UNION ALL SELECT code, parent, 1 FROM gaz WHERE level = '2'""")
def place_ancestors(spark, sf_dir):
    return geo.ancestors(_gazetteer(spark, sf_dir))


@query(f"""WITH {_GAZ}, one AS (SELECT lower(name) AS n, min(code) AS code FROM gaz GROUP BY 1 HAVING count(*) = 1), asked AS (SELECT DISTINCT name FROM gaz UNION SELECT 'nowhere')
SELECT a.name, one.code FROM asked a LEFT JOIN one ON lower(a.name) = one.n""")
def place_names(spark, sf_dir):
    g = _gazetteer(spark, sf_dir)
    names = g.select("name").unionByName(spark.createDataFrame([("nowhere",)], "name string"))
    return geo.unique_by_name(names, g)


@query(f"""WITH {_PATHS}, k AS (SELECT *, CAST(substr(commune_code, 2) AS INTEGER) AS i FROM paths)
SELECT a.commune_code AS a, b.commune_code AS b, CASE WHEN a.province_code <> b.province_code OR a.district_code <> b.district_code THEN 'block' WHEN a.i = b.i THEN 'link' ELSE 'block' END AS decision
FROM k a JOIN k b ON b.i IN (a.i, a.i + 1, a.i + 25)""")
def location_decision(spark, sf_dir):
    p = geo.paths(_gazetteer(spark, sf_dir)).withColumn("i", F.substring("commune_code", 2, 9).cast("int"))
    place = F.struct(
        F.lit("commune").alias("level"), F.col("commune").alias("name"), F.col("commune_code").alias("code"), F.lit("xa").alias("key"), F.lit(False).alias("fuzzy"),
        F.array("province_code").alias("province"), F.array("district_code").alias("district"), F.array("commune_code").alias("commune"), F.lit(False).alias("ambiguous"),
    )
    a = p.select(F.col("commune_code").alias("a"), F.explode(F.array(F.col("i"), F.col("i") + 1, F.col("i") + 25)).alias("j"), place.alias("pa"))
    b = p.select(F.col("commune_code").alias("b"), F.col("i").alias("j"), place.alias("pb"))
    loc = F.lit("LOC")
    return a.join(b, "j").select("a", "b", geo.rule_decision(loc, loc, F.col("pa"), F.col("pb")).alias("decision"))


_SPELT = "translate(substr(sha256({x}), 1, 10), '0123456789abcdef', 'bcdfghklmnpqrstv')"


@query(f"""WITH s AS (SELECT s_suppkey, {_SPELT.format(x="'s' || s_suppkey")} AS name FROM supplier)
SELECT s_suppkey || ':1' AS ask, 's' || s_suppkey AS code, round(18.0::DOUBLE / 19, 6) AS ratio FROM s UNION ALL SELECT s_suppkey || ':2', 's' || s_suppkey, round(20.0::DOUBLE / 21, 6) FROM s""")
def fuzzy_places(spark, sf_dir):
    """Suppliers as communes of made-up names: one letter missing or doubled is found; three changed, another parent or another unit are not."""
    g = _gazetteer(spark, sf_dir).withColumn("name", F.translate(F.substring(F.sha2("code", 256), 1, 10), "0123456789abcdef", "bcdfghklmnpqrstv"))
    rows = g.where("level = '3'").withColumn("number", F.substring("code", 2, 20).cast("long"))
    name, cut_ = F.col("name"), lambda n, skip: F.concat(F.expr(f"left(name, cast(number % 8 + {n} as int))"), F.expr(f"substring(name, cast(number % 8 + {n} + {skip} + 1 as int))"))
    kinds = {
        1: (cut_(1, 1), F.array("parent"), "xã"), 2: (F.concat(F.expr("left(name, cast(number % 8 + 2 as int))"), F.expr("substring(name, cast(number % 8 + 2 as int))")), F.array("parent"), None),
        3: (F.concat(F.lit("zzz"), F.substring(name, 4, 20)), F.array("parent"), "xã"), 4: (cut_(1, 1), F.array(F.concat(F.lit("n"), F.expr("cast((substring(parent, 2) + 1) % 25 as int)").cast("string"))), "xã"), 5: (cut_(1, 1), F.array("parent"), "huyện"),
    }
    each = F.explode(F.array(*[F.struct(F.concat(F.col("number").cast("string"), F.lit(f":{k}")).alias("ask"), n.alias("name"), p.alias("parents"), F.lit(u).alias("unit")) for k, (n, p, u) in kinds.items()]))
    asked = rows.select(F.lit(3).alias("level"), each.alias("x")).select("level", "x.*")
    return lookup.fuzzy_places(asked, g).select("ask", "code", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_PATHS}, named AS (SELECT p.*, c.name AS commune, d.name AS district, r.name AS province, row_number() OVER (PARTITION BY province_code ORDER BY commune_code) - 1 AS k, count(*) OVER (PARTITION BY province_code) AS n,
  row_number() OVER (PARTITION BY district_code ORDER BY commune_code) - 1 AS kd, count(*) OVER (PARTITION BY district_code) AS nd FROM paths p JOIN gaz c ON p.commune_code = c.code JOIN gaz d ON p.district_code = d.code JOIN gaz r ON p.province_code = r.code),
asked AS (SELECT c_custkey, 'r' || n_regionkey AS r, 'n' || n_nationkey AS d, {X.sql_u64("c_custkey", "'L1,L2'")} AS h, {X.sql_u64("c_custkey", "'L3'")} AS h3 FROM customer JOIN nation ON c_nationkey = n_nationkey),
one AS (SELECT a.c_custkey, n.commune, n.district FROM asked a LEFT JOIN named n ON n.province_code = a.r AND n.k = a.h % n.n), two AS (SELECT a.c_custkey, n.province FROM asked a LEFT JOIN named n ON n.district_code = a.d AND n.kd = a.h3 % n.nd)
SELECT c_custkey AS doc_id, e AS entity_id, CASE e WHEN 'L1' THEN commune WHEN 'L2' THEN district WHEN 'L3' THEN province END AS name,
  CASE WHEN e IN ('L4', 'L5') OR e = 'L3' AND province IS NULL OR e IN ('L1', 'L2') AND commune IS NULL THEN 'invalid_location_hierarchy' END AS reason
FROM one JOIN two USING (c_custkey), (SELECT unnest(['L1', 'L2', 'L3', 'L4', 'L5']) AS e)""")
def planned_paths(spark, sf_dir):
    """For each customer an address of a masked commune and district in a known province, a masked province of a known district, and two that no path fits."""
    part = "array<struct<entity_id:string,role:string,unit:string,marker:string,chain:array<string>,anchors:array<string>>>"
    e = lambda *x: F.struct(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    none, r, d = F.array().cast("array<string>"), F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))), F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    rows = X.table(spark, sf_dir, "customer").join(X.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    masked = F.array(e("L1", "commune", "xã", "M", F.array(F.lit("district:D")), none), e("L2", "district", "Huyện", "D", none, r), e("L3", "province", "tỉnh", "P", none, d), e("L4", "commune", "phường", "Q", none, none), e("L5", "commune", "xã", "V", none, F.array(F.lit("x9")))).cast(part)
    return lookup.plan_paths(rows.select(F.col("c_custkey").alias("doc_id"), F.inline(masked)), geo.paths(_gazetteer(spark, sf_dir)))


@query("""WITH p AS (SELECT p_partkey, p_name, count(*) OVER () AS n FROM part), d AS (SELECT d.doc_id, length(coalesce(d.text, '')) + 1 AS at_, p.p_name AS name, replace(p.p_name, ' ', '  ') AS wide, replace(upper(p.p_name), ' ', '') AS tight FROM documents d JOIN p ON p.p_partkey = d.doc_id % p.n)
SELECT doc_id, CAST(at_ + 7 AS INTEGER) AS "start", CAST(at_ + 7 + length(wide) AS INTEGER) AS "end", wide AS surface, name FROM d
UNION ALL SELECT doc_id, CAST(at_ + 9 + length(wide) AS INTEGER), CAST(at_ + 9 + length(wide) + length(tight) AS INTEGER), tight, name FROM d""")
def known_names(spark, sf_dir):
    """Names of parts put into the documents: with more spaces and in capitals without any they are found, as part of a word they are not."""
    parts = X.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = parts.count()
    rows = X.documents(spark, sf_dir).withColumn("p_partkey", F.col("doc_id") % n).join(parts, "p_partkey")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nSold a "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(", "), F.replace(F.upper("p_name"), F.lit(" "), F.lit("")), F.lit(" and 2 "), F.col("p_name"), F.lit("s."))
    return lookup.find_names(rows.select("doc_id", text.alias("text")), parts.select(F.col("p_name").alias("name")))


# ---- documents end to end -----------------------------------------------------------------------------------------


@query()
def marker_reconstruction(spark, sf_dir):
    done, _, _ = markers.reconstruct(X.documents(spark, sf_dir))
    return done.select("doc_id", "replacements", "roundtrip_ok", F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query()
def ner_observations(spark, sf_dir):
    docs = X.documents(spark, sf_dir)
    found = ner.tag(docs, ner.rule_tagger({"PER": r"\b[A-Z][a-z]{9,}\b", "ORG": r"\b(?:Apache|Creative Commons)\b"}))
    return ner.observations(found, docs).select("doc_id", "label", "start", "end", "surface")


@query()
def court_roles(spark, sf_dir):
    m = X.mentions(spark, sf_dir).where("label in ('PER', 'ORG')")
    return roles.classify_mentions(m, X.documents(spark, sf_dir)).select("doc_id", "start", "label", "role")


@query()
def anonymized_documents(spark, sf_dir):
    m = X.mentions(spark, sf_dir).where("label in ('PER', 'ORG')")
    m = m.withColumn("surface", F.regexp_replace("surface", "[.,]$", "")).withColumn("end", F.col("start") + F.length("surface"))
    found = m.select("doc_id", F.col("entity_id").alias("cluster_id"), "label", "start", "end", "surface", F.lit(False).alias("preserve"))
    planned = anonymize.plan_documents(X.documents(spark, sf_dir), found)
    return planned.select("doc_id", "status", F.size("replacements").alias("replacements"), F.md5("anonymized_text").alias("text_md5"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations),
c AS (SELECT *, regexp_matches(word, '^[A-Z]') AS cap, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r, row_number() OVER (PARTITION BY conv_id, turn, regexp_matches(word, '^[A-Z]') ORDER BY i) AS rc FROM w),
u AS (SELECT DISTINCT text FROM conversations),
x AS (SELECT text, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM u),
y AS (SELECT *, i - row_number() OVER (PARTITION BY text, regexp_matches(word, '^[A-Z]') ORDER BY i) AS island, regexp_matches(word, '^[A-Z]') AS cap FROM x),
n AS (SELECT lower(string_agg(word, ' ' ORDER BY i)) AS name FROM y WHERE cap GROUP BY text, island)
SELECT trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, count(*) AS n FROM n GROUP BY 1""")
def vocabulary(spark, sf_dir):
    """Runs of capitalised words of conversations, as word and tag lists."""
    words = F.split("text", " ", -1)
    cap = F.transform(words, lambda w: w.rlike("^[A-Z]"))
    tags = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.when(~F.get(cap, i), "O").when((i > 0) & F.get(cap, i - 1), "I-PER").otherwise("B-PER"))
    rows = X.table(spark, sf_dir, "conversations").where("text is not null").select(words.alias("tokens"), tags.alias("ner_tags"))
    return ner.vocabulary(ner.decode_bio(rows), "PER").select("name", "n")


# ---- streams ------------------------------------------------------------------------------------------------------


STREAMS = 4  # that pull side by side, at most


def _collected(query_, spark, path):
    query_.awaitTermination()
    return spark.read.parquet(path)


@query("SELECT DISTINCT sha256(text) AS text_sha256 FROM documents WHERE length(trim(text)) > 0")
def stream_ingest_dedup(spark, sf_dir):
    from docloom.streaming import ingest

    at = new_folder(spark, "stream")
    source = ingest.documents(spark, f"{sf_dir}/documents.parque[t]", X.documents(spark, sf_dir).schema)
    run = ingest.ingest(ingest.fresh_texts(source), f"{at}/out", f"{at}/checkpoint")
    return _collected(run, spark, f"{at}/out").select("text_sha256")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= CASE lang WHEN 'en' THEN 60 WHEN 'fr' THEN 25 ELSE 1000000000 END")
def stream_ingest_capped(spark, sf_dir):
    """At most 60 English and 25 French documents of a stream; how many there are is state."""
    from docloom.streaming import ingest

    at = new_folder(spark, "stream")
    source = ingest.documents(spark, f"{sf_dir}/documents.parque[t]", X.documents(spark, sf_dir).schema)
    run = ingest.ingest_capped(source, f"{at}/out", f"{at}/checkpoint", {"en": 60, "fr": 25}, "lang")
    return _collected(run, spark, f"{at}/out").select("doc_id", "lang")


@query(f"""WITH r AS (SELECT doc_id, unnest(CASE WHEN n_chars < 1000 THEN ['short', lang] ELSE [lang] END) AS reason, {X.sql_hash("doc_id")} AS rank FROM documents),
p AS (SELECT * FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reason ORDER BY rank) <= 12) SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM p GROUP BY doc_id""")
def stream_pools(spark, sf_dir):
    """A pool of twelve documents of each reason, kept by a stream."""
    from docloom.streaming import ingest

    at = new_folder(spark, "stream")
    source = ingest.documents(spark, f"{sf_dir}/documents.parque[t]", X.documents(spark, sf_dir).schema)
    reasons = F.when(F.col("n_chars") < 1000, F.array(F.lit("short"), "lang")).otherwise(F.array("lang"))
    run = ingest.with_state_on_disk(spark, lambda: ingest.ingest(ingest.pool_changes(source, reasons, 12), f"{at}/out", f"{at}/checkpoint"))
    return ingest.pool_records(_collected(run, spark, f"{at}/out")).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row, md5(coalesce(text, '')) AS md5 FROM documents")
def stream_pull(spark, sf_dir):
    """Documents as lines, pulled a few hundred at a time by queries that are stopped once and go on; long tables by several side by side, each with a range of the rows."""
    from docloom.streaming import pull

    at = new_folder(spark, "pull")
    docs = X.documents(spark, sf_dir).select(F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("value"), "doc_id")
    docs.orderBy("doc_id").select("value").write.text(f"{at}/lines")
    files = pull.files(spark, f"{at}/lines")
    n = max(1, min(STREAMS, sum(x for _, x, _ in files) // 4000))
    with pull.plain_renames(spark, at):
        for most in (500, None):
            running = []
            try:
                for k in range(n):
                    rows = pull.lines(spark, files, f"{at}/progress/{k}.json", batch=400, most=most, share=(k, n))
                    out = rows.select("row", F.from_json("value", "doc_id long, text string").alias("d")).select("row", "d.doc_id", F.md5("d.text").alias("md5"))
                    running.append(out.writeStream.format("parquet").option("path", f"{at}/out/{k}").option("checkpointLocation", f"{at}/checkpoint/{k}").start())
                for query_ in running:
                    query_.processAllAvailable()
            finally:
                for query_ in running:
                    query_.stop()
    return reduce(DataFrame.union, (spark.read.schema("row long, doc_id long, md5 string").parquet(f"{at}/out/{k}") for k in range(n)))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """The windowed counts of a stream, here over the table as a batch; tests run the stream."""
    from docloom.streaming import ingest

    return ingest.windowed_counts(X.table(spark, sf_dir, "events")).select("window_start", "event_type", "n")




@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    from docloom.streaming import ingest

    return ingest.sessions(X.table(spark, sf_dir, "events"))


# ---- datasets and whole runs --------------------------------------------------------------------------------------


def _people(spark, sf_dir):
    return X.mentions(spark, sf_dir).select("doc_id", "entity_id", "start", "end", "surface", "label", F.substring("surface", 1, 1).alias("marker"))


def _labelled(keys: str) -> str:
    """Pairs of mentions that agree in ``keys``, with what pairs are ranked by."""
    return f"""{X.MENTIONS_SQL}, both_ AS (
  SELECT a.doc_id, a.label AS mention_label, a.entity_id AS entity_a, CAST(a.entity_id = b.entity_id AS INTEGER) AS label, a.label = b.label AS same_label, lower(a.surface) = lower(b.surface) AS same,
    abs(length(a.surface) - length(b.surface)) AS gap, abs(a."start" - b."start") AS far,
    CAST(a.doc_id AS VARCHAR) || ':' || substr(sha256(concat_ws(chr(31), a.doc_id, a."start", a."end", b."start", b."end")), 1, 20) AS pair_id
  FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND (a."start", a."end") < (b."start", b."end"){keys}
), pairs AS (
  SELECT *, CASE WHEN label = 1 THEN 'positive' WHEN same THEN 'same_label_surface' WHEN same_label THEN 'same_label' ELSE 'cross_label' END AS difficulty,
    CASE WHEN same THEN 0 WHEN same_label THEN 5 ELSE 6 END AS priority, CAST(same AS DOUBLE) AS token_jaccard, {X.sql_hash("pair_id")} AS hash FROM both_
)"""


@query(f"""WITH {_labelled("")}, pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_a ORDER BY same, -gap, far, hash) AS rank FROM pairs WHERE label = 1 QUALIFY rank <= 8),
wanted AS (SELECT doc_id, greatest(2, count(*)) AS n FROM pos GROUP BY doc_id), neg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, hash) AS rank FROM pairs WHERE label = 0),
kept AS (SELECT * FROM pos UNION ALL SELECT neg.* FROM neg LEFT JOIN wanted USING (doc_id) WHERE rank <= coalesce(n, 2))
SELECT doc_id, pair_id, label, difficulty, token_jaccard FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY label DESC, rank, pair_id) <= 128""")
def raw_pairs(spark, sf_dir):
    return datasets.raw_pairs(_people(spark, sf_dir), X.documents(spark, sf_dir)).select("doc_id", "pair_id", "label", "difficulty", "token_jaccard")


_NATURAL = f"""{_labelled(" AND a.label = b.label")}, n AS (SELECT doc_id, count_if(label = 1) AS p, count_if(label = 0) AS n FROM pairs GROUP BY doc_id),
quotas AS (SELECT doc_id, CAST(least(p, greatest(64, 128 - n)) AS BIGINT) AS positives, CAST(least(n, greatest(64, 128 - p)) AS BIGINT) AS negatives FROM n)"""


@query(f"""WITH {_NATURAL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY CASE WHEN label = 1 THEN 0 ELSE priority END, hash) AS rank FROM pairs)
SELECT doc_id, pair_id, label, difficulty, mention_label, token_jaccard FROM r JOIN quotas USING (doc_id) WHERE rank <= CASE WHEN label = 1 THEN positives ELSE negatives END""")
def natural_pairs(spark, sf_dir):
    made, _ = datasets.natural_pairs(_people(spark, sf_dir), X.documents(spark, sf_dir))
    return made.select("doc_id", "pair_id", "label", "difficulty", "mention_label", "token_jaccard")


@query(f"WITH {_NATURAL} SELECT doc_id, positives, negatives FROM quotas")
def natural_pair_quotas(spark, sf_dir):
    made, _ = datasets.natural_pairs(_people(spark, sf_dir), X.documents(spark, sf_dir))
    return made.groupBy("doc_id").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


@query()
def anonymize_batch(spark, sf_dir):
    tagger = ner.rule_tagger({"PER": r"\b[A-Z][a-z]{9,}\b", "ORG": r"\b(?:Apache|Creative Commons)\b"})
    out = pipelines.anonymize_batch(X.documents(spark, sf_dir), tagger)
    return out.select("doc_id", "status", F.size("replacements").alias("replacements"), F.md5("anonymized_text").alias("text_md5"), F.col("released_text").isNotNull().alias("released"))


@query()
def reconstruct_batch(spark, sf_dir):
    return pipelines.reconstruct_batch(X.documents(spark, sf_dir)).select("doc_id", "quality_score", "quality_tier", "eligible", "replacements", "roundtrip_ok")


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5 FROM documents")
def nfc_texts(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.md5(names.unicode_form(F.col("text"))).alias("nfc_md5"))


@query(f"""WITH {X.FEATURES_SQL}, c AS (SELECT doc_id, CASE WHEN numbered_marker > 0 THEN 'marker_number,' ELSE '' END || CASE WHEN procedural_code > 0 THEN 'marker_mail,' ELSE '' END || CASE WHEN n_chars < 1000 THEN 'short,' ELSE '' END AS c, n_chars % 3 = 0 AS sel FROM features)
SELECT doc_id, CASE WHEN sel THEN '' ELSE rtrim(c, ',') END AS categories FROM c""")
def challenge_categories(spark, sf_dir):
    reasons = F.when(F.col("n_chars") < 1000, F.array(F.lit("short"), F.lit("unwanted"))).otherwise(F.array().cast("array<string>"))
    made = curate.challenge_categories(F.coalesce("text", F.lit("")), reasons, F.col("n_chars") % 3 == 0, {"number": "[0-9]{6,}", "mail": "[A-Za-z0-9_.]+@[A-Za-z0-9.]+"}, ["short", "other"])
    return X.documents(spark, sf_dir).select("doc_id", F.array_join(made, ",").alias("categories"))
