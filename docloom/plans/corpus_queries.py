"""Queries over documents: selection, splits, features, quality, spacing models, rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.functions import text as T
from docloom.operators import curate, ocr, quality, spans, split
from docloom.plans import fixtures as X
from docloom.sources import atomic
from docloom.sources.steps import new_folder

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_SPLIT = "CASE WHEN u < 1844674407370955162 THEN 'test' WHEN u < 3689348814741910324 THEN 'validation' ELSE 'train' END"


@query(f"WITH d AS (SELECT doc_id, lang, {X.sql_u64('doc_id')} AS u FROM documents WHERE length(trim(text)) > 0) SELECT lang, {_SPLIT} AS split, count(*) AS n FROM d GROUP BY 1, 2")
def split_hash_counts(spark, sf_dir):
    return split.hash_split(X.documents(spark, sf_dir)).groupBy("lang", "split").agg(F.count("*").alias("n"))


@query(f"WITH d AS (SELECT doc_id, {X.sql_u64('doc_id')} AS u FROM documents WHERE length(trim(text)) > 0) SELECT doc_id, {_SPLIT} AS split FROM d")
def split_hash(spark, sf_dir):
    return split.hash_split(X.documents(spark, sf_dir)).select("doc_id", "split")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_source_text(spark, sf_dir):
    return curate.dedup_texts(X.documents(spark, sf_dir)).select("doc_id")


@query(f"""WITH r AS (SELECT doc_id, lang, source, substr({X.sql_hash('doc_id')}, 1, 32) AS stable_rank FROM documents WHERE length(trim(text)) >= 500)
SELECT doc_id, lang, source, stable_rank FROM r QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY stable_rank, doc_id) <= 5""")
def curate_topk_per_stratum(spark, sf_dir):
    docs = X.documents(spark, sf_dir).where(curate.long_enough(F.col("text"), 500)).drop("text", "n_chars")
    return curate.top_k_per_stratum(docs, [F.col("lang"), F.col("source")], 5)


@query(f"""WITH r AS (SELECT doc_id, lang, substr({X.sql_hash('doc_id')}, 1, 32) AS stable_rank FROM documents), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY stable_rank, doc_id) <= 100)
SELECT doc_id, lang FROM k ORDER BY stable_rank, doc_id LIMIT 150""")
def curate_global_cap(spark, sf_dir):
    docs = X.documents(spark, sf_dir).select("doc_id", "lang")
    return curate.top_k_per_stratum(docs, [F.col("lang")], 100, total=150).select("doc_id", "lang")


@query(f"WITH {X.FEATURES_SQL} SELECT doc_id, {', '.join(rules.EN_FEATURES)}, {X.RELEVANT_SQL} AS relevant, {X.PRIMARY_SQL} AS primary_challenge FROM features")
def feature_profile(spark, sf_dir):
    return X.features(spark, sf_dir).select("doc_id", *rules.EN_FEATURES, "relevant", "primary_challenge")


@query(f"WITH {X.FEATURES_SQL} SELECT {X.PRIMARY_SQL} AS primary_challenge, lang, count(*) AS n FROM features GROUP BY 1, 2")
def challenge_counts(spark, sf_dir):
    return X.features(spark, sf_dir).groupBy("primary_challenge", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {X.FEATURES_SQL} SELECT doc_id, CAST(4 * procedural_code + 4 * dotted_initial + 3 * address_marker + least(person_context, 8) AS INTEGER) AS interest FROM features WHERE {X.RELEVANT_SQL} = 1 AND length(text) <= 50000")
def relevance_filter(spark, sf_dir):
    f = X.features(spark, sf_dir).where((F.col("relevant") == 1) & curate.long_enough(F.col("text"), 0, 50_000))
    score = curate.interest_score(*[F.col(c) for c in ("procedural_code", "dotted_initial", "address_marker", "person_context")])
    return f.select("doc_id", score.cast("int").alias("interest"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-01-01'")
def future_date_filter(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders")
    return orders.where(curate.in_future(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1997-01-01").cast("date"))).select("o_orderkey")


_REASONS = [(c, f"'{c}'") for c in ("numbered_marker", "procedural_code", "person_context", "full_name_marker")]


@query(f"""WITH {X.FEATURES_SQL}, r AS ({' UNION ALL '.join(f"SELECT doc_id, {q} AS reason FROM features WHERE {c} > 0" for c, q in _REASONS)}),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY reason ORDER BY {X.sql_hash('reason', 'doc_id')}, doc_id) <= 20)
SELECT doc_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM k GROUP BY doc_id""")
def challenge_pool(spark, sf_dir):
    reasons = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c, _ in _REASONS]))
    pool = curate.challenge_pool(X.features(spark, sf_dir), reasons, 20)
    return pool.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {X.FEATURES_SQL}, r AS ({' UNION ALL '.join(f"SELECT doc_id, {q} AS category FROM features WHERE {c} > 0" for c, q in _REASONS)}),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY category ORDER BY doc_id) <= 15)
SELECT doc_id, string_agg(category, ',' ORDER BY category) AS categories FROM k GROUP BY doc_id""")
def first_per_category(spark, sf_dir):
    categories = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c, _ in _REASONS]))
    made = curate.first_per_category(X.features(spark, sf_dir), categories, 15)
    return made.select("doc_id", F.array_join("categories", ",").alias("categories"))


@query(f"""WITH {X.FEATURES_SQL}, k AS (SELECT doc_id, lang || '|' || source AS stratum, {X.PRIMARY_SQL} AS family FROM features),
h AS (SELECT *, {X.sql_hash('stratum', 'doc_id')} AS place FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY place, doc_id) AS rk, count(*) OVER (PARTITION BY stratum) AS n FROM h),
q AS (SELECT *, CASE WHEN n >= 10 THEN greatest(CAST(floor(n * 0.1::DECIMAL(10,9)) AS BIGINT), 1) ELSE CAST(floor(n * 0.1::DECIMAL(10,9)) AS BIGINT) END AS quota FROM r),
s AS (SELECT *, CASE WHEN rk <= quota THEN 'validation' WHEN rk <= 2 * quota THEN 'test' ELSE 'train' END AS split FROM q),
c AS (SELECT family, count(*) AS n, count_if(split = 'validation') AS v, count_if(split = 'test') AS t, count_if(split = 'train') AS tr FROM s GROUP BY family),
sp AS (SELECT s.doc_id, c.v, c.t, row_number() OVER (PARTITION BY s.family ORDER BY {X.sql_hash("'challenge'", 's.family', 's.doc_id')}, s.doc_id) AS turn
  FROM s JOIN c USING (family) WHERE s.split = 'train' AND c.n >= 3 AND (c.v = 0 OR c.t = 0)),
mv AS (SELECT doc_id, CASE WHEN v = 0 AND turn = 1 THEN 'validation' WHEN v = 0 AND t = 0 AND turn = 2 THEN 'test' WHEN v > 0 AND t = 0 AND turn = 1 THEN 'test' END AS moved FROM sp)
SELECT s.doc_id, coalesce(mv.moved, s.split) AS split FROM s LEFT JOIN mv USING (doc_id)""")
def split_stratified(spark, sf_dir):
    return split.stratified_split(X.features(spark, sf_dir), ["lang", "source"], "primary_challenge")


@query("""SELECT 'all' AS scope, '' AS value, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
UNION ALL SELECT 'lang', lang, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY source""")
def corpus_report(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    g = d.groupingSets([[], [F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source")).agg(F.grouping_id().alias("g"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "lang").otherwise("source")
    return g.select(scope.alias("scope"), F.coalesce("lang", "source", F.lit("")).alias("value"), "docs", "chars")


_COUNTERS = {
    "documents": "count(*)", "without_text": "count_if(text IS NULL)", "blank": "count_if(length(trim(text)) = 0)", "short": "count_if(n_chars < 500)", "long": "count_if(n_chars > 50000)",
    "chars": "coalesce(sum(n_chars), 0)", "without_lang": "count_if(lang IS NULL)", "english": "count_if(lang = 'en')", "french": "count_if(lang = 'fr')", "german": "count_if(lang = 'de')",
    "lines": "coalesce(sum(length(text) - length(replace(text, '\n', ''))), 0)", "longest": "coalesce(max(n_chars), 0)", "with_digits": "count_if(regexp_like(text, '[0-9]'))", "with_mail": "count_if(text LIKE '%@%')",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS counter, CAST({c.replace('regexp_like', 'regexp_matches')} AS BIGINT) AS n FROM documents" for n, c in _COUNTERS.items()).replace("'\n'", "chr(10)"))
def observed_counters(spark, sf_dir):
    """Fourteen counters of a run, observed in the one pass that writes the documents."""
    seen = atomic.observed(X.documents(spark, sf_dir), new_folder(spark, "observed"), {n: F.expr(c).cast("long") for n, c in _COUNTERS.items()})
    return spark.createDataFrame(list(seen.items()), "counter string, n long")


# ---- spacing models -----------------------------------------------------------------------------------------------

_NORM = "lower(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')))"
_GRAMS = f"""t AS (SELECT doc_id, chr(2) || chr(2) || {_NORM} || chr(3) AS p FROM documents WHERE length({_NORM}) > 0),
grams AS (SELECT doc_id, substr(p, i, 3) AS gram, substr(p, i, 2) AS context FROM (SELECT doc_id, p, unnest(range(1, length(p) - 1)) AS i FROM t))"""


@query(f"WITH {_GRAMS} SELECT gram AS key, count(*) AS n FROM grams GROUP BY 1")
def trigram_counts(spark, sf_dir):
    return ocr.train(X.documents(spark, sf_dir))["grams"]


@query(f"WITH {_GRAMS} SELECT context AS key, count(*) AS n FROM grams GROUP BY 1")
def context_counts(spark, sf_dir):
    return ocr.train(X.documents(spark, sf_dir))["contexts"]


@query(f"SELECT key, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_NORM}, '\\p{{L}}+')) AS key FROM documents) GROUP BY 1 HAVING count(*) >= 3")
def candidate_words(spark, sf_dir):
    return ocr.train(X.documents(spark, sf_dir))["words"]


@query(f"""WITH {_GRAMS}, g AS (SELECT gram, count(*) AS n FROM grams GROUP BY 1), c AS (SELECT context, count(*) AS n FROM grams GROUP BY 1),
a AS (SELECT count(DISTINCT ch) + 1 AS size FROM (SELECT unnest(string_split({_NORM}, '')) AS ch FROM documents) WHERE ch <> '')
SELECT doc_id, round(sum(ln((g.n + 0.1::DOUBLE) / (c.n + 0.1::DOUBLE * greatest(16, a.size)))) / count(*), 6) AS mean_log_probability
FROM grams JOIN g USING (gram) JOIN c USING (context) CROSS JOIN a GROUP BY doc_id""")
def doc_mean_logprob(spark, sf_dir):
    docs = X.documents(spark, sf_dir)
    made = ocr.mean_log_probability(docs, ocr.train(docs))
    return made.select("doc_id", F.round("mean_log_probability", 6).alias("mean_log_probability"))


_ALIKE = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}\\x{ad}]', '', 'g'), '[\\t\\x0b\\f\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')"


@query(f"SELECT doc_id, CAST(length({_ALIKE}) AS INTEGER) AS chars, CAST(length({_ALIKE}) AS INTEGER) AS mapped FROM documents")
def ocr_normalized(spark, sf_dir):
    made = ocr.normalize_documents(X.documents(spark, sf_dir))
    return made.select("doc_id", F.length("text").alias("chars"), F.size("source_starts").alias("mapped"))


# ---- quality ------------------------------------------------------------------------------------------------------


def _audit(spark, sf_dir):
    """Features as findings, so that quality has something to weigh."""
    f = X.features(spark, sf_dir).join(X.table(spark, sf_dir, "labels"), "doc_id", "left")
    many = lambda c, r: F.array_repeat(F.lit(r), F.least(F.col(c), F.lit(5)))
    return f.select(
        "doc_id",
        "lang",
        (F.col("numbered_marker") + F.col("procedural_code") + F.col("full_name_marker")).alias("replacements"),
        (F.coalesce("toxic", F.lit(0)) != 1).alias("roundtrip_verified"),
        F.concat(many("person_context", "fragmented_initial"), many("numbered_marker", "numeral_or_alias"), F.when(F.col("quality") == 0, F.array(F.lit("ambiguous_identity"))).otherwise(F.array().cast("array<string>"))).alias("review_reasons"),
        many("alias_language", "some_other_reason").alias("entity_reasons"),
        F.when(F.length("text") < 100, 1).otherwise(0).alias("overlaps"),
    )


_PENALTY = " ".join(f"WHEN '{r}' THEN {u}" for r, u in rules.PENALTIES.items())
_HARD = ", ".join(f"'{r}'" for r in rules.HARD_FAIL)
_QUALITY = f"""{X.FEATURES_SQL}, f AS (SELECT features.*, quality, toxic FROM features LEFT JOIN labels USING (doc_id)),
reasons AS (
  SELECT doc_id, 'fragmented_initial' AS reason, least(person_context, 5) AS n FROM f WHERE person_context > 0
  UNION ALL SELECT doc_id, 'numeral_or_alias', least(numbered_marker, 5) FROM f WHERE numbered_marker > 0
  UNION ALL SELECT doc_id, 'ambiguous_identity', 1 FROM f WHERE quality = 0
  UNION ALL SELECT doc_id, 'some_other_reason', least(alias_language, 5) FROM f WHERE alias_language > 0
  UNION ALL SELECT doc_id, 'roundtrip_failed', 1 FROM f WHERE toxic = 1
  UNION ALL SELECT doc_id, 'overlapping_replacement_spans', 1 FROM f WHERE length(text) < 100
), costed AS (
  SELECT doc_id, reason, n, least((CASE reason {_PENALTY} ELSE 10 END) * least(n, 3), (CASE reason {_PENALTY} ELSE 10 END) * 2) AS cost, reason IN ({_HARD}) AS hard FROM reasons
  UNION ALL SELECT doc_id, 'insufficient_replacements', 1, 20, false FROM f WHERE numbered_marker + procedural_code + full_name_marker < 1
), per AS (SELECT doc_id, sum(cost) AS cost, bool_or(hard) AS hard, string_agg(reason, ',' ORDER BY reason) AS reasons FROM costed GROUP BY doc_id),
scored AS (
  SELECT f.doc_id, f.lang, CAST(greatest(0, 100 - coalesce(cost, 0)) AS INTEGER) AS quality_score, coalesce(reasons, '') AS reasons,
    coalesce(toxic, 0) <> 1 AND numbered_marker + procedural_code + full_name_marker >= 1 AND NOT coalesce(hard, false) AS eligible
  FROM f LEFT JOIN per USING (doc_id)
), tiered AS (SELECT *, CASE WHEN eligible AND quality_score >= 85 THEN 'clean' WHEN quality_score >= 60 THEN 'review' ELSE 'reject' END AS quality_tier FROM scored)"""


def _scored(spark, sf_dir):
    audit = _audit(spark, sf_dir)
    return quality.score(audit, quality.reasons_of(audit)).join(audit.select("doc_id", "lang"), "doc_id")


@query(f"WITH {_QUALITY} SELECT doc_id, quality_score, quality_tier, eligible, reasons FROM tiered")
def quality_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "quality_score", "quality_tier", "eligible", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_QUALITY}, s AS (SELECT *, CAST(eligible AND quality_score >= 85 AND reasons = '' AS INTEGER) AS sel FROM tiered)
SELECT 'all' AS scope, '' AS value, count(*) AS "rows", CAST(sum(sel) AS BIGINT) AS selected FROM s
UNION ALL SELECT 'quality_tier', quality_tier, count(*), CAST(sum(sel) AS BIGINT) FROM s GROUP BY quality_tier UNION ALL SELECT 'lang', lang, count(*), CAST(sum(sel) AS BIGINT) FROM s GROUP BY lang""")
def quality_report(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return quality.report(scored, ["lang"], quality.selected(scored))


@query(f"WITH {_QUALITY} SELECT reason, count(*) AS documents, CAST(sum(n) AS BIGINT) AS n FROM reasons GROUP BY reason")
def quality_reason_totals(spark, sf_dir):
    return quality.reason_totals(quality.reasons_of(_audit(spark, sf_dir)))


@query(f"WITH {_QUALITY} SELECT doc_id FROM tiered WHERE eligible AND quality_score >= 85 AND reasons = ''")
def quality_selected(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return scored.where(quality.selected(scored)).select("doc_id")


@query("""WITH h AS (SELECT doc_id, text, lang FROM documents WHERE length(text) >= 200)
SELECT doc_id FROM h QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def first_retained(spark, sf_dir):
    docs = X.documents(spark, sf_dir)
    return curate.first_retained(docs, F.length("text") < 200, order_col="doc_id").select("doc_id")


@query(f"""WITH RECURSIVE {X.FEATURES_SQL}, o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, lang, {X.PRIMARY_SQL} AS family FROM features), s AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, NULL::VARCHAR AS category, false AS accepted, []::VARCHAR[] AS taken, 0 AS addresses
  UNION ALL SELECT k, doc_id, lang, ok, CASE WHEN ok THEN list_append(taken, lang) ELSE taken END, addresses + CASE WHEN ok AND family = 'address_marker' THEN 1 ELSE 0 END FROM (
    SELECT o.*, s.taken, s.addresses, len(s.taken) < 200 AND len(list_filter(s.taken, lambda x: x = o.lang)) < 70 AND (o.family <> 'address_marker' OR s.addresses < 120) AS ok FROM s JOIN o ON o.k = s.k + 1)
) SELECT doc_id, category, accepted FROM s WHERE k > 0""")
def diversity_caps(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    family = curate.primary_challenge(rules.EN_FEATURES, lambda c: text.rlike(rules.EN_FEATURES[c]))  # nothing is counted, as one of a family tells
    f = X.documents(spark, sf_dir).select("doc_id", F.col("doc_id").alias("position"), F.col("lang").alias("category"), family.alias("primary_challenge"))
    return curate.diversity_caps(f, 200).select("doc_id", "category", "accepted")


# ---- joins and sets -----------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_label' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_missing(spark, sf_dir):
    labels = X.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("_l"))
    return X.documents(spark, sf_dir).join(labels, "doc_id", "left").select("doc_id", F.when(F.col("_l").isNull(), "missing_label").alias("reason"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti_join(spark, sf_dir):
    return curate.not_seen(X.documents(spark, sf_dir), X.table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""WITH a AS (SELECT doc_id, lang FROM documents WHERE n_chars > 3000), b AS (SELECT doc_id, lang FROM documents WHERE lang = 'en')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    a, b = d.where("n_chars > 3000").select("doc_id", "lang"), d.where("lang = 'en'").select("doc_id", "lang")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT doc_id, sha256(text) AS source_sha256 FROM documents WHERE text IS NOT NULL")
def text_hashes(spark, sf_dir):
    return X.documents(spark, sf_dir).where("text is not null").select("doc_id", F.sha2("text", 256).alias("source_sha256"))


@query(f"SELECT doc_id, CAST({X.sql_u64('doc_id')} % 97 AS INTEGER) AS slot FROM documents")
def stable_slots(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", T.stable_slot(97, "42", F.col("doc_id")).alias("slot"))


# ---- rewriting ----------------------------------------------------------------------------------------------------


def _edits(spark, sf_dir):
    m = X.mentions(spark, sf_dir)
    return m.select("doc_id", "start", "end", F.col("surface").alias("original"), F.concat(F.lit("["), "label", F.lit("]")).alias("replacement"))


@query(f"""WITH {X.MENTIONS_SQL} SELECT doc_id, md5(string_agg(CASE WHEN label IS NULL THEN surface ELSE '[' || label || ']' END, ' ' ORDER BY word_no)) AS masked_md5, CAST(count(label) AS INTEGER) AS edits FROM placed_ GROUP BY doc_id""")
def mask_spans(spark, sf_dir):
    """Newlines count as spaces here, as SQL puts words together again."""
    docs = X.documents(spark, sf_dir).withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\n", " "))
    done = spans.rewrite(docs, _edits(spark, sf_dir))
    return done.select("doc_id", F.md5("rewritten").alias("masked_md5"), F.size("edits").alias("edits"))


@query(f"WITH {X.MENTIONS_SQL} SELECT true AS roundtrip_ok, count(*) AS n FROM documents WHERE text IS NOT NULL")
def roundtrip_counts(spark, sf_dir):
    done = spans.rewrite(X.documents(spark, sf_dir).where("text is not null"), _edits(spark, sf_dir))
    return done.groupBy("roundtrip_ok").agg(F.count("*").alias("n"))


@query(f"""WITH {X.MENTIONS_SQL}, e AS (SELECT doc_id, "start", length(label) + 2 AS new_, length(surface) AS old_ FROM mentions)
SELECT doc_id, "start", CAST("start" + coalesce(sum(new_ - old_) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS target_start FROM e""")
def target_offsets(spark, sf_dir):
    return spans.with_target_offsets(_edits(spark, sf_dir)).select("doc_id", "start", "target_start")


@query("SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g'))) AS INTEGER) AS chars FROM pages")
def page_texts(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", F.length(T.text_only(F.col("html"))).alias("chars"))


@query("SELECT role, CAST(sum(len(regexp_extract_all(text, '[0-9]{6,}'))) AS BIGINT) AS numbers, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9_.]+@[A-Za-z0-9.]+'))) AS BIGINT) AS addresses, count(*) AS turns FROM conversations GROUP BY role")
def conversation_features(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p))).cast("long")
    return c.groupBy("role").agg(count("[0-9]{6,}").alias("numbers"), count("[A-Za-z0-9_.]+@[A-Za-z0-9.]+").alias("addresses"), F.count("*").alias("turns"))


@query("SELECT l.toxic, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def confusion_cells(spark, sf_dir):
    j = X.table(spark, sf_dir, "labels").join(X.documents(spark, sf_dir), "doc_id")
    return j.groupBy("toxic", (F.col("n_chars") > 2000).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


