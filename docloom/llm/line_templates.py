"""Line dedup by a log-template tree, in DataFrame operations only.

A line's words are taken apart at white space, and words with a digit become a wildcard. The tree has a fixed depth:
the number of words, then the first ``LEADING`` words, lead to a leaf. The words after these are cut into at most
``SEGMENTS`` runs. A line of a leaf takes the template of an earlier one if more than half of their runs are equal; the other
runs are the template's variable fields. Lines that are unlike all earlier ones begin templates of their own, so a leaf
holds as many as it needs.

Two lines agree in more than half of ``n`` runs exactly if they agree in all runs of one of the choices of ``n // 2 + 1`` of them.
So each choice, with what the line has there, is a key, of which a line has 56 at most. The earliest line of each key is found by one
aggregation, and each line points to the earliest of those of its keys, which is the earliest of all that are similar enough;
pointers are then followed to their ends. No two lines are compared, and no leaf is parsed in sequence, whatever it holds.

A template that recurs in ``MIN_DOCS`` documents or more is kept where it comes first, in the document of the smallest id, and
is dropped from all others. A document that would lose more than one part in ``MOST_PART`` is a version of another
as a whole rather than a text with boilerplate in it: it stays as it is, for near-dedup to judge.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Rounds, materialize

LEADING = 3
SEGMENTS = 8
RUNS = tuple(f"r{i}" for i in range(SEGMENTS))
#: What two to four documents share is a quotation or the copy of a document, which near-dedup judges by whole texts.
MIN_DOCS = 5
SHORT_WORDS = 5
#: Lines of few words ("Thank you.") recur by chance, so more documents are asked for.
SHORT_MIN_DOCS = 10
MOST_PART = 3
#: As many leaves, of eight bytes each, are broadcast at most; more are shuffled.
BROADCAST_LEAVES = 100_000
_OTHER_SPACE = r"[\t\x0B\f\r]"
#: A word with a digit in it, tried at beginnings of words only and without backtracking, so that long words cost no more.
_WITH_DIGIT = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def parsed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, total, pos, chars, words, leaf, seq, and the runs r0 to r7) of each line that has words.

    ``version`` is a hash of the text, ``leaf`` of the path to the leaf, ``seq`` of all words, and the runs are hashes, of nothing beyond
    those that there are. ``chars`` and ``total`` are the characters of the line and of the text, wildcards counted as such.
    """
    text = F.col(text_col).cast("string")
    # Splitting at a single space needs no pattern, so other white space becomes spaces first, where there is any.
    spaced = F.when(text.rlike(_OTHER_SPACE), F.regexp_replace(text, _OTHER_SPACE, " ")).otherwise(text)
    masked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), spaced.alias("t"))
    masked = masked.select("id", "version", F.when(F.col("t").rlike("[0-9]"), F.regexp_replace("t", _WITH_DIGIT, "<*>")).otherwise(F.col("t")).alias("t"))
    rows = masked.select("id", "version", F.length("t").alias("total"), F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    words = rows.where(F.trim("line") != "").select("id", "version", "total", "pos", F.length("line").alias("chars"), F.array_remove(F.split("line", " ", -1), "").alias("w"))
    words = words.withColumn("words", F.size("w"))
    after = f"greatest(words - {LEADING}, 0)"
    # A column for each run, without a lambda, which would be interpreted, and without a condition, so that words are taken apart once.
    cut = f"CAST({{i}} * {after} div greatest(least({SEGMENTS}, words - {LEADING}), 1) AS INT)"
    run = f"xxhash64(slice(w, {LEADING + 1} + {{a}}, {{b}} - {{a}}))"
    runs = [F.expr(run.format(a=cut.format(i=i), b=cut.format(i=i + 1))).alias(r) for i, r in enumerate(RUNS)]
    hashed = words.select("id", "version", "total", "pos", "chars", "words", F.xxhash64("words", F.slice("w", 1, LEADING)).alias("leaf"), *runs)
    return hashed.withColumn("seq", F.xxhash64("leaf", *RUNS))


def _templates(lines: DataFrame) -> DataFrame:
    """(seq, template): for each sequence of words that belongs to an earlier one's template, the first of that template."""
    # With one run or two, more than half are all, so such lines are alike only if they are equal.
    kinds = lines.where(F.col("words") > LEADING + 2).groupBy("leaf", "seq").agg(F.min(F.struct("id", "version", "pos")).alias("at"), F.first("words").alias("words"), *[F.first(r).alias(r) for r in RUNS])
    kinds = materialize(kinds.withColumn("n", F.least(F.lit(SEGMENTS), F.col("words") - LEADING)), "lines-kinds")
    keys = F.lit(None)
    for n in range(3, SEGMENTS + 1):
        choices = [F.xxhash64("leaf", F.lit(i), *[RUNS[r] for r in chosen]) for i, chosen in enumerate(combinations(range(n), n // 2 + 1))]
        keys = F.when(F.col("n") == n, F.array(*choices)).otherwise(keys)
    keyed = kinds.select("seq", F.struct("at", "seq").alias("own"), F.explode(keys).alias("key"))
    firsts = materialize(keyed.groupBy("key").agg(F.min("own").alias("first"), F.count("*").alias("many")).where("many > 1").select("key", "first"), "lines-firsts")
    near = keyed.select("key", "seq").join(firsts, "key").where("seq <> first.seq").groupBy("seq").agg(F.min("first").alias("best"))
    rounds = Rounds(lines.sparkSession, "lines-templates")
    found = rounds.store(near.select("seq", F.col("best.seq").alias("template")))
    while True:  # each round doubles how far a pointer reaches
        above = found.select(F.col("seq").alias("template"), F.col("template").alias("top"))
        jumped = rounds.store(found.join(above, "template", "left").select("seq", F.coalesce("top", "template").alias("template"), F.col("top").isNotNull().alias("moved")))
        found = jumped.select("seq", "template")
        if jumped.where("moved").isEmpty():
            return found


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, most_part: int | None = MOST_PART, short: tuple[int, int] = (SHORT_WORDS, SHORT_MIN_DOCS)
) -> DataFrame:
    """(id, version, dropped): for each document the numbers of its lines whose template came up in an earlier one.

    A template recurs if at least ``min_docs`` documents have it; one of fewer words than ``short`` says first, if as many as it says next have it.
    Documents that would lose over one part of their characters in ``most_part`` are left out; null leaves out none.
    Only lines of leaves with so many lines are looked at further.
    """
    parsed = materialize(parsed_lines(docs, id_col, text_col), "lines-parsed")
    leaves = materialize(parsed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "lines-leaves")
    if leaves.count() <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    else:
        leaves = leaves.hint("shuffle_hash")
    lines = materialize(parsed.join(leaves, "leaf", "left_semi"), "lines-some")
    placed = lines.join(_templates(lines), "seq", "left").select("id", "version", "total", "pos", "chars", "words", F.coalesce("template", "seq").alias("template"))
    held = placed.groupBy("template", "id", "version").agg(F.max("total").alias("total"), F.max("words").alias("words"), F.collect_set(F.struct("pos", "chars")).alias("lines"))
    held = materialize(held, "lines-held")
    needed = F.when(F.col("words") < short[0], max(short[1], min_docs)).otherwise(min_docs)
    found = held.groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("id", "version")).alias("first"), F.max("words").alias("words")).where(F.col("docs") >= needed)
    found = materialize(found.select("template", "first"), "lines-found")
    later = held.join(found, "template").where(~F.struct("id", "version").eqNullSafe(F.col("first")))
    gone = later.groupBy("id", "version").agg(F.max("total").alias("total"), F.flatten(F.collect_list("lines")).alias("lines"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    if most_part is not None:
        gone = gone.where(chars * most_part <= F.col("total"))
    return gone.select("id", "version", F.col("lines.pos").alias("dropped"))


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    most_part: int | None = MOST_PART,
    count_col: str = "lines_dropped",
    short: tuple[int, int] = (SHORT_WORDS, SHORT_MIN_DOCS),
) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and how many as ``count_col``, which replaces a column of that name.

    Rows, and lines without words, stay. A null text stays null. Rows that repeat an id and its text are one document,
    and so stay alike; rows without id come before all others. A line may be of any length. An empty table stays empty.
    """
    found = materialize(recurring_lines(docs, id_col, text_col, min_docs, most_part, short), "lines-dropped")
    text = F.col(f"d.`{text_col}`").cast("string")
    # Hashed rather than merged, so that texts are not sorted.
    joined = docs.alias("d").join(found.hint("shuffle_hash").alias("f"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("f.id")) & (F.xxhash64(text) == F.col("f.version")), "left")
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("f.dropped"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    new = F.when(F.col("f.dropped").isNull(), text).otherwise(rest)
    columns = [new.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c != count_col]
    return joined.select(*columns, F.coalesce(F.size("f.dropped"), F.lit(0)).alias(count_col))


_CHOICES = ", ".join(f"({n}, {i}, {[r + 1 for r in chosen]})" for n in range(3, SEGMENTS + 1) for i, chosen in enumerate(combinations(range(n), n // 2 + 1)))

#: For ``most_part=None``.
ORACLE_SQL = f"""
WITH RECURSIVE choices(m, i, chosen) AS (
  SELECT * FROM (VALUES {_CHOICES}) AS t(m, i, chosen)
), lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), words AS (
  SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS v,
    length(regexp_replace(line, '[^ \\t\\x0B\\f\\r0-9]*[0-9][^ \\t\\x0B\\f\\r]*', '<*>', 'g')) AS chars
  FROM lines
), parsed AS (
  SELECT doc_id, pos, chars, list_transform(v, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w, len(v) AS n, least(8, len(v) - 3) AS m FROM words WHERE len(v) > 0
), kinds AS (
  SELECT w, n, m, w[1:3] AS lead, min({{'d': doc_id, 'p': pos}}) AS at_,
    list_transform(range(m), lambda i: w[4 + (i * (n - 3)) // m : 3 + ((i + 1) * (n - 3)) // m]) AS runs
  FROM parsed GROUP BY w, n, m
), keyed AS (
  SELECT k.n, k.lead, k.at_, c.i, list_transform(c.chosen, lambda r: k.runs[r]) AS key FROM kinds k JOIN choices c ON k.m = c.m
), firsts AS (
  SELECT n, lead, i, key, min(at_) AS first_at FROM keyed GROUP BY n, lead, i, key HAVING count(*) > 1
), parents AS (
  SELECT k.at_, min(f.first_at) AS parent
  FROM keyed k JOIN firsts f ON k.n = f.n AND k.lead = f.lead AND k.i = f.i AND k.key = f.key
  WHERE f.first_at < k.at_ GROUP BY k.at_
), roots AS (
  SELECT at_, at_ AS root FROM kinds WHERE at_ NOT IN (SELECT at_ FROM parents)
  UNION ALL
  SELECT p.at_, r.root FROM parents p JOIN roots r ON p.parent = r.at_
), placed AS (
  SELECT p.doc_id, p.pos, p.n, p.chars, r.root FROM parsed p JOIN kinds k ON p.w = k.w JOIN roots r ON k.at_ = r.at_
), recurring AS (
  SELECT root, min(doc_id) AS first_doc FROM placed GROUP BY root
  HAVING count(DISTINCT doc_id) >= CASE WHEN max(n) < 5 THEN 10 ELSE 5 END
), dropped AS (
  SELECT p.doc_id, p.pos FROM placed p JOIN recurring r ON p.root = r.root WHERE p.doc_id <> r.first_doc
), cut AS (
  SELECT doc_id, count(*) AS many FROM dropped GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.pos = d.pos WHERE d.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(c.many, 0) AS INTEGER) AS lines_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN cut c ON d.doc_id = c.doc_id
"""
