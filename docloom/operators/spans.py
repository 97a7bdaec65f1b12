"""Spans: finding them with offsets, checking, relating, rewriting and translating them. Offsets count code points, [start, end)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.sources.steps import small_batches


def find_spans(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text", flags: int = 0) -> DataFrame:
    """(id, label, start, end, surface) of all matches of each pattern: those of its group 1, if it has one.

    Spark's own functions give matches without offsets in code points, hence the Arrow stage. It streams batch by batch.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {label: re.compile(p, flags) for label, p in patterns.items()}
        for batch in batches:
            rows, labels, starts, ends, surfaces = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                for label, pattern in compiled.items():
                    group = 1 if pattern.groups else 0
                    for m in pattern.finditer(text):
                        if m.start(group) < m.end(group):
                            rows.append(i)
                            labels.append(label)
                            starts.append(m.start(group))
                            ends.append(m.end(group))
                            surfaces.append(m.group(group))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(labels, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(surfaces, pa.string())],
                ["id", "label", "start", "end", "surface"],
            )

    small_batches()
    return frame.mapInArrow(run, f"id {kind}, label string, start int, end int, surface string").withColumnRenamed("id", id_col)


def word_mentions(docs: DataFrame, kinds: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, label, start, end, surface, word_no): words that match a pattern, labelled by the first that does.

    Words are what single spaces and newlines separate. The patterns become one, tried where words begin, so that a text is read
    once whatever it holds. Null and empty texts have no mentions.
    """
    frame = docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    types = dict(frame.dtypes)
    whole = re.compile(r"(?<![^ \n])(?:" + "|".join(f"({_uncaptured(p)})" for _, p in kinds) + r")(?![^ \n])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, starts, ends, surfaces, numbers = [], [], [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                text = text.as_py()
                number = at = 0
                for m in whole.finditer(text):
                    number += text.count(" ", at, m.start()) + text.count("\n", at, m.start())
                    at = m.start()
                    rows.append(i)
                    labels.append(kinds[m.lastindex - 1][0])
                    starts.append(at)
                    ends.append(m.end())
                    surfaces.append(m.group())
                    numbers.append(number)
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("_id", *keep)]
            made = [pa.array(x, pa.int32()) if x is not labels and x is not surfaces else pa.array(x, pa.string()) for x in (labels, starts, ends, surfaces, numbers)]
            yield pa.RecordBatch.from_arrays([*taken, *made], ["_id", *keep, "label", "start", "end", "surface", "word_no"])

    small_batches()
    columns = ", ".join(f"`{c}` {types[c]}" for c in ("_id", *keep))
    return frame.mapInArrow(run, f"{columns}, label string, start int, end int, surface string, word_no int").withColumnRenamed("_id", id_col)


def _uncaptured(pattern: str) -> str:
    """A whole-word pattern without its anchors, and with groups that do not capture."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern.removeprefix("^").removesuffix("$"))


def valid_span(text: Column, start: Column, end: Column, surface: Column) -> Column:
    """In bounds, and the text there is the surface; false rather than null."""
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == surface), F.lit(False))


def best_per_span(mentions: DataFrame, score_col: str = "score", id_col: str = "doc_id") -> DataFrame:
    """Of mentions with the same span and label that of the highest score."""
    rank = F.row_number().over(Window.partitionBy(id_col, "start", "end", "label").orderBy(F.col(score_col).desc_nulls_last()))
    return mentions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def numbered(mentions: DataFrame, id_col: str = "doc_id", prefix: str = "M", width: int = 4) -> DataFrame:
    """Add ``mention_id``, numbered in order of position within a document."""
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("start", "end", "label"))
    return mentions.withColumn("mention_id", F.concat(F.lit(prefix), F.lpad(nth.cast("string"), width, "0")))


def overlapping(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``overlaps``: whether a mention begins before an earlier one has ended, or one begins before it ends.

    A running maximum of ends and a running minimum of starts, so a document costs a sort and not all its pairs.
    """
    by = Window.partitionBy(id_col).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.lead("start").over(by)
    return mentions.withColumn("overlaps", F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(next_ < F.col("end"), F.lit(False)))


def contained_in(inner: DataFrame, outer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(inner.*, outer_start, outer_end, outer_label) for each span of ``outer`` of the same document that covers one of ``inner``."""
    wide = outer.select(F.col(id_col).alias("_id"), F.col("start").alias("outer_start"), F.col("end").alias("outer_end"), F.col("label").alias("outer_label"))
    return inner.join(wide, (inner[id_col] == wide._id) & (wide.outer_start <= inner.start) & (wide.outer_end >= inner.end)).drop("_id")


def longest_outer(inner: DataFrame, outer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each of ``inner`` that lies strictly within spans of ``outer``, with the longest of these."""
    found = contained_in(inner, outer, id_col).where(F.col("outer_end") - F.col("outer_start") > F.col("end") - F.col("start"))
    rank = F.row_number().over(Window.partitionBy(id_col, "start", "end", "label").orderBy((F.col("outer_end") - F.col("outer_start")).desc(), "outer_start", "outer_label"))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def without_overlap(mentions: DataFrame, taken: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mentions that no span of ``taken`` of their document overlaps."""
    other = taken.select(F.col(id_col).alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return mentions.join(other, (mentions[id_col] == other._id) & (other._start < mentions.end) & (other._end > mentions.start), "left_anti")


def spans_in_parts(spans: DataFrame, parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans with the part (part_no, start, end) that holds them and offsets in it; a span that crosses parts has a null ``part_no``."""
    p = parts.select(F.col(id_col).alias("_id"), "part_no", F.col("start").alias("_start"), F.col("end").alias("_end"))
    joined = spans.join(p, (spans[id_col] == p._id) & (p._start <= spans.start) & (p._end >= spans.end), "left")
    return joined.withColumns({"part_start": F.col("start") - F.col("_start"), "part_end": F.col("end") - F.col("_start")}).drop("_id", "_start", "_end")


def sane_edits(text: Column, edits: Column) -> Column:
    """Whether edits (structs of start, end, original, replacement), sorted by start, are valid and apart."""
    right = F.forall(edits, lambda e: valid_span(text, e["start"], e["end"], e["original"]))
    apart = F.forall(F.sequence(F.lit(1), F.size(edits)), lambda i: F.coalesce(F.get(edits, i)["start"] >= F.get(edits, i - 1)["end"], F.lit(True)))
    return F.when(F.size(edits) == 0, True).otherwise(right & apart)


def apply_edits(text: Column, edits: Column, strict: bool = True) -> Column:
    """The text with edits made, from the right so that offsets hold. Unsound edits raise, or give null if not ``strict``."""
    ordered = F.array_sort(edits)
    done = F.aggregate(F.reverse(ordered), text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["replacement"], F.substring(t, e["end"] + 1, F.length(t))))
    broken = F.raise_error(F.lit("edits overlap or do not match their text")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.coalesce(F.size(edits), F.lit(0)) == 0, text).when(sane_edits(text, ordered), done).otherwise(broken)


def with_target_offsets(edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add target_start and target_end: where each replacement lies in the rewritten text, by a running sum of length changes."""
    delta = F.length("replacement") - F.length("original")
    before = F.coalesce(F.sum(delta).over(Window.partitionBy(id_col).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return edits.withColumn("target_start", (F.col("start") + before).cast("int")).withColumn("target_end", F.col("target_start") + F.length("replacement"))


def roundtrip_verified(source: Column, rewritten: Column, edits: Column) -> Column:
    """Whether undoing the edits (with target_start, target_end) in the rewritten text gives the source, and each lies where it should."""
    ordered = F.array_sort(edits)
    there = F.forall(ordered, lambda e: F.substring(rewritten, e["target_start"] + 1, e["target_end"] - e["target_start"]) == e["replacement"])
    undone = F.aggregate(F.reverse(ordered), rewritten, lambda t, e: F.concat(F.substring(t, F.lit(1), e["target_start"]), e["original"], F.substring(t, e["target_end"] + 1, F.length(t))))
    return F.when(F.size(edits) == 0, source == rewritten).otherwise(there & (undone == source))


def rewrite(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``rewritten``, ``edits`` (with target offsets) and ``roundtrip_ok``. Edits that overlap others of a document drop out with them."""
    clear = overlapping(edits, id_col).where(~F.col("overlaps")).drop("overlaps")
    listed = with_target_offsets(clear, id_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "original", "replacement", "target_start", "target_end"))).alias("edits"))
    joined = docs.join(listed.hint("merge"), id_col, "left").withColumn("edits", F.coalesce("edits", F.array().cast(listed.schema["edits"].dataType)))
    done = joined.withColumn("rewritten", apply_edits(F.col(text_col), F.col("edits"), strict=False))
    return done.withColumn("roundtrip_ok", roundtrip_verified(F.col(text_col), F.col("rewritten"), F.col("edits")))


def identity_map(entities: Column, replacements: Column, text: Column) -> Column:
    """Replacements of known entities that fit the text, with themselves as replacement: a map that gives nothing away."""
    known = F.transform(entities, lambda e: e["entity_id"])
    kept = F.filter(replacements, lambda r: F.array_contains(known, r["entity_id"]) & valid_span(text, r["start"], r["end"], r["original"]))
    return F.transform(kept, lambda r: F.struct(r["entity_id"].alias("entity_id"), r["start"].alias("start"), r["end"].alias("end"), r["original"].alias("original"), r["original"].alias("replacement")))
