"""Court roles of mentions, from titles next to them and the sections they stand in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import rules
from docloom.functions.text import ACCENTED, PLAIN
from docloom.sources.steps import small_batches

_FOLD = str.maketrans(ACCENTED, PLAIN)
_DIRECT = rules.any_of(rules.DIRECT_ROLES)
_BEFORE = re.compile(rf"\b(?:{_DIRECT})\b\s*[:,\-]?\s*(?:(?:ong|ba)\s*[:.]?\s*)?$")
_AFTER = re.compile(rf"^\s*[,:\-(]?\s*(?:la\s+)?(?:{_DIRECT})\b")
_ANY = re.compile(rf"\b(?:{rules.any_of(rules.COURT_ROLES)})")
_AGENCY = re.compile(rf"\b(?:{rules.any_of(rules.AGENCIES)})\b")
_PARTY = re.compile(rf"\b(?:{rules.any_of(rules.FIRST_PARTIES)})\s*:")
_FOOTERS = tuple(tuple(x.split()) for x in rules.FOOTER_LINES)
NEAR, HEADER_WINDOW, FOOTER_WINDOW = 70, 120, 500


def _folded(text: str) -> str:
    """Letter by letter, so offsets stay; letters whose lower case is longer stay as they are."""
    plain = text.translate(_FOLD)
    if "İ" not in plain and "Σ" not in plain:  # which alone grow, or go by what stands around
        return plain.lower()
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)


def begins_footer(line: str) -> bool:
    """The first words of a folded line, whatever stands between them, are those of a footer."""
    words = tuple(re.findall(r"\w+", line[:80]))
    return any(words[: len(f)] == f for f in _FOOTERS)


def zones(text: str) -> tuple[int | None, int | None]:
    """Where the first party is declared, and where the last footer begins."""
    return _zones(_folded(text))


def _zones(folded: str) -> tuple[int | None, int | None]:
    first = _PARTY.search(folded)
    last, at = None, 0
    for line in folded.split("\n"):
        if begins_footer(line):
            last = at
        at += len(line) + 1
    return (first.start() if first else None), last


def is_court_personnel(folded: str, start: int, end: int, header: int | None, footer: int | None) -> bool:
    """A direct title ends just before the mention or begins just after it; else any title nearby in the header or footer."""
    if _BEFORE.search(folded[max(0, start - NEAR) : start]) or _AFTER.search(folded[end : end + NEAR]):
        return True
    if footer is not None and start >= footer:
        return bool(_ANY.search(folded[max(footer, start - FOOTER_WINDOW) : start]) or _ANY.search(folded[end : end + HEADER_WINDOW]))
    if header is not None and start < header:
        return bool(_ANY.search(folded[max(0, start - HEADER_WINDOW) : start]) or _ANY.search(folded[end : min(header, end + HEADER_WINDOW)]))
    return False


def classify(text: str, label: str, start: int, end: int) -> str:
    folded = _folded(text)
    if label == "ORG":
        return "court_personnel" if _AGENCY.search(folded[start:end]) else "party"
    if label == "PER":
        return "court_personnel" if is_court_personnel(folded, start, end, *zones(text)) else "party"
    return "party"


def classify_mentions(mentions: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``mentions`` with ``role``: court_personnel or party. A document is folded once for all its mentions.

    Both joins sort: Spark's estimate of a text is a few bytes, by which it would send all texts through the driver to every worker.
    """
    listed = mentions.groupBy(id_col).agg(F.collect_list(F.struct("label", "start", "end")).alias("m"))
    kind = dict(mentions.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, text, found in zip(part["id"], part["text"], part["m"]):
                folded = _folded(text)
                header, footer = _zones(folded)
                for x in found:
                    court = bool(_AGENCY.search(folded[x["start"] : x["end"]])) if x["label"] == "ORG" else x["label"] == "PER" and is_court_personnel(folded, x["start"], x["end"], header, footer)
                    rows.append((i, x["label"], x["start"], x["end"], "court_personnel" if court else "party"))
            yield pd.DataFrame(rows, columns=["id", "label", "start", "end", "role"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(listed.withColumnRenamed(id_col, "id").hint("merge"), "id")
    small_batches()
    roles = made.mapInPandas(run, f"id {kind}, label string, start int, end int, role string").withColumnRenamed("id", id_col).distinct()
    return mentions.join(roles.hint("merge"), [id_col, "label", "start", "end"])


def preserve_clusters(mentions: DataFrame, cluster_col: str = "cluster_id", id_col: str = "doc_id") -> DataFrame:
    """Add ``preserve``: one protected mention protects its whole cluster."""
    protected = F.bool_or(F.col("role") == "court_personnel").over(Window.partitionBy(id_col, cluster_col))
    return mentions.withColumn("preserve", F.coalesce(protected, F.lit(False)))
