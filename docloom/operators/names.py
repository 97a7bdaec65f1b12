"""Known place names in running text: matching across broken spacing, repairs and address chains."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.operators.geo import gathered
from docloom.sources.steps import small_batches

_UNITS = re.compile(rf"(?<!\w)({rules.any_of(rules.PLACE_UNITS.values())})(?!\w)[ \t]*", re.I)
_MARKER = re.compile(rf"[A-ZĐ](?:[ \t]*{rules.ORDINAL})?(?!\w)")


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """A Unicode normal form, NFC, NFD, NFKC or NFKD; Spark has none of its own."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    small_batches()
    return F.pandas_udf(run, "string")(c)


class KnownNames:
    """Names of places by unit, found whatever the spaces in them."""

    def __init__(self, rows: list[tuple]):
        """``rows`` are (unit, name)."""
        self.by_unit: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
        for unit, name in rows:
            self.by_unit[unit.lower()]["".join(name.lower().split())].add(name)
        self.longest = {u: max(map(len, names)) for u, names in self.by_unit.items()}

    def at(self, text: str, start: int, unit: str) -> tuple[str, int] | None:
        """(name, end) of the longest name of the unit that begins here and ends at a word's end; an ambiguous one does not count."""
        names, best, letters = self.by_unit.get(unit, {}), None, ""
        for end in range(start, min(len(text), start + 100)):
            if text[end] in " \t":
                continue
            letters += text[end].lower()
            if len(letters) > self.longest.get(unit, 0):
                break
            whole = end + 1 == len(text) or not (text[end + 1].isalnum() or text[end + 1] == "_")
            if whole and len(names.get(letters, ())) == 1:
                best = next(iter(names[letters])), end + 1
        return best

    def repairs(self, text: str, start: int, end: int) -> list[dict]:
        """Names within a span that differ from the known ones in their spaces: (start, end, original, normalized). A marker after a unit is left alone."""
        found = []
        for m in _UNITS.finditer(text, start, end):
            if _MARKER.match(text, m.end(), end):
                continue
            hit = self.at(text, m.end(), " ".join(m.group(1).lower().split()))
            if hit and hit[1] <= end and text[m.end() : hit[1]] != hit[0]:
                found.append({"start": m.end(), "end": hit[1], "original": text[m.end() : hit[1]], "normalized": hit[0]})
        return found

    def chain(self, tail: str) -> list[str]:
        """Units with their names or markers that follow each other right from the start, as in ``, xã A, huyện B``; anything else ends it."""
        parts, at = [], 0
        while True:
            at = re.compile(r"[ \t,]*").match(tail, at).end()
            unit = _UNITS.match(tail, at)
            if not unit:
                return parts
            word = " ".join(unit.group(1).lower().split())
            marker = _MARKER.match(tail, unit.end())
            hit = (marker.group(), marker.end()) if marker else self.at(tail, unit.end(), word)
            if not hit:
                return parts
            parts.append(f"{word} {hit[0]}".lower())
            at = hit[1]


def repair_spans(mentions: DataFrame, docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, original, normalized): names within the mentions of places whose spaces are broken. The gazetteer is a fixed table."""
    rows = docs.sparkSession.sparkContext.broadcast([(unit, name) for *_, unit, name in gathered(gazetteer)])
    spans = mentions.where("label = 'LOC'").groupBy(id_col).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(spans.withColumnRenamed(id_col, "id"), "id")
    kind = dict(joined.dtypes)["id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = KnownNames(rows.value)
        for part in parts:
            made = [{"id": i, **r} for i, t, ss in zip(part["id"], part["text"], part["spans"]) for s in ss for r in names.repairs(t, s["start"], s["end"])]
            yield pd.DataFrame(made, columns=["id", "start", "end", "original", "normalized"])

    return joined.mapInPandas(run, f"id {kind}, start int, end int, original string, normalized string").withColumnRenamed("id", id_col).distinct()
