"""Recognising mentions: windows over tokens, merging of token labels, and taggers as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.sources.steps import small_batches

MENTION = "label string, start int, end int, surface string, score double"


def split_label(label: str) -> tuple[str, str]:
    """(prefix, type) of a token label: B-PER is (B, PER), O is (O, ''), and a plain type counts as inside."""
    head, dash, rest = label.replace("_", "-", 1).partition("-") if label[:2] in ("B_", "I_", "E_", "S_", "U_", "L_") else label.partition("-")
    if label.upper() == "O":
        return "O", ""
    if dash and head.upper() in ("B", "I", "E", "S", "U", "L"):
        name = rest.upper()
        return head.upper(), rules.LABEL_ALIASES.get(name, name)
    return "I", rules.LABEL_ALIASES.get(label.upper(), label.upper())


def parse_types(wanted: str | None) -> set[str] | None:
    """Types from a comma list; None, for all of them, if it is empty, ``all`` or ``*``."""
    names = {x.strip().upper() for x in (wanted or "").split(",") if x.strip()}
    return None if not names or names & {"ALL", "*"} else {rules.LABEL_ALIASES.get(n, n) for n in names}


def windows(n: int, size: int = 512, overlap: int = 128) -> list[tuple[int, int]]:
    """Token ranges that cover 0..n, each sharing ``overlap`` with the one before."""
    if size <= overlap:
        raise ValueError("a window must be larger than the overlap")
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += size - overlap


def merge_tokens(text: str, tokens: list[tuple[int, int, str, float]], types: set[str] | None = None, least_score: float = 0.0, most_gap: int = 2) -> list[dict]:
    """Mentions from (start, end, label, score) of tokens in order.

    A new one begins at a beginning or single label, where the type changes, where a token goes back, and after a gap of over
    ``most_gap`` characters; an outside, unwanted or weak token ends one. Its score is the mean of its tokens', to six digits.
    """
    found: list[dict] = []
    open_: list[tuple[int, int, float]] = []
    kind = ""

    def close() -> None:
        if open_:
            a, b = open_[0][0], open_[-1][1]
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            if a < b:
                found.append({"label": kind, "start": a, "end": b, "surface": text[a:b], "score": round(sum(x[2] for x in open_) / len(open_), 6)})
            open_.clear()

    for start, end, label, score in tokens:
        prefix, name = split_label(label)
        if prefix == "O" or types is not None and name not in types or score < least_score:
            close()
            continue
        if not open_ or prefix in ("B", "S", "U", "E") or name != kind or start < open_[-1][0] or start - open_[-1][1] > most_gap:
            close()
            kind = name
        open_.append((start, end, score))
    close()
    return found


def best_of_overlaps(mentions: list[dict]) -> list[dict]:
    """Of mentions with one span and label, as neighbouring windows give them, that of the best score; in order of position."""
    best: dict[tuple, dict] = {}
    for m in mentions:
        key = (m["start"], m["end"], m["label"])
        if key not in best or m["score"] > best[key]["score"]:
            best[key] = m
    return [best[k] for k in sorted(best)]


def tag(docs: DataFrame, tagger: Callable[[list[str]], list[list[dict]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, char_len, entities, error): a tagger's mentions of each text.

    ``tagger`` takes texts and gives lists of mentions; it is unpickled once a worker, so it may hold a model. A text on which it
    fails is tried alone and gets the error; the task goes on.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(frame.dtypes)["id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].tolist()
            errors: list[str | None] = [None] * len(texts)
            try:
                made = tagger(texts)
            except Exception:
                made = []
                for i, t in enumerate(texts):
                    try:
                        made += tagger([t])
                    except Exception as e:  # a document must not fail its task
                        made.append([])
                        errors[i] = f"{type(e).__name__}: {e}"
            made = [best_of_overlaps([m for m in ms if 0 <= m["start"] < m["end"] <= len(t) and t[m["start"] : m["end"]] == m["surface"]]) for t, ms in zip(texts, made)]
            yield pd.DataFrame({"id": part["id"], "char_len": [len(t) for t in texts], "entities": made, "error": errors})

    entities = "array<struct<label:string,start:int,end:int,surface:string,score:double>>"
    small_batches()
    return frame.mapInPandas(run, f"id {kind}, char_len int, entities {entities}, error string").withColumnRenamed("id", id_col)


def rule_tagger(patterns: dict[str, str]) -> Callable[[list[str]], list[list[dict]]]:
    """A tagger of patterns: deterministic, and of full confidence."""
    import re

    compiled = {k: re.compile(p) for k, p in patterns.items()}

    def of(text: str) -> list[dict]:
        return [{"label": k, "start": m.start(m.lastindex or 0), "end": m.end(m.lastindex or 0), "surface": m.group(m.lastindex or 0), "score": 1.0} for k, p in compiled.items() for m in p.finditer(text)]

    return lambda texts: [of(t) for t in texts]


def observations(predictions: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, start, end, surface, score): predictions of known types whose span fits the source text."""
    from docloom.operators.spans import valid_span

    long = predictions.select(id_col, F.inline("entities"))
    aliases = F.create_map(*[F.lit(x) for kv in rules.LABEL_ALIASES.items() for x in kv])
    named = long.withColumn("label", F.coalesce(F.element_at(aliases, F.upper("label")), F.upper("label"))).where(F.col("label").isin("PER", "LOC", "ORG"))
    joined = named.join(docs.select(id_col, F.col(text_col).alias("_text")), id_col)
    return joined.where(valid_span(F.col("_text"), F.col("start"), F.col("end"), F.col("surface"))).drop("_text")


def join_predictions(docs: DataFrame, predictions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities and ``review_reasons``: no prediction, an error, or a length that is not the text's."""
    latest = predictions.select(id_col, "entities", F.col("error").alias("ner_error"), "char_len")
    joined = docs.join(latest, id_col, "left")
    reasons = F.array(
        F.when(F.col("char_len").isNull(), F.lit("missing_ner_predictions")),
        F.when(F.col("ner_error").isNotNull(), F.lit("ner_inference_error")),
        F.when(F.col("char_len") != F.length(text_col), F.lit("ner_source_length_mismatch")),
    )
    return joined.withColumn("review_reasons", F.filter(reasons, lambda x: x.isNotNull()))


def decode_bio(rows: DataFrame, tokens_col: str = "tokens", tags_col: str = "ner_tags", names: list[str] | None = None) -> DataFrame:
    """(kind, name) of the entities in lists of words and tag numbers or labels; equal rows count once. Without Python: a fold.

    The fold's state is what is open and what is done; a sentinel at the end closes the last one.
    """
    once = rows.select(tokens_col, tags_col).distinct()
    label = (lambda t: F.get(F.array(*[F.lit(n) for n in names]), t.cast("int"))) if names else (lambda t: t.cast("string"))
    pairs = F.zip_with(F.col(tokens_col), F.col(tags_col), lambda w, t: F.struct(w.alias("w"), F.coalesce(label(t), F.lit("O")).alias("t")))
    sentinel = F.array(F.struct(F.lit("").alias("w"), F.lit("O").alias("t")))
    kind = lambda t: F.when(t == "O", "").otherwise(F.regexp_replace(t, "^[BI]-", ""))
    done = F.array().cast("array<struct<kind:string,name:string>>")

    def step(a, p):
        goes_on = p["t"].startswith("I-") & (kind(p["t"]) == a["kind"]) & (a["kind"] != "")
        closed = F.when(a["kind"] != "", F.array_append(a["done"], F.struct(a["kind"].alias("kind"), a["name"].alias("name")))).otherwise(a["done"])
        return F.when(goes_on, F.struct(a["kind"].alias("kind"), F.concat_ws(" ", a["name"], p["w"]).alias("name"), a["done"].alias("done"))).otherwise(
            F.struct(kind(p["t"]).alias("kind"), F.when(kind(p["t"]) == "", "").otherwise(p["w"]).alias("name"), closed.alias("done"))
        )

    start = F.struct(F.lit("").alias("kind"), F.lit("").alias("name"), done.alias("done"))
    return once.select(F.inline(F.aggregate(F.concat(pairs, sentinel), start, step, lambda a: a["done"])))


def vocabulary(entities: DataFrame, kind: str, most_examples: int = 3) -> DataFrame:
    """(name, n, examples): names of one kind with counts and a few ways they are written; underscores are spaces."""
    named = entities.where(F.col("kind") == kind).select(F.regexp_replace("name", "_", " ").alias("written"))
    named = named.withColumn("name", F.lower(F.trim(F.regexp_replace("written", r"(?U)\s+", " ")))).groupBy("name", "written").agg(F.count("*").alias("k"))
    return named.groupBy("name").agg(F.sum("k").alias("n"), F.slice(F.sort_array(F.collect_list("written")), 1, most_examples).alias("examples"))
