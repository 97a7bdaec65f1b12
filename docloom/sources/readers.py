"""Reading documents: JSON lines, JSON, Parquet with checks, plain text, DOCX, gazetteers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

TEXT_FIELDS = ("text", "content", "markdown")
ID_FIELDS = ("case_id", "doc_id", "document_id", "id")
MOST_ENTRIES, MOST_EXPANDED = 5000, 200 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def json_lines(spark: SparkSession, path: str, schema: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Records of JSON lines with ``line_no``, counted from 1 over physical lines, blank ones included; these are then skipped.

    A byte order mark is dropped. Line numbers exist within a single file; they follow the file's order, whatever its partitions. A line that
    is no record gets nulls and its text in ``_corrupt``.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_part"), "value")
    # The running number inside a partition, and the sizes of those before it: one small table, one row a partition.
    sizes = lines.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = lines.join(F.broadcast(base.select("_part", "_first", "_base")), "_part").withColumn("line_no", F.col("_at") - F.col("_first") + F.col("_base") + 1)
    kept = numbered.where(F.col("line_no") > offset)
    if limit is not None:
        kept = kept.where(F.col("line_no") <= offset + limit)
    record = F.from_json(F.regexp_replace("value", "^﻿", ""), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return kept.where(F.length(T.strip_space(F.regexp_replace("value", "^﻿", ""))) > 0).select("line_no", record.alias("r")).select("line_no", "r.*")


def latest_by_id(df: DataFrame, id_col: str, order_col: str = "line_no") -> DataFrame:
    """Of rows with one id the last; ``order_col`` tells rows apart."""
    last = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(order_col).alias(order_col))
    return df.join(last, [id_col, order_col], "left_semi")


def assert_unique(df: DataFrame, id_col: str) -> DataFrame:
    """The rows; raises where an id is there twice."""
    twice = [r[0] for r in df.groupBy(id_col).count().where("count > 1").select(id_col).limit(5).collect()]
    if twice:
        raise ValueError(f"repeated ids: {twice}")
    return df


def find_row(df: DataFrame, id_col: str, value) -> DataFrame:
    """The row of one id, if there is one."""
    return df.where(F.col(id_col) == value).limit(1)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file that holds an object or an array of them."""
    return spark.read.option("multiLine", True).json(path)


def parquet_checked(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A Parquet table that has the required columns."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def content_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files, for provenance."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def plain_texts(spark: SparkSession, path: str, most_bytes: int = 10 << 20) -> DataFrame:
    """(path, text) of whole text files, without byte order marks; too large or blank files raise."""
    files = spark.read.format("binaryFile").load(path)
    checked = F.when(F.col("length") > most_bytes, F.raise_error(F.concat(F.lit("too large: "), "path")).cast("binary")).otherwise(F.col("content"))
    text = F.regexp_replace(F.decode(checked, "utf-8"), "^﻿", "")
    empty = F.when(F.length(T.strip_space(text)) == 0, F.raise_error(F.concat(F.lit("empty: "), "path")).cast("string"))
    return files.select("path", F.coalesce(empty, text).alias("text"))


def record_text(df: DataFrame, field: str | None = None) -> tuple[DataFrame, str]:
    """The table with ``text``, and the field it came from: the one named, or the first usual one that is there."""
    names = [field] if field else [f for f in TEXT_FIELDS if f in df.columns]
    if not names or names[0] not in df.columns:
        raise ValueError(f"no text field among {df.columns}")
    return df.withColumn("text", F.col(names[0]).cast("string")), names[0]


def record_id(df: DataFrame, position: Column | None = None) -> Column:
    """An id from the usual fields, or a number of the record."""
    found = [T.blank(F.col(c)) for c in ID_FIELDS if c in df.columns]
    number = [F.concat(F.lit("document_"), F.lpad(position.cast("string"), 6, "0"))] if position is not None else []
    return F.coalesce(*found, *number, F.lit(None).cast("string"))


# ---- DOCX ---------------------------------------------------------------------------------------------------------


def check_docx(data: bytes) -> zipfile.ZipFile:
    """The archive, if it is one of a plausible size with a document in it."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    entries = archive.infolist()
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_EXPANDED:
        raise ValueError("the archive is too large when unpacked")
    if "word/document.xml" not in archive.namelist():
        raise ValueError("the archive has no document")
    return archive


def _stories(archive: zipfile.ZipFile) -> list[str]:
    """The body, then headers and footers."""
    extra = sorted(n for n in archive.namelist() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))
    return ["word/document.xml", *extra]


def _paragraphs(root: ElementTree.Element) -> list[ElementTree.Element]:
    return list(root.iter(f"{_W}p"))


def _runs(paragraph: ElementTree.Element) -> list[ElementTree.Element]:
    """Text elements of a paragraph's own runs, not of paragraphs nested in it."""
    nested = {t for inner in paragraph.iter(f"{_W}p") if inner is not paragraph for t in inner.iter(f"{_W}t")}
    return [t for t in paragraph.iter(f"{_W}t") if t not in nested]


def docx_parts(data: bytes) -> list[dict]:
    """Paragraphs that have text: story, place in it, and where they lie in the whole text, in which newlines join them."""
    archive = check_docx(data)
    parts, at = [], 0
    for story in _stories(archive):
        for i, p in enumerate(_paragraphs(ElementTree.fromstring(archive.read(story)))):
            text = "".join(t.text or "" for t in _runs(p))
            if text:
                parts.append({"part_no": len(parts), "story": story, "paragraph": i, "start": at, "end": at + len(text), "text": text})
                at += len(text) + 1
    return parts


def rewrite_docx(data: bytes, edits: list[dict]) -> bytes:
    """The file with edits (start, end, original, replacement) made inside its runs, whose formatting stays; an edit across paragraphs raises."""
    archive, parts = check_docx(data), docx_parts(data)
    by: dict[tuple[str, int], list[dict]] = {}
    for e in edits:
        home = [p for p in parts if p["start"] <= e["start"] and e["end"] <= p["end"]]
        if not home or home[0]["text"][e["start"] - home[0]["start"] : e["end"] - home[0]["start"]] != e["original"]:
            raise ValueError("an edit crosses paragraphs or does not fit its text")
        by.setdefault((home[0]["story"], home[0]["paragraph"]), []).append({**e, "start": e["start"] - home[0]["start"], "end": e["end"] - home[0]["start"]})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in archive.infolist():
            raw = archive.read(item)
            mine = {k[1]: v for k, v in by.items() if k[0] == item.filename}
            if mine:
                root = ElementTree.fromstring(raw)
                paragraphs = _paragraphs(root)
                for i, es in mine.items():
                    for e in sorted(es, key=lambda e: e["start"], reverse=True):
                        _edit_runs(_runs(paragraphs[i]), e)
                raw = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            target.writestr(item, raw)
    return out.getvalue()


def _edit_runs(runs: list[ElementTree.Element], edit: dict) -> None:
    """Put the replacement where the edit begins, and take the rest of it from later runs."""
    at, placed = 0, False
    for t in runs:
        text = t.text or ""
        a, b = max(edit["start"] - at, 0), min(edit["end"] - at, len(text))
        at += len(text)
        if a < b:
            t.text = text[:a] + ("" if placed else edit["replacement"]) + text[b:]
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            placed = True


def docx_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, part_no, story, start, end, text, error) of the paragraphs of DOCX files; a file that cannot be read has a row with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, data in zip(part["path"], part["content"]):
                try:
                    rows += [{"path": name, "error": None, **{k: p[k] for k in ("part_no", "story", "start", "end", "text")}} for p in docx_parts(data)]
                except Exception as e:
                    rows.append({"path": name, "part_no": None, "story": None, "start": None, "end": None, "text": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "part_no", "story", "start", "end", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, part_no int, story string, start int, end int, text string, error string")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(code, parent, level, unit, name) from a tab-separated file with a header."""
    schema = "code string, parent string, level string, unit string, name string"
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on keys; raises where either side has rows that the other lacks, or repeats a key."""
    for name, a, b in (("left", left, right), ("right", right, left)):
        lost = a.select(*keys).join(b.select(*keys), keys, "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"the {name} table has rows that the other lacks, such as {tuple(lost[0])}")
        if not a.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the {name} table repeats a key")
    return left.join(right, keys)


def align_all(tables: dict[str, DataFrame], keys: list[str], equal: list[tuple[str, str, str]] = ()) -> DataFrame:
    """The inner join of several tables on keys; raises where counts or keys differ or repeat, or where columns that must agree do not.

    ``equal`` lists (column, table, other table): hashes, say, that both state for the same row. Nulls agree with nulls. Of
    columns that several tables have, the first table's stay.
    """
    counts = {name: t.count() for name, t in tables.items()}
    if len(set(counts.values())) > 1:
        raise ValueError(f"tables of different sizes: {counts}")
    for column, a, b in equal:
        both = tables[a].select(*keys, F.col(column).alias("_a")).join(tables[b].select(*keys, F.col(column).alias("_b")), keys)
        off = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys).limit(1).collect()
        if off:
            raise ValueError(f"{column} of {a} and {b} differ, such as at {tuple(off[0])}")
    out = None
    for t in tables.values():
        out = t if out is None else align(out, t.select(*keys, *[c for c in t.columns if c not in out.columns]), keys)
    return out


def with_text_hash(df: DataFrame, text_col: str = "text", name: str = "source_sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(F.col(text_col), 256))
