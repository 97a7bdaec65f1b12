"""Writing results: staged folders that are published whole, JSON lines, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(path))


def must_not_exist(spark: SparkSession, path: str, source: str | None = None) -> None:
    """Refuses to overwrite, and to write over what is read."""
    if source is not None and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("input and output are the same")
    if exists(spark, path):
        raise FileExistsError(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then renamed."""
    fs, path_of = _fs(spark, path)
    part = path_of(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(path_of(path), False)
    if not fs.rename(part, path_of(path)):
        raise OSError(f"{path} could not be put in place")


def put_json(spark: SparkSession, path: str, value) -> None:
    put_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls included; with ``append`` the folder grows."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, manifest: dict, fmt: str = "parquet", partition_by: dict[str, list[str]] | None = None, replace: bool = False) -> None:
    """Write all tables and then a manifest into a folder of building, and rename it into place: readers see all of it or nothing."""
    if not replace:
        must_not_exist(spark, path)
    building = f"{path}.building-{uuid.uuid4().hex}"
    fs, path_of = _fs(spark, path)
    try:
        for name, df in tables.items():
            writer = df.write.partitionBy(*(partition_by or {}).get(name, []))
            writer.format(fmt).save(f"{building}/{name}")
        put_json(spark, f"{building}/manifest.json", manifest)
        previous = path_of(f"{path}.previous-{uuid.uuid4().hex}")
        had = fs.exists(path_of(path))
        if had:
            fs.rename(path_of(path), previous)
        if not fs.rename(path_of(building), path_of(path)):
            if had:
                fs.rename(previous, path_of(path))
            raise OSError(f"{path} could not be put in place")
        if had:
            fs.delete(previous, True)
    finally:
        fs.delete(path_of(building), True)


def pair_manifest(pairs: DataFrame) -> list[dict]:
    """Rows by split and difficulty with documents, pairs and positives, for a manifest; a few rows."""
    made = pairs.groupBy("split", "difficulty").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pairs"), F.sum("label").alias("positives"))
    return [r.asDict() for r in made.orderBy("split", "difficulty").collect()]


def html_page(title: str, rows: list[dict], columns: list[str]) -> str:
    """A table as a page of its own."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows)
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>\n'
