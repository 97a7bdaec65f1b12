"""Streaming ingest: files as they come, each text once, caps that survive restarts, and counts in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from docloom.functions import text as T


def documents(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def fresh_texts(docs: DataFrame, text_col: str = "text", min_chars: int = 1, event_time: str | None = None, horizon: str = "1 day") -> DataFrame:
    """Rows of texts not seen before. The state has a hash of each text; with an event time it forgets those beyond the horizon."""
    kept = docs.where(F.length(T.strip_space(F.col(text_col))) >= min_chars).withColumn("text_sha256", F.sha2(F.col(text_col), 256))
    if event_time:
        return kept.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["text_sha256"])
    return kept.dropDuplicates(["text_sha256"])


def ingest(docs: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now to Parquet and stop; a later call goes on where this one ended."""
    return docs.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_capped(docs: DataFrame, output: str, checkpoint: str, caps: dict[str, int], group_col: str = "category", order_col: str = "doc_id", had: DataFrame | None = None) -> StreamingQuery:
    """As ``ingest``, with at most a number of rows of each group over all batches; groups without a cap, and null ones, pass.

    How many a group has is state, so restarts know it and nothing that is written is read again; ``had`` (group, had) is where a
    first run begins. Of a batch the first rows by ``order_col`` are taken. Each Arrow batch gives up what is over a cap before
    it is shuffled, and a group holds no more rows than its cap.
    """
    capped = docs.where(F.col(group_col).isin(list(caps)))
    names = capped.columns

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rank = part.sort_values(order_col, kind="stable").groupby(group_col, sort=False).cumcount()
            yield part[rank.reindex(part.index) < part[group_col].map(caps)]

    class Capped(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.had = handle.getValueState("had", "had long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            had = self.had.get()[0] if self.had.exists() else 0
            room, kept = max(0, caps[key[0]] - had), None
            for part in rows:
                kept = (part if kept is None else pd.concat([kept, part])).sort_values(order_col, kind="stable").head(room)
            if kept is not None and len(kept):
                self.had.update((had + len(kept),))
                yield kept[names]

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.had.update((int(initialState["had"].iloc[0]),))

        def close(self) -> None:
            pass

    grouped = capped.mapInPandas(first, docs.schema).groupBy(group_col)
    start = had.select(F.col("group").alias(group_col), F.col("had").cast("long").alias("had")).groupBy(group_col) if had is not None else None
    kept = grouped.transformWithStateInPandas(Capped(), docs.schema, "Append", "None", start)
    out = docs.where(F.coalesce(~F.col(group_col).isin(list(caps)), F.lit(True))).unionByName(kept)
    return with_state_on_disk(docs.sparkSession, lambda: ingest(out, output, checkpoint))


def with_state_on_disk(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state is in RocksDB, which processors of map and value state need; other queries of the session keep theirs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.set(name, before)


class _Pool(StatefulProcessor):
    """The documents of the least ranks of a reason; changes come out."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "doc_id string", "rank string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        best = dict(held)
        for part in rows:
            best.update(zip(part["doc_id"], part["rank"]))
            best = dict(sorted(best.items(), key=lambda x: (x[1], x[0]))[: self.size])
        out = [(key[0], d, r, 1) for d, r in best.items() if d not in held] + [(key[0], d, r, -1) for d, r in held.items() if d not in best]
        for _, d, r, change in out:
            if change > 0:
                self.held.updateValue((d,), (r,))
            else:
                self.held.removeKey((d,))
        yield pd.DataFrame(out, columns=["reason", "doc_id", "rank", "change"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for d, r in zip(initialState["doc_id"], initialState["rank"]):
            self.held.updateValue((d,), (r,))

    def close(self) -> None:
        pass


def pool_changes(docs: DataFrame, reasons: Column, size: int, seed: str | int = 42, id_col: str = "doc_id", pool: DataFrame | None = None) -> DataFrame:
    """(reason, doc_id, rank, change): documents that enter (1) or leave (-1) the pool of a reason, which has the ``size`` of least hashed ranks.

    ``reasons`` is an array for each document; null and empty ones enter no pool, and a document that comes again counts once. Ids are given
    as strings. ``pool`` (reason, doc_id, rank) is what a first run begins with. Start it by ``with_state_on_disk``.
    """
    rows = docs.select(F.explode(F.array_distinct(reasons)).alias("reason"), F.col(id_col).cast("string").alias("doc_id")).where("doc_id is not null and reason is not null")
    ranked = rows.withColumn("rank", T.stable_hash(str(seed), F.col("doc_id")))

    def least(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.drop_duplicates().sort_values(["rank", "doc_id"]).groupby("reason", sort=False).head(size)

    grouped = ranked.mapInPandas(least, ranked.schema).groupBy("reason")
    start = pool.select("reason", F.col("doc_id").cast("string").alias("doc_id"), "rank").groupBy("reason") if pool is not None else None
    return grouped.transformWithStateInPandas(_Pool(size), "reason string, doc_id string, rank string, change int", "Append", "None", start)


def pool_records(changes: DataFrame) -> DataFrame:
    """(doc_id, reasons) of what is in the pools after all ``changes``."""
    held = changes.groupBy("reason", "doc_id").agg(F.sum("change").alias("n")).where("n > 0")
    return held.groupBy("doc_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def windowed_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", value_col: str | None = None) -> DataFrame:
    """Counts, and sums of a value, by key in windows of event time, with a bound on lateness. An extension beyond documents."""
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    sums = [F.sum(value_col).alias("total")] if value_col else []
    grouped = events.withWatermark(time_col, late).groupBy(window.alias("w"), key_col).agg(F.count("*").alias("n"), *sums)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key_col, "n", *(["total"] if value_col else []))


def sessions(events: DataFrame, time_col: str = "ts", key_col: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a key that follow each other within a gap."""
    grouped = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key_col).agg(F.count("*").alias("n"))
    return grouped.select(key_col, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
