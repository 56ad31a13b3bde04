"""Structured Streaming forms of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from folioworks.operators.incremental import last_per_key
from folioworks.session import scratch_path
from folioworks.sources.tables import KeyedTable


def event_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream; local time stamps become instants for watermarks."""
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
           .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, width: str, limit: int, keys: Sequence[str], delay: str) -> DataFrame:
    """Hits per fixed window; a window is emitted once, after the watermark has passed it."""
    counted = (events.withWatermark("ts", delay).groupBy(*keys, F.window("ts", width).alias("w"))
               .agg(F.count("*").alias("hits")))
    return counted.select(*keys, F.col("w.start").alias("window_start"), "hits",
                          F.greatest(F.col("hits") - limit, F.lit(0)).alias("rejected"))


def ttl_lookups(lookups: DataFrame, key: str, ttl_seconds: int, delay: str) -> DataFrame:
    """Hits and misses of a time-to-live cache, with the expiry kept as state per key.

    A key's rows of one micro-batch arrive in chunks and are reduced to one
    count per second before the walk; the state is one number, dropped by the
    event-time timeout once it has expired.
    """
    def walk(name: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        per_second: dict[int, int] = {}
        for chunk in chunks:
            for second, n in (chunk["ts"].astype("int64") // 10 ** 9).value_counts().items():
                per_second[second] = per_second.get(second, 0) + int(n)
        expires = state.get[0] if state.exists else None
        rows = []
        for second in sorted(per_second):
            miss = expires is None or second >= expires
            if miss:
                expires = second + ttl_seconds
            rows.append((name[0], second, per_second[second], miss))
        state.update((expires,))
        state.setTimeoutTimestamp(max(expires * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, "second", "lookups", "miss"])

    kind = lookups.schema[key].dataType.simpleString()
    narrowed = lookups.select(key, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return narrowed.groupBy(key).applyInPandasWithState(
        lambda name, chunks, state: walk(name, _whole_seconds(chunks), state),
        f"{key} {kind}, second long, lookups long, miss boolean", "expires long", "append",
        GroupStateTimeout.EventTimeTimeout)


def _whole_seconds(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for chunk in chunks:
        yield chunk.assign(ts=chunk["ts"].astype("datetime64[ns]"))


def upsert_sink(table: KeyedTable, order: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
                writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """I1/I7 on a stream: every micro-batch is reduced to one row per key and merged into the parts it touches.

    ``writer`` names the stream's checkpoint: its batch numbers are kept with the
    table's state, so a batch replayed after a failure changes nothing.
    """
    def apply(batch: DataFrame, number: int) -> None:
        newest = last_per_key(batch, table.keys, F.col(order)).persist()  # read for the parts, then for the rows
        try:
            table.apply(newest, merge, writer, number)
        finally:
            newest.unpersist()

    return apply


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; the output is a parquet table."""
    query: StreamingQuery = (stream.writeStream.format("parquet").option("path", path)
                             .option("checkpointLocation", checkpoint).outputMode("append")
                             .trigger(availableNow=True).start())
    query.awaitTermination()


def latest_windows(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """I16: windowed counts over the available input, with the windows that are still open at its end.

    In update mode a micro-batch gives the windows it has changed.  It writes
    them to a folder of its own, which a replay writes over.  Counts only grow,
    so a window's largest count is its last.
    """
    spark, counts = stream.sparkSession, [c for c in stream.columns if c not in keys]
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")  # for a folder without any files

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (stream.writeStream.foreachBatch(store).option("checkpointLocation", state).outputMode("update")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    seen = spark.read.schema(stream.schema).parquet(out)
    return seen.groupBy(*keys).agg(F.max(F.struct(*counts)).alias("_last")).select(*keys, "_last.*")


def materialize(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over the available input and read its output back."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    run_available(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)
