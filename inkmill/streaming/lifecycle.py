"""Streaming twins of the lifecycle operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkmill.operators.lifecycle import TRANSITIONS


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream, timestamps with a zone so that they can carry a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def apply_transitions(events: DataFrame, key: str, state: str, seq: str, start: str, transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Requested states applied in order of seq within each batch, from the state kept for each key.

    Returns every request with from_state and its verdict: no_op, allowed or invalid.
    """
    kind = events.schema[key].dataType.simpleString()
    seq_kind = events.schema[seq].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(seq)
        now, out = held.get[0] if held.exists else start, []
        for n, wanted in zip(rows[seq], rows[state]):
            verdict = "no_op" if wanted == now else "allowed" if wanted in transitions.get(now, []) else "invalid"
            out.append((k[0], n, now, wanted, verdict))
            now = wanted if verdict == "allowed" else now
        held.update((now,))
        yield pd.DataFrame(out, columns=[key, seq, "from_state", "to_state", "verdict"])

    return events.select(key, seq, state).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {seq} {seq_kind}, from_state string, to_state string, verdict string", "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and keys; rows later than the watermark are left out by the engine."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def progress(events: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The latest value of each key so far (update mode)."""
    return events.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def append_events(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None, by: str | None = None):
    """Appends a stream's rows to a table of Parquet files, each once, as the sink's log keeps track of batches; returns the running query.

    interval: processing time between batches, such as "10 seconds"; None takes what is there and ends.
    """
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(by) if by else writer
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def snapshot_then_tail(spark: SparkSession, path: str, schema, key: str, value, seq: str, seen: int) -> DataFrame:
    """What a reader gets that has seen events up to `seen`: its key's later events as a stream, from the table's start on."""
    return read_events(spark, path, schema).filter((F.col(key) == value) & (F.col(seq) > seen))


def heartbeats(spark: SparkSession, every_seconds: int = 15) -> DataFrame:
    """A stream with one comment frame every so many seconds, to be sent where nothing else is."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.filter(F.col("value") % every_seconds == 0).select("timestamp", F.lit(": ping\n\n").alias("frame"))


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs the stream over what is there and returns its result as a table below `folder`, which all executors share.

    In complete and update mode the last state of each batch is what counts: complete batches replace
    the table, batches of updates are appended with their number.
    """
    path, checkpoint, spark = f"{folder}/rows", f"{folder}/state", stream.sparkSession
    if mode == "append":
        append_events(stream, path, checkpoint).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path) if mode == "update" else spark.read.schema(stream.schema).parquet(path)
