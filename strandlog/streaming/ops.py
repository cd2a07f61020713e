"""Streaming counterparts of the message operators. What depends on the order of a file's lines is in ordered.py, growing
files are read by sources/growing.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import messages as M
from strandlog.sources import formats, json_formats
from strandlog.streaming.ordered import exists


def tail(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(value, log_path) of new text files under a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path).select("value", F.col("_metadata.file_path").alias("log_path"))


def parsed(lines: DataFrame, fmt, line: str = "value", year: int = 1970) -> DataFrame:
    """The messages of a stream's lines by a format of the catalogue; lines of no pattern go."""
    return json_formats.parse_json_format(lines, fmt, line) if isinstance(fmt, json_formats.JsonFormat) else formats.parse(lines, fmt, line, year)


def demultiplexed(lines: DataFrame, pattern: str, value: str = "value") -> DataFrame:
    """mux_id, mux_time and body of the lines of several logs in one stream."""
    return M.demultiplex(lines, pattern, value)


def windowed(messages: DataFrame, length: str, *keys: str, delay: str = "1 hour", slide: str | None = None, time: str = "log_time") -> DataFrame:
    """Counts by window and keys; rows later than the delay are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return messages.withWatermark(time, delay).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("total"))


def sessions(messages: DataFrame, gap: str, *keys: str, delay: str = "1 hour", time: str = "log_time") -> DataFrame:
    return messages.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("total"))


def statistics(messages: DataFrame, keys: list[str], value: str) -> DataFrame:
    return messages.groupBy(*keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))


def watch(messages: DataFrame, rules: Mapping[str, str], values: list[str], time: str = "log_time") -> DataFrame:
    """(ts, watch, content): a JSON event for each message and rule (an SQL condition) it meets. One pass for all rules."""
    hits = F.filter(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in rules.items())), lambda x: x.isNotNull())
    rows = messages.select(F.col(time).alias("ts"), F.explode(hits).alias("watch"), *values)
    return rows.select("ts", "watch", F.to_json(F.struct("watch", *values)).alias("content"))


def deduplicate(messages: DataFrame, keys: list[str], delay: str = "1 hour", time: str = "log_time") -> DataFrame:
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def late(messages: DataFrame, delay: str, time: str = "log_time") -> DataFrame:
    """A watermark, so that stateful steps ignore rows that are later; ordered.repaired() moves late rows instead."""
    return messages.withWatermark(time, delay)


def react(stream: DataFrame, handler: Callable[[DataFrame, int], None]):
    """Runs handler on each batch of an event stream."""
    return stream.writeStream.foreachBatch(handler)


def lifecycle(messages: DataFrame, target: str):
    """Appends a row for each file (log_path, log_format) when it is first seen to the table at `target`."""

    def handler(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        files = batch.select("log_path", "log_format").distinct()
        known = spark.read.parquet(target) if exists(spark, target) else None
        new = files if known is None else files.join(known, "log_path", "left_anti")
        new.withColumn("seen", F.current_timestamp()).write.mode("append").parquet(target)

    return react(messages, handler)


def finish(writer, folder: str) -> None:
    """Runs a prepared writer over everything that is there now."""
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer.option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, run through the stream into a table in the folder; for complete or update mode its last state."""
    spark = stream.sparkSession
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/table").outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/table")).outputMode(mode)
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


