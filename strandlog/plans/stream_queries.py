"""The given tables read as streams, run until they are drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.plans.queries import EVENTS, FMT, stamp
from strandlog.operators.shared import folder
from strandlog.plans.registry import query
from strandlog.sources import formats, growing
from strandlog.streaming import ops, ordered


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern, so that it may be one file
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").otherwise("info")
    return e.withColumns({"log_time": F.col("ts").cast("timestamp"), "log_level": level, "log_path": F.concat(F.lit("file"), (F.col("event_id") % 8).cast("string")), "file_line": F.col("event_id")})


@query(f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {FMT}) AS start, log_level, count(*) AS total FROM {EVENTS} GROUP BY 1, 2")
def x5_windowed_stream(spark, sf_dir):
    out = ops.drain(ops.windowed(events(spark, sf_dir), "1 hour", "log_level"), folder(spark), "complete")
    return out.select(stamp("window.start").alias("start"), "log_level", "total")


@query("SELECT event_id, watch FROM (SELECT event_id, 'big' AS watch FROM events WHERE value > 300 UNION ALL SELECT event_id, 'error' FROM events WHERE event_type = 'error')")
def x6_watch_stream(spark, sf_dir):
    rules = {"big": "value > 300", "error": "event_type = 'error'"}
    out = ops.drain(ops.watch(events(spark, sf_dir), rules, ["event_id", "log_path"]), folder(spark))
    return out.select(F.get_json_object("content", "$.event_id").cast("bigint").alias("event_id"), "watch")


@query("SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def x9_statistics_stream(spark, sf_dir):
    out = ops.drain(ops.statistics(events(spark, sf_dir), ["event_type"], "value"), folder(spark), "complete")
    return out.withColumn("sum", F.round("sum", 4))


@query("SELECT DISTINCT event_type, user_id FROM events")
def x10_dedup_stream(spark, sf_dir):
    return ops.drain(ops.deduplicate(events(spark, sf_dir), ["event_type", "user_id"], "400 days").select("event_type", "user_id"), folder(spark))


def _base(spark) -> str:
    return f"{folder(spark)}/ordered-{uuid.uuid4().hex}"


def shuffled(spark: SparkSession, rows: DataFrame, parts: int = 4) -> DataFrame:
    """A stream of rows that come in `parts` batches by event_id, mixed up within each and over the borders of two."""
    target = f"{folder(spark)}/shuffled-{uuid.uuid4().hex}"
    n = rows.count() or 1
    moved = F.col("event_id") + F.pmod(F.xxhash64("event_id"), F.lit(max(1, n // 20)))
    part = F.least(F.floor(moved * parts / n), F.lit(parts - 1))
    files = 1 + n // 200_000  # each has thousands of rows, so that none is missing
    for i in range(parts):  # one after another, so that the files' times order them
        rows.where(part == i).repartition(files, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id")).write.mode("append").parquet(f"{target}/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{target}/*")


def _batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlog.plans.queries import events as batch

    return batch(spark, sf_dir).select("event_id", "event_type", "log_path", "file_line", "log_time")


@query("SELECT 'all' AS log_path, first AS file_line, count(*)::BIGINT AS n_lines FROM (SELECT event_id - event_id % 4 AS first FROM events) GROUP BY 2")
def x3_multiline_stream(spark, sf_dir):
    """Every fourth line of one file starts a message; lines come shuffled within a batch and the last message ends with the stream."""
    start = F.col("event_id") % 4 == 0
    lines = _batch_events(spark, sf_dir).select("event_id", F.lit("all").alias("log_path"), F.col("event_id").alias("file_line"), F.concat(F.when(start, "start ").otherwise("  "), F.col("event_type")).alias("value"))
    target = f"{folder(spark)}/shuffled-{uuid.uuid4().hex}"
    lines.repartition(8, F.xxhash64("event_id")).drop("event_id").write.parquet(target)
    stream = spark.readStream.schema("log_path string, file_line long, value string").parquet(target)
    return ordered.assembled(stream, _base(spark), F.col("value").startswith("start")).drained(stream).select("log_path", "file_line", "n_lines")


_LATE = "ts - CASE WHEN event_id % 7 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS t"


def _late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _batch_events(spark, sf_dir)
    return e.withColumn("log_time", F.when(F.col("event_id") % 7 == 0, F.col("log_time") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("log_time"))).drop("event_type")


@query(f"SELECT event_id, strftime(max(t) OVER w, {FMT}) AS log_time, max(t) OVER w > t AS time_skewed FROM (SELECT *, {_LATE} FROM {EVENTS}) WINDOW w AS (PARTITION BY log_path ORDER BY file_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def x4_late_rows_stream(spark, sf_dir):
    """Eight files whose lines come shuffled within batches and over their borders; a hold of some days puts them in order."""
    stream = shuffled(spark, _late_rows(spark, sf_dir))
    out = ordered.repaired(stream, _base(spark), hold="40 days").drained(stream)
    return out.select("event_id", stamp("log_time").alias("log_time"), "time_skewed")


@query(f"SELECT event_id, strftime(max(t) OVER w, {FMT}) AS log_time, max(t) OVER w > t AS time_skewed FROM (SELECT *, {_LATE} FROM {EVENTS}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def x4_late_rows_of_one_file(spark, sf_dir):
    """All events as one file, in one shuffled batch."""
    rows = _late_rows(spark, sf_dir).withColumns({"log_path": F.lit("all"), "file_line": F.col("event_id")})
    target = f"{folder(spark)}/shuffled-{uuid.uuid4().hex}"
    rows.repartition(8, F.xxhash64("event_id")).write.parquet(target)
    stream = spark.readStream.schema(rows.schema).parquet(target)
    return ordered.repaired(stream, _base(spark)).drained(stream).select("event_id", stamp("log_time").alias("log_time"), "time_skewed")


@query(
    f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'generic_log' WHEN 1 THEN 'glog_log' ELSE 'access_log' END AS log_format, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('microsecond', ts) ELSE date_trunc('second', ts) END, {FMT}) AS log_time FROM {EVENTS}"
)
def x2_recognized_stream(spark, sf_dir):
    """Three files of three formats in one stream: each one's format is fixed once its first lines are there."""
    from strandlog.plans.queries import events as batch

    e = batch(spark, sf_dir)
    at = F.col("log_time")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" INFO "), F.col("event_id").cast("string")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("I"), F.date_format(at, "MMdd HH:mm:ss.SSSSSS"), F.lit(" 8 app.cc:69] "), F.col("event_id").cast("string")))
        .otherwise(F.concat(F.lit("10.0.0.1 - - ["), F.date_format(at, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("event_id").cast("string"), F.lit(' HTTP/1.1" 200 5')))
    )
    rows = e.select((F.col("event_id") % 3).cast("string").alias("log_path"), F.floor(F.col("event_id") / 3).alias("file_line"), line.alias("value"), "event_id")
    stream = shuffled(spark, rows, parts=2)
    out = ordered.recognized(stream, _base(spark), sample=500, year=2024).drained(stream)
    return out.select(F.regexp_extract("log_body", r"(\d+)$", 1).cast("bigint").alias("event_id"), "log_format", stamp("log_time").alias("log_time"))


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files: every event as a line of a container's log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    line = F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string"), F.lit(" | "), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    path = f"{folder(spark)}/lines-{uuid.uuid4().hex}"
    e.select(line.alias("value")).repartition(6).write.text(path)
    return path


@query("SELECT 'c' || (user_id % 4) AS mux_id, count(*) AS lines FROM events GROUP BY 1")
def x1_tail_stream(spark, sf_dir):
    """New files of a folder, a few in each batch."""
    out = ops.drain(ops.tail(spark, log_files(spark, sf_dir), files_per_batch=2), folder(spark))
    return out.groupBy(F.split("value", " ")[0].alias("mux_id")).agg(F.count("*").alias("lines"))


@query("SELECT event_id, count(*)::BIGINT AS times FROM events GROUP BY 1")
def x1_growing_stream(spark, sf_dir):
    """A folder followed in two runs of one stream: half the events are there at first; then a file is renamed and the others come."""
    import os

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("value"))
    place = f"{folder(spark)}/growing-{uuid.uuid4().hex}"
    base = _base(spark)

    def run() -> None:
        rows = growing.follow(spark, f"{place}/*", split_bytes=4000)
        rows.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    e.where("value % 2 = 0").repartition(3).write.mode("append").text(place)
    run()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = [x.path for x in growing._files(place)[1]]
    store = hadoop(place).getFileSystem(spark._jsc.hadoopConfiguration())
    store.rename(hadoop(f"{place}/{os.path.basename(files[0])}"), hadoop(f"{place}/rotated.1"))
    e.where("value % 2 = 1").repartition(3).write.mode("append").text(place)
    run()
    return spark.read.schema(growing.SCHEMA).parquet(f"{base}/table").groupBy(F.col("value").cast("bigint").alias("event_id")).agg(F.count("*").alias("times"))


@query(f"SELECT event_id, strftime(date_trunc('millisecond', ts), {FMT}) AS log_time, log_level FROM {EVENTS}")
def x2_parsed_stream(spark, sf_dir):
    """Lines are parsed as they come: the container's mark goes and the rest is a line of a format."""
    out = ops.drain(ops.parsed(ops.demultiplexed(ops.tail(spark, log_files(spark, sf_dir)), r"^(c\d+) \|()\s(.*)$"), formats.FORMATS["generic_log"], "body"), folder(spark))
    return out.select(F.split("log_body", " ")[0].cast("bigint").alias("event_id"), stamp("log_time").alias("log_time"), "log_level")


@query("SELECT 'c' || (user_id % 4) AS mux_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total FROM events GROUP BY 1")
def x12_demultiplexed_stream(spark, sf_dir):
    lines = ops.demultiplexed(ops.tail(spark, log_files(spark, sf_dir)), r"^(c\d+) \|()\s(.*)$")
    out = ops.drain(lines.select("mux_id", "body"), folder(spark))
    return out.groupBy("mux_id").agg(F.count_if(F.col("body").contains(" ERROR ")).alias("errors"), F.count("*").alias("total"))


@query("SELECT DISTINCT log_path, 'generic_log' AS log_format FROM " + EVENTS)
def x7_file_lifecycle_stream(spark, sf_dir):
    """A row for each file when it is first seen."""
    target = f"{folder(spark)}/seen-{uuid.uuid4().hex}"
    ops.finish(ops.lifecycle(events(spark, sf_dir).withColumn("log_format", F.lit("generic_log")), target), folder(spark))
    return spark.read.parquet(target).select("log_path", "log_format")


@query("SELECT event_type AS watch, count(*) AS reactions FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def x11_reactions_stream(spark, sf_dir):
    """A handler that keeps a row for each watch event of a batch."""
    target = f"{folder(spark)}/reactions-{uuid.uuid4().hex}"
    rules = {"error": "event_type = 'error'", "signup": "event_type = 'signup'"}
    watched = ops.watch(events(spark, sf_dir), rules, ["event_id"])
    ops.finish(ops.react(watched, lambda batch, _: batch.select("watch").write.mode("append").parquet(target)), folder(spark))
    return spark.read.schema("watch string").parquet(target).groupBy("watch").agg(F.count("*").alias("reactions"))


@query(
    "WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) "
    "SELECT user_id, count(*) AS total FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
)
def x8_sessions_stream(spark, sf_dir):
    """Sessions that the watermark has closed; the others stay open in the state."""
    return ops.drain(ops.sessions(events(spark, sf_dir), "6 hours", "user_id").select("user_id", "total"), folder(spark))
