"""Streams whose answer depends on the order of a file's lines, worked off batch by batch with the batch operators.

A stateful function gets a key's rows of a batch in whatever order they come, in frames, and in one task. Here each batch
is a table instead: it is put together with what earlier batches left open, the operators for tables (carry() and its
blocks) do the work however many rows a file has, and what stays open is written for the next batch. Tables of state and
results are written under the batch's number, so a batch that is run again after a failure overwrites its own results
and nothing is counted twice. What is known of a file (its last line and time, its format) is a row a file and is broadcast:
a join by path would bring all of a file's lines into one task.

`hold`: lines may come out of order across batches. A file's lines are kept back until the file has shown a time so much
later, and are then worked off in line order; a line that comes after later ones of its file were given out is marked
(late_line) and treated on its own, as each function says. Without hold the lines of a batch are given out with it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.operators.carry import carry
from strandlog.operators.shared import kept
from strandlog.sources import formats, json_formats

Tables = dict[str, DataFrame]
#: (rows of the batch, tables of state, whether it is the end) to (rows given out, tables of state).
Step = Callable[[DataFrame, Tables, bool], tuple[DataFrame, Tables]]


class Batches:
    """Runs a step over a stream's batches. base: a folder of its own, which a restarted stream must be given again."""

    def __init__(self, spark: SparkSession, base: str, step: Step, state: Mapping[str, T.StructType], out: T.StructType):
        self.spark, self.base, self.step, self.state, self.out = spark, base.rstrip("/"), step, dict(state), out

    def _before(self, batch: int) -> Tables:
        if batch == 0:
            return {name: self.spark.createDataFrame([], schema) for name, schema in self.state.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.base}/state/{batch - 1}/{name}") for name, schema in self.state.items()}

    def run(self, rows: DataFrame, batch: int, end: bool = False) -> None:
        given, state = self.step(rows, self._before(batch), end)
        for name, schema in self.state.items():
            state[name].select(schema.names).write.mode("overwrite").parquet(f"{self.base}/state/{batch}/{name}")
        given.select(self.out.names).write.mode("overwrite").parquet(f"{self.base}/table/batch={batch}")

    def start(self, stream: DataFrame, **trigger):
        writer = stream.writeStream.foreachBatch(self.run).option("checkpointLocation", f"{self.base}/checkpoint")
        return writer.trigger(**trigger).start()

    def table(self) -> DataFrame:
        """What was given out so far."""
        return self.spark.read.schema(self.out).parquet(f"{self.base}/table/batch=*")

    def drained(self, stream: DataFrame, end: bool = True) -> DataFrame:
        """Everything that is there now, run through; end: what is still open is given out as well, once and for all."""
        query = self.start(stream, availableNow=True)
        query.awaitTermination()
        if end:
            seen = query.lastProgress
            last = seen.batchId if seen is not None else -1
            self.run(self.spark.createDataFrame([], stream.schema), self._next(last), True)
        return self.table()

    def _next(self, last: int) -> int:
        """The number after the last batch that has state: a trigger without data has a number and no batch."""
        while last >= 0 and not exists(self.spark, f"{self.base}/state/{last}"):
            last -= 1
        return last + 1


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _released(rows: DataFrame, path: str, line: str, time: str, hold: str | None, end: bool) -> tuple[DataFrame, DataFrame]:
    """The rows that can be given out, and those that are kept back."""
    if hold is None or end:
        return rows, rows.limit(0)
    newest = rows.groupBy(path).agg(F.max(time).alias("_newest"))
    old = rows.join(F.broadcast(newest), path).where(F.col(time) <= F.col("_newest") - F.expr(f"INTERVAL {hold}"))
    marked = rows.join(F.broadcast(old.groupBy(path).agg(F.max(line).alias("_until"))), path, "left")
    ready = F.coalesce(F.col(line) <= F.col("_until"), F.lit(False))
    return marked.where(ready).drop("_until"), marked.where(~ready).drop("_until")


def repaired(stream: DataFrame, base: str, hold: str | None = None, time: str = "log_time", path: str = "log_path", line: str = "file_line") -> Batches:
    """repair_skew() of a stream: a message earlier than one before it in its file takes the file's latest time so far.

    The rows get log_actual_time, time_skewed and late_line. A late line takes the latest time that its file had given
    out, and changes nothing for others.
    """
    spark, own = stream.sparkSession, [c for c in stream.columns if c not in ("log_actual_time", "time_skewed", "late_line")]
    fields = stream.select(own).schema
    heads = T.StructType([fields[path], T.StructField("_line", T.LongType()), T.StructField("_top", fields[time].dataType)])
    out = T.StructType([*fields, T.StructField("log_actual_time", fields[time].dataType), T.StructField("time_skewed", T.BooleanType()), T.StructField("late_line", T.BooleanType())])

    def step(batch: DataFrame, state: Tables, end: bool) -> tuple[DataFrame, Tables]:
        rows = state["held"].unionByName(batch.select(own)).join(F.broadcast(state["heads"]), path, "left")
        is_late = F.coalesce(F.col(line) <= F.col("_line"), F.lit(False))
        late, rest = rows.where(is_late), rows.where(~is_late)
        ready, held = _released(rest, path, line, time, hold, end)
        new = ready.groupBy(path).agg(F.max(line).cast("long").alias("_line"), F.greatest(F.max(time), F.max("_top")).alias("_top"))
        ready = carry(ready, [path], line, _run=("max", F.col(time))).withColumn("_run", F.greatest("_run", "_top"))
        done = ready.withColumn("late_line", F.lit(False)).unionByName(late.withColumn("_run", F.greatest(time, "_top")).withColumn("late_line", F.lit(True)))
        tops = state["heads"].unionByName(new).groupBy(path).agg(F.max("_line").alias("_line"), F.max("_top").alias("_top"))
        skewed = F.coalesce(F.col("_run") > F.col(time), F.lit(False))
        done = done.withColumn("log_actual_time", F.col(time)).withColumn("time_skewed", skewed).withColumn(time, F.coalesce("_run", time))
        return done, {"heads": tops, "held": held}

    return Batches(spark, base, step, {"heads": heads, "held": fields}, out)


def assembled(stream: DataFrame, base: str, is_start: Column, path: str = "log_path", line: str = "file_line", value: str = "value") -> Batches:
    """messages.assemble() of a stream: start lines with the lines after them, across batches; a line before a file's
    first start is a message of its own.

    A file's last message stays open until its next start line or the end. A line that comes after a later message of its
    file was begun is given out alone, marked late_line.
    """
    from strandlog.operators.messages import assemble

    fields = stream.select(path, line, value).schema
    out = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("late_line", T.BooleanType())])

    def step(batch: DataFrame, state: Tables, end: bool) -> tuple[DataFrame, Tables]:
        opened = state["held"].groupBy(path).agg(F.min(line).alias("_open"))
        new = batch.select(path, line, value).join(F.broadcast(opened), path, "left")
        is_late = F.coalesce(F.col(line) < F.col("_open"), F.lit(False))
        rows = state["held"].unionByName(new.where(~is_late).drop("_open"))
        starts = F.coalesce(is_start, F.lit(False))
        numbered = carry(rows.withColumn("_start", starts), [path], line, _message=("sum", F.col("_start").cast("bigint")))
        last = numbered.groupBy(path).agg(F.max("_message").alias("_last"))
        marked = numbered.join(F.broadcast(last), path)
        stays = (F.col("_message") == F.col("_last")) & (F.col("_last") > 0) & F.lit(not end)
        done = assemble(marked.where(~stays).select(path, line, value), starts, path, line, value).withColumn("late_line", F.lit(False))
        late = new.where(is_late).select(path, line, value, F.lit(1).cast("long").alias("n_lines"), F.lit(True).alias("late_line"))
        return done.unionByName(late), {"held": marked.where(stays).select(path, line, value)}

    return Batches(stream.sparkSession, base, step, {"held": fields}, out)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


TEXT = T.StringType()
LINE = _fields(log_path=TEXT, file_line=T.LongType(), value=TEXT)
MESSAGE = _fields(log_path=TEXT, file_line=T.LongType(), log_format=TEXT, log_time=T.TimestampType(), log_level=TEXT, log_body=TEXT)


def parsed_as(lines: DataFrame, names: list[str], catalogue: Mapping[str, object], year: int = 1970) -> DataFrame:
    """The messages of lines (log_path, file_line, value, log_format), each parsed by its own format."""
    out = lines.sparkSession.createDataFrame([], MESSAGE)
    for name in names:
        fmt, rows = catalogue[name], lines.where(F.col("log_format") == name).drop("log_format")
        found = json_formats.parse_json_format(rows, fmt, "value") if isinstance(fmt, json_formats.JsonFormat) else formats.parse(rows, fmt, "value", year)
        out = out.unionByName(found.withColumn("log_format", F.lit(name)).select(*(F.col(f.name).cast(f.dataType) for f in MESSAGE)))
    return out


def recognized(stream: DataFrame, base: str, catalogue: Mapping[str, object] | None = None, sample: int = 1000, year: int = 1970) -> Batches:
    """detect() and parse() of a stream of lines (log_path, file_line, value) of mixed files.

    A file's lines are kept back until its first `sample` lines are there, or the end; then the format that most of them
    match is fixed for the file, and it and all later lines are parsed by it. Lines of files of no format are given up.
    """
    known = formats.catalogue() if catalogue is None else dict(catalogue)
    locks = _fields(log_path=TEXT, log_format=TEXT)

    def step(batch: DataFrame, state: Tables, end: bool) -> tuple[DataFrame, Tables]:
        new = batch.select(*(F.col(f.name).cast(f.dataType) for f in LINE))
        free = state["held"].unionByName(new.join(F.broadcast(state["locks"]), "log_path", "left_anti"))
        seen = free.where(F.col("file_line") < sample).groupBy("log_path").agg(F.count_distinct("file_line").alias("n"))
        ripe = free.select("log_path").distinct() if end else seen.where(F.col("n") >= sample).select("log_path")
        ready = free.join(F.broadcast(ripe), "log_path", "left_semi")
        fixed = kept(state["locks"].unionByName(formats.detect(ready, known, sample=sample).select("log_path", "log_format")))
        due = ready.unionByName(new.join(F.broadcast(state["locks"]), "log_path", "left_semi")).join(F.broadcast(fixed), "log_path")
        names = [x.log_format for x in fixed.select("log_format").distinct().collect() if x.log_format]  # as many as the catalogue has
        return parsed_as(due, sorted(names), known, year), {"held": free.join(F.broadcast(ripe), "log_path", "left_anti"), "locks": fixed}

    return Batches(stream.sparkSession, base, step, {"held": LINE, "locks": locks}, MESSAGE)
