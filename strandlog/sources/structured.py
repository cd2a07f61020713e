"""Self-describing logs: JSON lines, logfmt, Zeek, W3C extended, OTLP exports; raw lines and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.operators.carry import carry

ANSI = r"\x1B\[[0-9;?]*[A-Za-z]"


def numbered_lines(lines: DataFrame, path: str = "log_path", line: str = "file_line") -> DataFrame:
    """Lines whose numbers are byte offsets (see sources/growing.py) with numbers from 0 in their place, worked off in blocks."""
    return carry(lines, [path], line, _n=("sum", F.lit(1))).withColumn(line, F.col("_n") - 1).drop("_n")


def scrub_ansi(text: Column | str) -> Column:
    return F.regexp_replace(text, ANSI, "")


def parse_json(lines: DataFrame, schema: T.StructType | str, time: str, level: str | None = None, divisor: int | None = None, line: str = "value") -> DataFrame:
    """JSON lines: the schema's fields, log_time (text or epoch over divisor), log_level, and the other fields as a map."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    everything = F.from_json(line, "map<string,string>")
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    rows = lines.withColumn("_j", F.from_json(line, schema)).withColumn("_all", everything).where(F.col("_all").isNotNull())
    stamp = F.col(f"_j.{time}")
    log_time = F.timestamp_micros((stamp.cast("double") * (1_000_000 / divisor)).cast("bigint")) if divisor else F.try_to_timestamp(stamp)
    out = rows.select("*", "_j.*").withColumn("log_time", log_time)
    if level:
        out = out.withColumn("log_level", F.lower(F.col(f"_j.{level}").cast("string")))
    return out.withColumn("extras", F.map_filter("_all", lambda k, v: ~F.array_contains(known, k))).drop("_j", "_all")


def parse_logfmt(lines: DataFrame, line: str = "value") -> DataFrame:
    """fields: key=value pairs with quotes taken off; log_time, log_level and log_body from the usual keys."""
    keys = F.regexp_extract_all(line, F.lit(r'([^\s="]+)=("(?:[^"\\]|\\.)*"|\S*)'), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(r'([^\s="]+)=("(?:[^"\\]|\\.)*"|\S*)'), F.lit(2))
    plain = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r'^"(.*)"$', "$1"), r'\\(["\\])', "$1"))
    pairs = F.arrays_zip(keys.alias("k"), plain.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["k"]))
    rows = lines.withColumn("fields", F.map_from_entries(last)).where(F.size("fields") > 0)
    first = lambda *names: F.coalesce(*(F.try_element_at("fields", F.lit(n)) for n in names))
    return rows.withColumns({"log_time": F.try_to_timestamp(first("time", "ts", "timestamp")), "log_level": F.lower(first("level", "lvl")), "log_body": first("msg", "message")})


def parse_zeek(lines: DataFrame, path: str = "log_path", number: str = "file_line", line: str = "value") -> DataFrame:
    """Rows of Zeek logs with `fields`: a map by the #fields in force; unset and empty markers are null."""
    text = F.col(line)
    header = F.when(text.startswith("#fields"), F.regexp_replace(text, r"^#fields\s", ""))
    rows = carry(lines, [path], number, _fields=("last", header)).where(~text.startswith("#") & (text != ""))
    values = F.transform(F.split(text, "\t"), lambda v: F.when(~v.isin("-", "(empty)"), v))
    names = F.transform(F.split("_fields", "\t"), lambda n: F.concat(F.lit("bro_"), F.regexp_replace(n, r"\.", "_")))
    return rows.where(F.size(names) == F.size(values)).withColumn("fields", F.map_from_arrays(names, values)).drop("_fields")


def parse_w3c(lines: DataFrame, path: str = "log_path", number: str = "file_line", line: str = "value") -> DataFrame:
    """Rows of W3C extended logs with `fields` by the directive in force and log_time; #Date gives the day of time-only rows."""
    text = F.col(line)
    fields = F.when(text.startswith("#Fields:"), F.trim(F.regexp_replace(text, r"^#Fields:", "")))
    day = F.when(text.startswith("#Date:"), F.regexp_extract(text, r"(\d{4}-\d\d-\d\d)", 1))
    rows = carry(lines, [path], number, _fields=("last", fields), _day=("last", day)).where(~text.startswith("#") & (text != ""))
    values = F.transform(F.regexp_extract_all(text, F.lit(r'("[^"]*"|\S+)'), F.lit(1)), lambda v: F.when(v != "-", F.regexp_replace(v, r'^"(.*)"$', "$1")))
    names = F.split("_fields", r"\s+")
    rows = rows.where(F.size(names) == F.size(values)).withColumn("fields", F.map_from_arrays(names, values))
    date = F.coalesce(F.try_element_at("fields", F.lit("date")), F.col("_day"))
    return rows.withColumn("log_time", F.try_to_timestamp(F.concat_ws(" ", date, F.try_element_at("fields", F.lit("time"))))).drop("_fields", "_day")


_ATTRIBUTE = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
OTLP = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTE}>,scopeLogs:array<struct<scope:struct<name:string>,"
    f"logRecords:array<struct<timeUnixNano:string,severityText:string,body:struct<stringValue:string>,attributes:{_ATTRIBUTE}>>>>>>"
)


def shred_otlp(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row for each log record of OTLP exports: log_time, log_level, log_body, resource and attributes as maps."""
    as_map = lambda x: F.map_from_entries(F.transform(F.coalesce(x, F.array()), lambda a: F.struct(a["key"], F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value"))))
    rows = lines.select(F.explode(F.from_json(line, OTLP)["resourceLogs"]).alias("r"))
    rows = rows.select(as_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    rows = rows.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("m"))
    return rows.select(
        F.timestamp_micros(F.expr("cast(m.timeUnixNano AS bigint) div 1000")).alias("log_time"),
        F.lower("m.severityText").alias("log_level"),
        F.col("m.body.stringValue").alias("log_body"),
        "scope",
        "resource",
        as_map(F.col("m.attributes")).alias("attributes"),
    )


def inventory(messages: DataFrame, path: str = "log_path") -> DataFrame:
    """One row for each file: lines, formats, first and last time, and a hash of its first message."""
    return messages.groupBy(path).agg(
        F.count("*").alias("lines"),
        F.min("log_time").alias("first_time"),
        F.max("log_time").alias("last_time"),
        F.array_sort(F.collect_set("log_format")).alias("formats"),
        F.sha2(F.min_by("value", "file_line"), 256).alias("content_id"),
    )


def without_duplicate_files(messages: DataFrame, path: str = "log_path") -> DataFrame:
    """Of files whose first lines are equal only the one of least path."""
    first = messages.groupBy(path).agg(F.sha2(F.min_by("value", "file_line"), 256).alias("_id"))
    keep = first.groupBy("_id").agg(F.min(path).alias(path)).select(path)
    return messages.join(keep, path, "left_semi")


def fstat(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime", "content")


def attach(spark: SparkSession, name: str, tables: dict[str, str], source: str = "parquet", **options: str) -> None:
    """Tables of another store as views `name`_`table`, to be joined with the session's. tables: each one's path.

    source "jdbc": a database whose driver is on the class path; tables then gives each one's name there.
    """
    for table, place in tables.items():
        reader = spark.read.format(source).options(**options)
        frame = reader.option("dbtable", place).load() if source == "jdbc" else reader.load(place)
        frame.createOrReplaceTempView(f"{name}_{table}")
