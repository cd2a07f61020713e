"""The library's functions under SQL names. Each is an SQL function over native expressions, so the optimizer sees through it."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, parameters, result type, body.
FUNCTIONS = (
    ("padl", "s STRING, n INT", "STRING", "lpad(s, greatest(n, length(s)), ' ')"),
    ("padr", "s STRING, n INT", "STRING", "rpad(s, greatest(n, length(s)), ' ')"),
    ("padc", "s STRING, n INT", "STRING", "rpad(concat(repeat(' ', cast(greatest(floor((n - length(s)) / 2), 0) AS INT)), s), greatest(n, length(s)), ' ')"),
    ("leftstr", "s STRING, n INT", "STRING", "left(s, n)"),
    ("rightstr", "s STRING, n INT", "STRING", "right(s, n)"),
    ("replicate", "s STRING, n INT", "STRING", "repeat(s, n)"),
    ("proper", "s STRING", "STRING", "initcap(s)"),
    ("charindex", "needle STRING, hay STRING", "INT", "locate(needle, hay)"),
    ("strfilter", "s STRING, allowed STRING", "STRING", "array_join(filter(split(s, ''), ch -> ch <> '' AND contains(allowed, ch)), '')"),
    ("square", "x DOUBLE", "DOUBLE", "x * x"),
    ("coth", "x DOUBLE", "DOUBLE", "1 / tanh(x)"),
    ("atn2", "y DOUBLE, x DOUBLE", "DOUBLE", "atan2(y, x)"),
    ("difference", "a STRING, b STRING", "INT", "cast(aggregate(sequence(1, 4), 0, (n, i) -> n + cast(substring(soundex(a), i, 1) = substring(soundex(b), i, 1) AS INT)) AS INT)"),
    ("timediff", "a STRING, b STRING", "DOUBLE", "(unix_micros(try_to_timestamp(a)) - unix_micros(try_to_timestamp(b))) / 1e6"),
    ("timeslice", "t TIMESTAMP, seconds BIGINT", "TIMESTAMP", "timestamp_micros(unix_micros(t) - pmod(unix_micros(t), seconds * 1000000))"),
    (
        "humanize_file_size",
        "n DOUBLE",
        "STRING",
        "CASE WHEN abs(n) >= 1e18 THEN format_string('%.1fEB', n / 1e18) WHEN abs(n) >= 1e15 THEN format_string('%.1fPB', n / 1e15) WHEN abs(n) >= 1e12 THEN format_string('%.1fTB', n / 1e12) "
        "WHEN abs(n) >= 1e9 THEN format_string('%.1fGB', n / 1e9) WHEN abs(n) >= 1e6 THEN format_string('%.1fMB', n / 1e6) WHEN abs(n) >= 1e3 THEN format_string('%.1fKB', n / 1e3) ELSE concat(cast(n AS BIGINT), 'B') END",
    ),
    ("spooky_hash", "s STRING", "STRING", "sha2(s, 256)"),
)


def register_all(spark: SparkSession) -> None:
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
