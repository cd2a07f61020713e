"""Time layouts of logs: found once for each file from its first lines, then the only one that the file's stamps are read by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_D, _T = r"\d{4}-\d\d-\d\d", r"\d\d:\d\d:\d\d"
_MON, _DAY = r"[A-Z][a-z]{2}", r"(?:[A-Z][a-z]{2},? )?"

# Layouts of stamps, specific ones first: a regex for the whole stamp and Spark's layout ("year" needs a
# year before it, "day" a date; "s", "ms", "us" and "ns" are epochs, "tai64n" a count of seconds and nanoseconds in hex).
LAYOUTS: tuple[tuple[str, str], ...] = (
    (rf"{_D}T{_T}\.\d{{6}}Z", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"),
    (rf"{_D}T{_T}\.\d{{3}}Z", "yyyy-MM-dd'T'HH:mm:ss.SSSX"),
    (rf"{_D}T{_T}Z", "yyyy-MM-dd'T'HH:mm:ssX"),
    (rf"{_D}T{_T}\.\d{{6}}[-+]\d\d:\d\d", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
    (rf"{_D}T{_T}\.\d{{3}}[-+]\d\d:\d\d", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
    (rf"{_D}T{_T}[-+]\d\d:\d\d", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (rf"{_D}T{_T}\.\d{{3}}[-+]\d{{4}}", "yyyy-MM-dd'T'HH:mm:ss.SSSXX"),
    (rf"{_D}T{_T}[-+]\d{{4}}", "yyyy-MM-dd'T'HH:mm:ssXX"),
    (rf"{_D}T{_T}\.\d{{6}}", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    (rf"{_D}T{_T}\.\d{{3}}", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    (rf"{_D}T{_T}", "yyyy-MM-dd'T'HH:mm:ss"),
    (rf"{_D} {_T}\.\d{{6}} [-+]\d{{4}}", "yyyy-MM-dd HH:mm:ss.SSSSSS XX"),
    (rf"{_D} {_T}\.\d{{3}} [-+]\d{{4}}", "yyyy-MM-dd HH:mm:ss.SSS XX"),
    (rf"{_D} {_T} [-+]\d{{4}}", "yyyy-MM-dd HH:mm:ss XX"),
    (rf"{_D} {_T}\.\d{{6}}", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    (rf"{_D} {_T}\.\d{{3}}", "yyyy-MM-dd HH:mm:ss.SSS"),
    (rf"{_D} {_T},\d{{3}}", "yyyy-MM-dd HH:mm:ss,SSS"),
    (rf"{_D} {_T}", "yyyy-MM-dd HH:mm:ss"),
    (rf"{_D} \d\d:\d\d", "yyyy-MM-dd HH:mm"),
    (rf"\d{{4}}/\d\d/\d\d {_T}\.\d{{6}}", "yyyy/MM/dd HH:mm:ss.SSSSSS"),
    (rf"\d{{4}}/\d\d/\d\d {_T}\.\d{{3}}", "yyyy/MM/dd HH:mm:ss.SSS"),
    (rf"\d{{4}}/\d\d/\d\d {_T}", "yyyy/MM/dd HH:mm:ss"),
    (rf"\d\d/{_MON}/\d{{4}}:{_T} [-+]\d{{4}}", "dd/MMM/yyyy:HH:mm:ss XX"),
    (rf"\d\d/{_MON}/\d{{4}}:{_T}", "dd/MMM/yyyy:HH:mm:ss"),
    (rf"\d\d/\d\d/\d{{4}} {_T}", "MM/dd/yyyy HH:mm:ss"),
    (rf"\d\d\.\d\d\.\d{{4}} {_T}", "dd.MM.yyyy HH:mm:ss"),
    (rf"{_DAY}\d{{1,2}} {_MON} \d{{4}} {_T}\.\d{{3}}", "d MMM yyyy HH:mm:ss.SSS"),
    (rf"{_DAY}\d{{1,2}} {_MON} \d{{4}} {_T} [-+]\d{{4}}", "d MMM yyyy HH:mm:ss XX"),
    (rf"{_DAY}\d{{1,2}} {_MON} \d{{4}} {_T}", "d MMM yyyy HH:mm:ss"),
    (rf"{_DAY}{_MON} \d{{1,2}} {_T}\.\d{{6}} \d{{4}}", "MMM d HH:mm:ss.SSSSSS yyyy"),
    (rf"{_DAY}{_MON} \d{{1,2}} {_T} \d{{4}}", "MMM d HH:mm:ss yyyy"),
    (rf"{_DAY}{_MON} \d{{1,2}} \d{{4}} {_T}", "MMM d yyyy HH:mm:ss"),
    (rf"{_MON} \d{{1,2}} {_T}\.\d{{6}}", "year MMM d HH:mm:ss.SSSSSS"),
    (rf"{_MON} \d{{1,2}} {_T}\.\d{{3}}", "year MMM d HH:mm:ss.SSS"),
    (rf"{_MON} \d{{1,2}} {_T}", "year MMM d HH:mm:ss"),
    (rf"{_MON}-\d\d {_T}\.\d{{3}}", "year MMM-dd HH:mm:ss.SSS"),
    (rf"\d\d-\d\d {_T}\.\d{{3}}", "year MM-dd HH:mm:ss.SSS"),
    (rf"\d{{4}} {_T}\.\d{{6}}", "year MMdd HH:mm:ss.SSSSSS"),
    (r"\d{8}T\d{6}Z", "yyyyMMdd'T'HHmmssX"),
    (r"\d{8} \d{6}", "yyyyMMdd HHmmss"),
    (rf"{_T}\.\d{{6}}", "day HH:mm:ss.SSSSSS"),
    (rf"{_T}\.\d{{3}}", "day HH:mm:ss.SSS"),
    (_T, "day HH:mm:ss"),
    (r"@[0-9a-f]{24}", "tai64n"),
    (r"\d{19}", "ns"),
    (r"\d{16}", "us"),
    (r"\d{13}", "ms"),
    (r"\d{10}(?:\.\d+)?", "s"),
)

_EPOCHS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def _clean(stamp: Column) -> Column:
    return F.regexp_replace(F.trim(stamp), r" +", " ")


def read_time(stamp: Column, layout: str, year: int = 1970, day: str = "1970-01-01") -> Column:
    """A stamp by one of the layouts; null where it doesn't fit."""
    s = _clean(stamp)
    if layout == "ns":
        return F.timestamp_micros((s.try_cast("decimal(20,0)") / 1000).cast("bigint"))
    if layout == "tai64n":  # 2**62 + 10 seconds before the epoch's own count
        seconds = F.conv(F.substring(s, 3, 15), 16, 10).cast("bigint") - 10
        return F.timestamp_micros(seconds * 1_000_000 + (F.conv(F.substring(s, 18, 8), 16, 10).cast("bigint") / 1000).cast("bigint"))
    if layout in _EPOCHS:
        return F.timestamp_micros((s.try_cast("decimal(28,6)") * _EPOCHS[layout]).cast("bigint"))
    if layout.startswith(("d ", "MMM d")):  # a weekday goes
        s = F.regexp_replace(s, r"^[A-Z][a-z]{2},? (?=\d|[A-Z][a-z]{2} )", "")
    if layout.startswith("year "):
        s, layout = F.concat(F.lit(f"{year} "), s), f"yyyy {layout[5:]}"
    elif layout.startswith("day "):
        s, layout = F.concat(F.lit(f"{day} "), s), f"yyyy-MM-dd {layout[4:]}"
    return F.try_to_timestamp(s, F.lit(layout))


def layouts_of(lines: DataFrame, stamp: str, path: str = "log_path", number: str = "file_line", sample: int = 1000) -> DataFrame:
    """(path, layout): for each file the layout that most stamps of its first lines have; the first listed wins ties."""
    head = lines.where(F.col(number) < sample).withColumn("_s", _clean(F.col(stamp)))
    counts = head.groupBy(path).agg(*(F.count_if(F.col("_s").rlike(f"^(?:{p})$")).alias(f"_{i}") for i, (p, _) in enumerate(LAYOUTS)))
    scored = F.array(*(F.struct(F.col(f"_{i}").alias("hits"), F.lit(-i).alias("rank"), F.lit(layout).alias("layout")) for i, (_, layout) in enumerate(LAYOUTS)))
    return counts.select(path, F.array_max(scored).alias("_b")).where(F.col("_b.hits") > 0).select(path, F.col("_b.layout").alias("layout"))


def read_times(lines: DataFrame, stamp: str, path: str = "log_path", number: str = "file_line", year: int = 1970, day: str = "1970-01-01") -> DataFrame:
    """lines with log_time and layout. Only the layouts that some file has are tried, each on its own files' stamps."""
    chosen = layouts_of(lines, stamp, path, number)
    used = sorted(r["layout"] for r in chosen.select("layout").distinct().collect())  # as many as there are layouts, at most
    time = F.lit(None).cast("timestamp")
    for layout in used:
        time = F.when(F.col("layout") == layout, read_time(F.col(stamp), layout, year, day)).otherwise(time)
    return lines.join(chosen, path, "left").withColumn("log_time", time)
