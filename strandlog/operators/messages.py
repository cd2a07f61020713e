"""Operators on the lines and messages of logs: assembly, repair, ids, tags, partitions, metadata, filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.text import LEVELS, c, level_ordinal
from strandlog.operators.carry import carry, near_rows, numbered, previous

PATH, LINE = "log_path", "file_line"


def assemble(lines: DataFrame, is_start: Column, path: str = PATH, line: str = LINE, value: str = "value") -> DataFrame:
    """(path, line, value, n_lines): start lines with their continuation lines; a line before a file's first start is a message of its own."""
    rows = carry(lines.withColumn("_start", is_start), [path], line, _message=("sum", F.col("_start").cast("bigint")))
    out = rows.groupBy(path, "_message", F.when(F.col("_message") == 0, F.col(line)).alias("_alone")).agg(F.min(line).alias(line), F.array_sort(F.collect_list(F.struct(line, value))).alias("_parts"))
    return out.select(path, line, F.array_join(F.transform("_parts", lambda p: p[value]), "\n").alias(value), F.size("_parts").cast("bigint").alias("n_lines"))


def repair_skew(messages: DataFrame, time: str = "log_time", path: str = PATH, line: str = LINE) -> DataFrame:
    """A message earlier than one before it in its file takes the latest time so far: log_actual_time, time_skewed tell."""
    rows = carry(messages.withColumn("log_actual_time", F.col(time)), [path], line, _latest=("max", F.col(time)))
    return rows.withColumn("time_skewed", F.coalesce(F.col("_latest") > F.col(time), F.lit(False))).withColumn(time, F.coalesce("_latest", time)).drop("_latest")


def repair_rollover(messages: DataFrame, months: int = 12, back_seconds: int = 86_400, time: str = "log_time", path: str = PATH, line: str = LINE) -> DataFrame:
    """Times without a year: where time jumps back by a day or more, all earlier rows belong a year earlier."""
    rows = previous(messages, [path], line, time, "_before")
    jump = F.coalesce((F.unix_micros(F.col("_before").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) >= back_seconds * 1_000_000, F.lit(False))
    rows = carry(rows, [path], line, _jumps=("sum", jump.cast("bigint")))
    last = rows.groupBy(path).agg(F.max("_jumps").alias("_all"))
    shifted = F.add_months(F.to_date(time), ((F.col("_jumps") - F.col("_all")) * months).cast("int"))
    moved = F.to_timestamp(F.concat(shifted.cast("string"), F.date_format(time, " HH:mm:ss.SSSSSS")))
    return rows.join(last, path).withColumn(time, moved).drop("_jumps", "_all", "_before")


def offset_files(messages: DataFrame, options: DataFrame, time: str = "log_time", path: str = PATH) -> DataFrame:
    """options: (prefix, zone, offset_ms). A file takes those of the longest prefix of its path; zone: of zoneless stamps."""
    files = messages.select(path).distinct()
    of = files.join(options, F.col(path).startswith(F.col("prefix"))).groupBy(path).agg(F.max_by(F.struct("zone", "offset_ms"), F.length("prefix")).alias("_o"))
    moved = F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(time, F.coalesce("_o.zone", F.lit("UTC")))) + F.coalesce("_o.offset_ms", F.lit(0)) * 1000)
    return messages.join(of, path, "left").withColumn(time, moved).drop("_o")


def idle(messages: DataFrame, time: str = "log_time", path: str = PATH, line: str = LINE, key: list[str] | None = None) -> DataFrame:
    """log_idle_msecs: time since the message before, 0 for the first, in the order of lines within the key."""
    rows = previous(messages, key or [path], line, time, "_before")
    gap = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / 1000)
    return rows.withColumn("log_idle_msecs", F.coalesce(gap, F.lit(0))).drop("_before")


def tag(messages: DataFrame, rules: Mapping[str, str], body: str = "log_body") -> DataFrame:
    """log_tags: the names of the rules whose regex the body matches."""
    found = F.array(*(F.when(F.col(body).rlike(p), F.lit(n)) for n, p in rules.items()))
    return messages.withColumn("log_tags", F.filter(found, lambda x: x.isNotNull()))


def partition(messages: DataFrame, starts: Column, key: list[str], line: str) -> DataFrame:
    """log_part: the last name that `starts` gave (null where no partition starts) at or before a message."""
    return carry(messages, key, line, log_part=("last", starts))


def demultiplex(lines: DataFrame, pattern: str, value: str = "value") -> DataFrame:
    """pattern has three groups: mux_id, timestamp (may be empty), body. Lines that don't match are control lines and go."""
    part = lambda i: F.nullif(F.regexp_extract(value, pattern, i), F.lit(""))
    return lines.where(F.col(value).rlike(pattern)).select("*", part(1).alias("mux_id"), part(2).alias("mux_time"), F.regexp_extract(value, pattern, 3).alias("body"))


def demultiplex_json(lines: DataFrame, mux: str, body: str, value: str = "value", time: str | None = None) -> DataFrame:
    """mux_id, mux_time and body from members of JSON lines; a body's last line end goes, and so do lines without a mux_id."""
    j = F.from_json(value, "map<string,string>")
    at = lambda name: F.try_element_at(j, F.lit(name)) if name else F.lit(None).cast("string")
    out = lines.select("*", at(mux).alias("mux_id"), at(time).alias("mux_time"), F.regexp_replace(at(body), r"\r?\n$", "").alias("body"))
    return out.where(F.col("mux_id").isNotNull())


def filter_rows(messages: DataFrame, rules: Sequence[tuple[int, str, str]], body: str = "log_body", drop: bool = True) -> DataFrame:
    """rules: (id, "in" or "out", regex). A row stays if an in rule matches, or there are none, and no out rule does. log_filters: ids that matched."""
    hit = {i: F.coalesce(F.col(body).rlike(p), F.lit(False)) for i, _, p in rules}
    ins, outs = [hit[i] for i, kind, _ in rules if kind == "in"], [hit[i] for i, kind, _ in rules if kind == "out"]
    wanted, barred = F.lit(not ins), F.lit(False)
    for h in ins:
        wanted = wanted | h
    for h in outs:
        barred = barred | h
    ids = F.filter(F.array(*(F.when(h, F.lit(i)) for i, h in hit.items())), lambda x: x.isNotNull()) if rules else F.array().cast("array<int>")
    rows = messages.withColumn("log_filters", ids)
    return rows.where(wanted & ~barred) if drop else rows.withColumn("visible", wanted & ~barred)


def filter_statistics(messages: DataFrame, rules: Sequence[tuple[int, str, str]], body: str = "log_body") -> DataFrame:
    """(filter_id, kind, pattern, hits): one pass over the messages."""
    totals = messages.agg(F.array(*(F.struct(F.lit(i).alias("filter_id"), F.lit(k).alias("kind"), F.lit(p).alias("pattern"), F.count_if(F.col(body).rlike(p)).alias("hits")) for i, k, p in rules)).alias("x"))
    return totals.select(F.inline("x"))


def filter_expr(messages: DataFrame, text: str) -> DataFrame:
    """A condition over the columns, written as :name."""
    import re

    return messages.where(F.expr(re.sub(r"(?<![:\w]):([A-Za-z_]\w*)", r"`\1`", text)))


def mark_expr(messages: DataFrame, text: str) -> DataFrame:
    return messages.withColumn("log_mark", F.coalesce(F.expr(text).cast("boolean"), F.lit(False)))


def at_least(messages: DataFrame, level: str, column: str = "log_level") -> DataFrame:
    return messages.where(level_ordinal(column) >= LEVELS.index(level))


def between(messages: DataFrame, after: str | None = None, before: str | None = None, time: str = "log_time", now: Column | None = None) -> DataFrame:
    """Messages from `after` to `before`, both included; either may be relative to `now` (see relative_time)."""
    at = lambda text: relative_time(text, now) if now is not None else F.lit(text).cast("timestamp")
    out = messages.where(F.col(time) >= at(after)) if after else messages
    return out.where(F.col(time) <= at(before)) if before else out


def relative_time(text: str, now: Column) -> Column:
    """A time before or after `now`: "-15m", "+1h30m", "2d ago", "today", "yesterday", "now"; anything else is an absolute time."""
    import re

    words = {"now": now, "today": F.date_trunc("day", now), "yesterday": F.date_trunc("day", now) - F.expr("INTERVAL 1 DAY"), "tomorrow": F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY")}
    text = text.strip().lower()
    if text in words:
        return words[text]
    m = re.fullmatch(r"([-+]?)((?:\d+\s*[a-z]+\s*)+?)(ago)?", text)
    units = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86_400 * 10**6, "w": 7 * 86_400 * 10**6}
    parts = re.findall(r"(\d+)\s*(us|ms|s|m|h|d|w)[a-z]*", m[2]) if m else []
    if not parts:
        return F.to_timestamp(F.lit(text))
    micros = sum(int(n) * units[u] for n, u in parts) * (-1 if m[1] == "-" or m[3] else 1)
    return F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + F.lit(micros))


def of_files(messages: DataFrame, paths: Sequence[str], path: str = PATH) -> DataFrame:
    """The messages of the files whose path is, or as a glob matches, one of these."""
    return messages.where(F.col(path).rlike("|".join(glob_regex(p) for p in paths))) if paths else messages.where(F.lit(False))


def hide_fields(messages: DataFrame, hidden: Sequence[str]) -> DataFrame:
    return messages.drop(*hidden)


def show_fields(messages: DataFrame, shown: Sequence[str]) -> DataFrame:
    """Only these columns, in the messages' order."""
    return messages.select(*(x for x in messages.columns if x in shown))


def glob_regex(pattern: str) -> str:
    """A GLOB pattern as an anchored regex."""
    import re

    out = "".join({"*": ".*", "?": "."}.get(x, x if x.startswith("[") else re.escape(x)) for x in re.findall(r"\[[^\]]+\]|.", pattern))
    return f"(?s)^{out}$"


def write_back(messages: DataFrame, changes: DataFrame, key: list[str], columns: list[str], order: str) -> DataFrame:
    """Metadata as a side table: the latest change (by `order`) of each message sets its columns, which it need not have."""
    latest = changes.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    out = messages.join(latest, key, "left")
    for x in columns:
        old = F.col(x) if x in messages.columns else F.lit(None)
        out = out.withColumn(x, F.when(F.col("_new").isNotNull(), F.col(f"_new.{x}")).otherwise(old))
    return out.drop("_new")


def following(messages: DataFrame, key: list[str], order: list[str], name: str, value: Column, rows: int) -> DataFrame:
    """`name`: the values (not null) of the next so many rows of the key: a join on a range of lines without a join.

    order makes a key's rows unique. A key's rows are worked off in blocks.
    """
    w = Window.partitionBy(*key, "_block").orderBy("_n").rowsBetween(1, rows)
    out = near_rows(messages.withColumn("_v", value), key, order, after=rows).withColumn(name, F.collect_list("_v").over(w))
    return out.where("_own").drop("_v", "_n", "_block", "_own")


def next_match(messages: DataFrame, key: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """`name`: the first value that isn't null in the rows after this one, carried back from block to block."""
    rows = numbered(messages.withColumn("_v", value), [*key, *order], "_n").withColumn("_back", -F.col("_n"))
    rows = carry(rows, key, "_back", _next=("last", F.col("_v")))
    return previous(rows, key, "_back", "_next", name).drop("_v", "_n", "_back", "_next")


def level_counts() -> list[Column]:
    o = level_ordinal("log_level")
    return [
        F.count("*").alias("total"),
        F.count_if(o.between(LEVELS.index("error"), LEVELS.index("fatal"))).alias("errors"),
        F.count_if(o == LEVELS.index("warning")).alias("warnings"),
    ]


def operations(messages: DataFrame, opid: str = "log_opid", description: str | None = None, time: str = "log_time") -> DataFrame:
    """One row for each operation or thread: earliest, latest, duration in microseconds, counts, the earliest description."""
    extra = [F.min_by(description, time).alias("description")] if description else []
    out = messages.where(c(opid).isNotNull()).groupBy(opid).agg(F.min(time).alias("earliest"), F.max(time).alias("latest"), *level_counts(), *extra)
    return out.withColumn("duration", F.unix_micros(F.col("latest").cast("timestamp")) - F.unix_micros(F.col("earliest").cast("timestamp")))
