"""Aggregates, histograms, reports, templates and other analyses over messages or any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.text import c, humanize_duration, level_ordinal
from strandlog.operators.carry import near_rows, numbered, previous

# -- aggregates ------------------------------------------------------------------


def total(x: Column | str) -> Column:
    return F.coalesce(F.sum(c(x).cast("double")), F.lit(0.0))


def stdev(x: Column | str) -> Column:
    """Sample standard deviation; 0.0 of one value."""
    return F.when(F.count(c(x)) <= 1, 0.0).otherwise(F.stddev_samp(c(x)))


def variance(x: Column | str) -> Column:
    return F.when(F.count(c(x)) <= 1, 0.0).otherwise(F.var_samp(c(x)))


def mode_of(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; null where the first place is shared."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    tops = counts.groupBy(*keys, "_n").agg(F.count("*").alias("_ties"), F.min(value).alias("_v"))
    best = tops.groupBy(*keys).agg(F.max(F.struct("_n", "_ties", "_v")).alias("_b"))
    return best.select(*keys, F.when(F.col("_b._ties") == 1, F.col("_b._v")).alias(name))


def quantiles_of(df: DataFrame, keys: list[str], value: str, **cuts: tuple[int, int]) -> DataFrame:
    """Exact cuts (numerator, denominator) of each group: where a cut falls between two values, their mean.

    Values are counted first, so running sums go over distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = counts.select("*", F.sum("_n").over(w).alias("_to"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    aggs = []
    for name, (a, b) in cuts.items():
        low, high = F.col("_to") * b >= F.col("_all") * a, F.col("_to") * b > F.col("_all") * a
        before = F.col("_to") - F.col("_n")
        hit = (low & (before * b < F.col("_all") * a)) | (high & (before * b <= F.col("_all") * a))
        aggs.append(F.avg(F.when(hit, F.col(value))).alias(name))
    return run.groupBy(*keys).agg(*aggs)


def object_of(df: DataFrame, keys: list[str], name: str, key: str, value: Column) -> DataFrame:
    """A JSON object for each group from one aggregated value for each key; null keys go."""
    parts = df.where(F.col(key).isNotNull()).groupBy(*keys, key).agg(value.alias("_v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col("_v").alias("v"))))
    return parts.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias(name))


def object_group(df: DataFrame, keys: list[str], name: str, key: str, value: str) -> DataFrame:
    """A JSON object of key and value for each group, the keys in order; null keys go, a key that repeats keeps its greatest value."""
    from strandlog.functions.json_text import value as variant

    parts = df.where(F.col(key).isNotNull()).groupBy(*keys, F.col(key).cast("string").alias("_k")).agg(F.max(value).alias("_v"))
    entries = F.collect_list(F.struct("_k", "_v"))
    pairs = F.transform(F.array_sort(entries), lambda e: F.struct(e["_k"], variant(e["_v"])))
    return parts.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias(name))


def list_group(df: DataFrame, keys: list[str], name: str, order: str, value: str) -> DataFrame:
    """A JSON list of the values of each group, in order; nulls stay as null."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_v")))), lambda e: e["_v"])
    return df.groupBy(*keys).agg(F.to_json(items).alias(name))


def sum_object(df: DataFrame, keys: list[str], name: str, key: str, value: str) -> DataFrame:
    return object_of(df, keys, name, key, F.sum(value))


def partial_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum, squares, extremes and a sketch of distinct values of each group: rows that can be merged later."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("low"), F.max(v).alias("high"), F.hll_sketch_agg(v.cast("string")).alias("sketch"))


def merge_statistics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics of groups from those of their parts."""
    out = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("sketch").alias("sketch"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
    return out.select(*keys, "n", "s", "low", "high", mean.alias("mean"), spread.alias("stdev"), F.hll_sketch_estimate("sketch").alias("about_distinct"))


#: Size of a quantile sketch: its ranks are off by less than a hundredth.
SKETCH_K = 400


def partial_quantiles(df: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """A sketch of the values of each group, of a bounded size: rows that can be kept for each file and merged later."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("quantiles"))


def merge_quantiles(parts: DataFrame, keys: list[str], **ranks: float) -> DataFrame:
    """About the value at each rank of 0 to 1, from the sketches of groups' parts; null for a group without values."""
    merged = parts.groupBy(*keys).agg(F.kll_merge_agg_double("quantiles").alias("_q"))
    some = F.kll_sketch_get_n_double("_q") > 0
    return merged.select(*keys, *(F.when(some, F.kll_sketch_get_quantile_double("_q", F.lit(rank))).alias(name) for name, rank in ranks.items()))


def column_statistics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    aggs = []
    for x in columns:
        v = F.col(x)
        aggs += [F.count(v).alias(f"{x}_count"), F.sum(v).alias(f"{x}_sum"), F.min(v).alias(f"{x}_min"), F.max(v).alias(f"{x}_max"), F.max(F.length(v.cast("string"))).alias(f"{x}_width")]
        aggs.append(F.percentile_approx(v, [0.5, 0.95], 1000).alias(f"{x}_quantiles"))
    return df.groupBy(*keys).agg(*aggs)


# -- time ---------------------------------------------------------------------------


def micros(t: Column | str) -> Column:
    return F.unix_micros(c(t).cast("timestamp"))


def time_slice(t: Column | str, seconds: int) -> Column:
    """The start of the bucket that t falls into."""
    n = seconds * 1_000_000
    return F.timestamp_micros(micros(t) - F.pmod(micros(t), F.lit(n)))


def daily_slice(t: Column | str, from_hour: int, to_hour: int) -> Column:
    """The day at from_hour if t lies in the hours, else null."""
    start = F.timestamp_micros(micros(F.date_trunc("day", c(t))) + from_hour * 3_600_000_000)
    return F.when(F.hour(c(t)).between(from_hour, to_hour - 1), start)


def time_difference(a: Column | str, b: Column | str) -> Column:
    """Seconds; null where a text is no time."""
    return (F.unix_micros(F.try_to_timestamp(c(a))) - F.unix_micros(F.try_to_timestamp(c(b)))) / 1e6


def in_zone(t: Column | str, zone: str) -> Column:
    """The time as ISO text in a zone, with the zone's offset at that time."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(c(t), F.current_timezone()), zone)
    minutes = F.floor((micros(local) - micros(F.to_utc_timestamp(c(t), F.current_timezone()))) / 60_000_000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), two(F.floor(F.abs(minutes) / 60)), two(F.abs(minutes) % 60))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset)


def histogram(messages: DataFrame, seconds: int, time: str = "log_time", level: str = "log_level", gaps: bool = False) -> DataFrame:
    """(bucket, normal, warnings, errors); gaps: one more row, without counts, for each stretch of empty buckets."""
    o = level_ordinal(level)
    out = messages.groupBy(time_slice(time, seconds).alias("bucket")).agg(
        F.count_if(o < 10).alias("normal"), F.count_if(o == 10).alias("warnings"), F.count_if(o >= 11).alias("errors")
    )
    if not gaps:
        return out
    # one row for each bucket is left: their order is a small window
    nxt = F.lead("bucket").over(Window.orderBy("bucket"))
    wide = out.withColumn("_next", nxt)
    empty = wide.where(micros("_next") - micros("bucket") > seconds * 1_000_000)
    return out.unionByName(empty.select(F.timestamp_micros(micros("bucket") + seconds * 1_000_000).alias("bucket"), *(F.lit(None).cast("bigint").alias(x) for x in ("normal", "warnings", "errors"))))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"))


def average_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(column).alias("value"))


def sum_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(column).alias("total"))


def by(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates)


def timeseries(df: DataFrame, seconds: int, *aggregates: Column, time: str = "log_time") -> DataFrame:
    """Aggregates by time slice."""
    return df.groupBy(time_slice(time, seconds).alias("tslice")).agg(*aggregates)


def hist(df: DataFrame, seconds: int, column: str, top: int = 10, time: str = "log_time") -> DataFrame:
    """(tslice, v): for each time slice one JSON object of its top values and the rest as Other, the most frequent first."""
    counts = top_values(df, seconds, column, top, time)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("_o"), F.col("value").alias("k"), F.col("total").alias("v"))))
    return counts.groupBy(F.col("bucket").alias("tslice")).agg(F.to_json(F.map_from_entries(F.transform(ranked, lambda x: F.struct(x["k"], x["v"])))).alias("v"))


def top_values(df: DataFrame, seconds: int, column: str, top: int = 10, time: str = "log_time") -> DataFrame:
    """(bucket, value, total): of each bucket the top - 1 most frequent values, and the rest as Other."""
    counts = df.groupBy(time_slice(time, seconds).alias("bucket"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("total"), "value"))
    named = counts.withColumn("value", F.when(rank < top, F.col("value")).otherwise("Other"))
    return named.groupBy("bucket", "value").agg(F.sum("total").alias("total"))


def spectrogram(df: DataFrame, value: str, seconds: int, width: int, time: str = "log_time") -> DataFrame:
    """(bucket, cell, low, total): counts by time and value; cells of equal size span the value's range."""
    lo, hi = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if lo is None:
        lo = hi = 0.0
    size = (hi - lo) / (width - 1) or 1.0
    cell = F.floor((F.col(value) - lo) / size).cast("bigint")
    return df.where(F.col(value).isNotNull()).groupBy(time_slice(time, seconds).alias("bucket"), cell.alias("cell")).agg(F.count("*").alias("total")).withColumn("low", lo + F.col("cell") * size)


def row_thresholds(spectrum: DataFrame) -> DataFrame:
    """The counts of each bucket's cells at six quantiles, which set the colours."""
    return spectrum.groupBy("bucket").agg(F.percentile("total", [x / 100 for x in (15, 30, 45, 60, 75, 90)]).alias("thresholds"))


def acceleration(messages: DataFrame, key: list[str], time: str = "log_time", line: str = "file_line", back: int = 4) -> DataFrame:
    """rate_change: how the last gap compares with the range of the last few, from -1 (much shorter) to 1.

    time and line order a key's rows, which are worked off in blocks.
    """
    w = Window.partitionBy(*key, "_block").orderBy("_n")
    gap = (micros(time) - F.lag(micros(time)).over(w)) / 1e6
    rows = near_rows(messages, key, [time, line], before=back + 1).withColumn("_gap", gap)
    few = w.rowsBetween(-back, 0)
    low, high = F.min("_gap").over(few), F.max("_gap").over(few)
    out = rows.withColumn("rate_change", (F.avg("_gap").over(few) - F.col("_gap")) / F.greatest(high - low, F.lit(5.0)))
    return out.where("_own").drop("_gap", "_n", "_block", "_own")


# -- reports ---------------------------------------------------------------------------


def summarize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns become group keys with a count, numeric ones a block of aggregates; rows of partitions named .something go."""
    kinds = dict(df.dtypes)
    if "log_part" in kinds:
        df = df.where(F.coalesce(~F.col("log_part").startswith("."), F.lit(True)))
    keys = [x for x in columns if kinds[x] == "string"]
    aggs = [F.count("*").alias("count")]
    for x in columns:
        if x not in keys:
            aggs += [F.sum(x).alias(f"sum_{x}"), F.min(x).alias(f"min_{x}"), F.avg(x).alias(f"avg_{x}"), F.median(x).alias(f"median_{x}"), stdev(x).alias(f"stddev_{x}"), F.max(x).alias(f"max_{x}")]
    return df.groupBy(*keys).agg(*aggs)


def access_report(log: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Tables of a web log: totals, days, URIs, missing pages, addresses, status classes, referring hosts.

    Each has hits, their percentage of all hits, visitors (pairs of address and agent) and bytes.
    """
    visitor = F.struct("c_ip", "cs_user_agent")
    block = [F.count("*").alias("hits"), F.count_distinct(visitor).alias("visitors"), F.sum("sc_bytes").alias("bytes")]
    every = log.agg(F.count("*").alias("_all"))  # one row

    def part(*keys: Column, where: Column | None = None) -> DataFrame:
        rows = log if where is None else log.where(where)
        return rows.groupBy(*keys).agg(*block).crossJoin(every).withColumn("percent", 100.0 * F.col("hits") / F.col("_all")).drop("_all")

    def first(rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in ("hits", "percent", "visitors", "bytes")]
        return rows.orderBy(F.desc("hits"), *names).limit(top)

    return {
        "totals": log.agg(*block),
        "days": part(F.to_date("log_time").alias("day")),
        "uris": first(part(F.col("cs_uri_stem"), F.col("cs_method"))),
        "missing": first(part(F.col("cs_uri_stem"), where=F.col("sc_status") == 404)),
        "addresses": first(part(F.col("c_ip"))),
        "classes": part(F.floor(F.col("sc_status") / 100).alias("class")),
        "referrers": first(part(F.try_parse_url(F.col("cs_referer"), F.lit("HOST")).alias("referrer"), where=F.col("cs_referer").isNotNull())),
    }


def report_document(tables: dict[str, DataFrame], title: str) -> DataFrame:
    """One row with `document`: the tables of a report as Markdown, a section each; columns `percent` with one decimal.

    Rows go by hits, most first, then by their other columns. A report's tables are short lists, so one text holds them.
    """
    lines = None
    for i, (name, table) in enumerate(tables.items()):
        shown = [F.format_string("%.1f", x) if x == "percent" else F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in table.columns]
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
        rank = -F.col("hits") if "hits" in table.columns else F.lit(0)
        head = "\n".join((f"## {name}", "", f"| {' | '.join(table.columns)} |", f"|{'---|' * len(table.columns)}"))
        part = table.agg(F.array_sort(F.collect_list(F.struct(rank.cast("bigint").alias("rank"), row.alias("row")))).alias("rows"))
        part = part.select(F.lit(i).alias("section"), F.concat_ws("\n", F.lit(head), F.transform("rows", lambda x: x.row)).alias("text"))
        lines = part if lines is None else lines.unionByName(part)
    whole = lines.agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("parts"))
    return whole.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("parts", lambda x: x.text), "\n\n"), F.lit("\n")).alias("document"))


def leases(messages: DataFrame, key: list[str], order: list[str], time: str = "log_time") -> DataFrame:
    """messages with lease_stop, the time of the key's next message, and lease, the microseconds until then; null for its last.

    order makes all rows unique. A key's rows are worked off in blocks.
    """
    rows = numbered(messages, [*key, *order], "_n").withColumn("_back", -F.col("_n"))
    rows = previous(rows, key, "_back", time, "lease_stop").drop("_n", "_back")
    return rows.withColumn("lease", micros("lease_stop") - micros(time))


def timeline(messages: DataFrame, kinds: dict[str, str | Column], time: str = "log_time", least: str | None = None, wanted: str | None = None) -> DataFrame:
    """Rows (kind, name, start, stop, total, errors, warnings) of the spans of files, operations, threads, tags, partitions.

    kinds: for each kind the column that names a message's spans, or an array column for several. A message is counted in
    one pass, whatever the number of kinds. least: the lowest level that counts; wanted: a regex for the names.
    """
    from strandlog.operators.messages import level_counts

    rows = messages.where(level_ordinal("log_level") >= level_ordinal(F.lit(least))) if least else messages
    types = dict(messages.select(*(c(x).alias(k) for k, x in kinds.items())).dtypes)
    spans_of = {k: c(x) if types[k].startswith("array") else F.array(c(x).cast("string")) for k, x in kinds.items()}

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("name")))

    names = [named(k, x) for k, x in spans_of.items()]
    found = rows.select("*", F.explode(F.concat(*(F.coalesce(n, F.array().cast("array<struct<kind:string,name:string>>")) for n in names))).alias("_s"))
    spans = found.where(F.col("_s.name").isNotNull()).groupBy(F.col("_s.kind").alias("kind"), F.col("_s.name").alias("name"))
    out = spans.agg(F.min(time).alias("start"), F.max(time).alias("stop"), *level_counts())
    return out.where(F.col("name").rlike(wanted)) if wanted else out


# -- content ------------------------------------------------------------------------------

#: The kinds of variable tokens, in the order they are masked.
MASKS = (
    ("quoted", r'"[^"\n]*"'),
    ("url", r"\b[a-z][a-z0-9+.-]*://[^\s\"'<>]+"),
    ("email", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"),
    ("uuid", r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"),
    ("mac", r"\b[0-9a-fA-F]{2}(?:[:-][0-9a-fA-F]{2}){5}\b"),
    ("date", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"),
    ("time", r"\b\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\b"),
    ("ipv4", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("path", r"(?<![\w<])/(?:[\w.-]+/)*[\w.-]+"),
    ("hex", r"\b0x[0-9a-fA-F]+\b|\b(?=\w*\d)[0-9a-f]{8,}\b"),
    ("number", r"(?<![\w.])[-+]?\d+(?:\.\d+)?%?(?![\w])"),
)


def template(text: Column | str) -> Column:
    """The message with # for its variable parts."""
    out = c(text)
    for _, pattern in MASKS:
        out = F.regexp_replace(out, pattern, "#")
    return out


def schema_id(text: Column | str) -> Column:
    return F.sha2(template(text), 256)


def format_summary(messages: DataFrame, body: str = "log_body", time: str = "log_time") -> DataFrame:
    """Templates of more than one message: total, first and last time, the length between, the first line, and the log formats, where told."""
    kinds = [F.array_sort(F.collect_set("log_format")).alias("log_formats")] if "log_format" in messages.columns else []
    out = messages.groupBy(template(body).alias("format")).agg(F.count("*").alias("total"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min_by(body, F.struct(time, body)).alias("first_line"), *kinds)
    return out.where("total > 1").withColumn("length", humanize_duration((micros("last_time") - micros("first_time")) / 1e6))


def fields_of(text: Column | str) -> Column:
    """k=v and k: v pairs as a map; the last value of a key stays."""
    pattern = F.lit(r'([A-Za-z_][\w.-]*)(?:=|:\s+)("[^"]*"|[^\s,;]+)')
    keys, values = (F.regexp_extract_all(c(text), pattern, F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), F.regexp_replace(v, '^"(.*)"$', "$1").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["k"]))
    return F.map_from_entries(last)


def search_table(messages: DataFrame, pattern: str, names: list[str], key: list[str], body: str = "log_body", kinds: dict[str, str] | None = None, literal: str | None = None) -> DataFrame:
    """A row for each match: match_index and the captures; literal: a plain text every match holds, tested first."""
    groups = [F.regexp_extract_all(body, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    rows = messages.where(F.col(body).contains(literal)) if literal else messages
    rows = rows.where(F.col(body).rlike(pattern)).select(*key, F.posexplode(F.arrays_zip(*groups)).alias("match_index", "_m"))
    kinds = kinds or {}
    return rows.select(*key, F.col("match_index").cast("bigint"), *(F.col(f"_m.{n}").try_cast(kinds[n]).alias(n) if n in kinds else F.col(f"_m.{n}").alias(n) for n in names))


def url_parts(url: Column | str) -> Column:
    u = c(url)
    part = lambda name, *key: F.try_parse_url(u, F.lit(name), *map(F.lit, key))
    authority = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    pairs = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: p != "")
    decoded = lambda x: F.try_url_decode(x)
    entry = lambda p: F.struct(decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), F.when(p.contains("="), decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1))).alias("v"))
    named = F.filter(F.transform(pairs, entry), lambda e: e["k"].isNotNull())
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda x: x["k"] == e["k"]))
    return F.struct(
        part("PROTOCOL").alias("scheme"), F.nullif(F.regexp_extract(authority, r"^([^:@]*)(?::[^@]*)?@", 1), F.lit("")).alias("username"),
        F.nullif(F.regexp_extract(authority, r"^[^:@]*:([^@]*)@", 1), F.lit("")).alias("password"), part("HOST").alias("host"),
        F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit("")).alias("port"), part("PATH").alias("path"), part("QUERY").alias("query"),
        F.to_json(F.map_from_entries(last), {"ignoreNullFields": "false"}).alias("parameters"), part("REF").alias("fragment"),
    )
