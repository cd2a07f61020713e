"""Log formats as data, and the parse of lines by them in native expressions."""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    """patterns: regexes with named groups, tried in order; times: Spark layouts of `timestamp`; kinds: types of groups that
    aren't text; levels: (level, regex) on the level group, first hit wins; body: the group that holds the message;
    duration: a group of numbers and their units a second; stamp_is: whether the time marks an operation's end or start."""

    name: str
    patterns: tuple[str, ...]
    times: tuple[str, ...]
    kinds: dict[str, str] = field(default_factory=dict)
    levels: tuple[tuple[str, str], ...] = ()
    level_field: str = "level"
    body: str = "body"
    opid: tuple[str, ...] = ()
    sample: str = ""
    duration: tuple[str, float] | None = None
    stamp_is: str = "end"

    def groups(self) -> list[str]:
        names: list[str] = []
        for p in self.patterns:
            names += [n for n in re.findall(r"\(\?P?<(\w+)>", p) if n not in names]
        return names


def positional(pattern: str) -> tuple[str, list[str]]:
    """The pattern with plain groups, and the names of its groups in order ('' for the nameless)."""
    names, out, i = [], [], 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?P?<(\w+)>|\((?!\?)", pattern):
        text = m.group(0)
        if text.startswith("\\") or text.startswith("["):
            continue
        names.append(m.group(1) or "")
        out.append(pattern[i : m.start()] + "(")
        i = m.end()
    return "".join(out) + pattern[i:], names


WORDS = (("fatal", r"(?i)^(f|fatal|emerg|panic)"), ("critical", r"(?i)^(c$|crit|alert)"), ("error", r"(?i)^(e|err|error|severe)"), ("warning", r"(?i)^(w|warn)"), ("notice", r"(?i)^(n|notice)"), ("info", r"(?i)^(i|info)"), ("debug", r"(?i)^(d|debug)"), ("trace", r"(?i)^(t|trace|verbose)"))

FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        Format(
            "access_log",
            (
                r'^(?<c_ip>[^ ]+) [^ ]+ (?<cs_username>[^ ]+) \[(?<timestamp>[^\]]+)\] "(?<cs_method>[A-Z]+) (?<cs_uri_stem>[^ ?"]+)(?:\?(?<cs_uri_query>[^ "]*))? (?<cs_version>[A-Za-z]+/[\d.]+)" (?<sc_status>\d+) (?<sc_bytes>\d+|-)(?: "(?<cs_referer>[^"]*)" "(?<cs_user_agent>[^"]*)")?\s*$',
                r'^(?<c_ip>[^ ]+) [^ ]+ (?<cs_username>[^ ]+) \[(?<timestamp>[^\]]+)\] "(?<cs_uri_stem>[^"]*)" (?<sc_status>\d+) (?<sc_bytes>\d+|-)\s*$',
            ),
            ("dd/MMM/yyyy:HH:mm:ss XX",),
            {"sc_status": "bigint", "sc_bytes": "bigint"},
            (("error", r"^[45]"), ("info", r"^\d")),
            "sc_status",
            "cs_uri_stem",
            ("c_ip", "cs_user_agent"),
            '10.0.0.1 - u1 [01/Jan/2024:00:00:07 +0000] "GET /view?k=1 HTTP/1.1" 200 655 "-" "agent"',
        ),
        Format(
            "syslog_log",
            (r"^(?<timestamp>[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (?<log_hostname>[^ ]+) (?<log_procname>[^ \[:]+)(?:\[(?<log_pid>\d+)\])?: (?<body>.*)$", r"^<(?<log_pri>\d+)>(?<syslog_version>\d+) (?<timestamp>\S+) (?<log_hostname>\S+) (?<log_procname>\S+) (?<log_pid>\S+) (?<log_msgid>\S+) (?<log_struct>-|\[.*?\]) ?(?<body>.*)$"),
            ("yyyy MMM d HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"),
            {"log_pri": "bigint", "syslog_version": "bigint"},
            (("error", r"(?i)\b(error|failed|failure)\b"), ("warning", r"(?i)\bwarn"), ("info", ".")),
            "body",
            opid=("log_procname", "log_pid"),
            sample="Jan  1 00:00:07 host8 app[8]: error value=6.55",
        ),
        Format(
            "glog_log",
            (r"^(?<level>[IWECFD])(?<timestamp>\d{4} \d\d:\d\d:\d\d\.\d{6})\s+(?<thread>\d+) (?<src_file>[^:]+):(?<src_line>\d+)\] (?<body>.*)$",),
            ("yyyy MMdd HH:mm:ss.SSSSSS",),
            {"src_line": "bigint"},
            WORDS,
            opid=("thread",),
            sample="I0101 00:00:07.179575 8 app.cc:69] view 6.55",
        ),
        Format(
            "java_log",
            (r"^(?<timestamp>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \[(?<thread>[^\]]+)\] (?<level>[A-Z]+)\s+(?<class>\S+) - (?<body>.*)$", r"^(?<timestamp>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) (?<level>[A-Z]+)\s+(?<class>[\w.$]+):? (?<body>.*)$"),
            ("yyyy-MM-dd HH:mm:ss,SSS",),
            {},
            WORDS,
            opid=("thread",),
            sample="2024-01-01 00:00:07,179 [t8] ERROR com.shop.App - value 6.55",
        ),
        Format(
            "postgres_log",
            (r"^(?<timestamp>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d{3})?) (?<tz>[A-Z]+) \[(?<pid>\d+)\](?: (?<user>[^@ ]*)@(?<db>\S*))? (?<level>[A-Z]+):\s+(?:duration: (?<duration>[\d.]+) ms\s*)?(?<body>.*)$",),
            ("yyyy-MM-dd HH:mm:ss[.SSS]",),
            {"duration": "double", "pid": "bigint"},
            (("fatal", "^(FATAL|PANIC)"), ("error", "^ERROR"), ("warning", "^WARNING"), ("debug", "^DEBUG"), ("info", ".")),
            opid=("pid",),
            duration=("duration", 1000.0),
            sample="2024-01-01 00:00:07.179 UTC [8] u@shop LOG:  duration: 6.55 ms  statement: select 1",
        ),
        Format(
            "haproxy_log",
            (r"^(?<timestamp>[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (?<log_hostname>\S+) haproxy\[(?<pid>\d+)\]: (?<client_ip>[^:]+):(?<client_port>\d+) \[(?<accept_date>[^\]]+)\] (?<frontend>\S+) (?<backend>[^/ ]+)/(?<server>\S+) (?<timers>[-\d/]+) (?<status>-?\d+) (?<bytes>\d+) (?<body>.*)$",),
            ("yyyy MMM d HH:mm:ss",),
            {"status": "bigint", "bytes": "bigint"},
            (("error", "^[45-]"), ("info", ".")),
            "status",
            opid=("client_ip",),
            sample='Jan  1 00:00:07 lb haproxy[1]: 10.0.0.8:80 [01/Jan/2024:00:00:07.179] web app/s1 0/0/1/2/3 200 655 - - ---- 1/1/0/0/0 0/0 "GET / HTTP/1.1"',
        ),
        Format(
            "strace_log",
            (r"^(?:(?<pid>\d+)\s+)?(?<timestamp>\d\d:\d\d:\d\d\.\d{6}) (?<syscall>\w+)\((?<body>.*)\)\s+= (?<rc>[-\w]+)(?: (?<errno>E[A-Z]+) \([^)]*\))?(?: <(?<duration>[\d.]+)>)?$",),
            ("HH:mm:ss.SSSSSS",),
            {"duration": "double"},
            (("error", "^E"), ("info", ".")),
            "errno",
            opid=("pid",),
            duration=("duration", 1.0),
            stamp_is="start",
            sample='00:00:07.179575 open("/tmp/a", O_RDONLY) = -1 ENOENT (No such file) <0.000655>',
        ),
        Format(
            "zookeeper_log",
            (r"^(?<timestamp>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \[myid:(?<myid>\d*)\] - (?<level>[A-Z]+)\s+\[(?<thread>[^\]]*):(?<class>[\w$]+)@(?<src_line>\d+)\] - (?<body>.*)$",),
            ("yyyy-MM-dd HH:mm:ss,SSS",),
            {"src_line": "bigint"},
            WORDS,
            opid=("thread",),
            sample="2024-01-01 00:00:07,179 [myid:1] - WARN  [main:QuorumPeer@69] - value 6.55",
        ),
        Format(
            "generic_log",
            (r"^(?<timestamp>\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{3,6})?)[:\s]+\[?(?<level>[A-Za-z]+)\]?[:\s]+(?<body>.*)$",),
            ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",),
            {},
            WORDS,
            sample="2024-01-01 00:00:07.179 ERROR value 6.55",
        ),
    )
}


def matches(line: Column, fmt: Format) -> Column:
    out = F.lit(False)
    for p in fmt.patterns:
        out = out | line.rlike(positional(p)[0])
    return out


def level_of(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def timestamp_of(text: Column, layouts: tuple[str, ...], year: int = 1970) -> Column:
    """Runs of spaces collapse and a weekday before a month goes; a layout without a year gets one before it, one without
    a day the year's first. "epoch": seconds; "iso": any ISO form."""
    clean = F.regexp_replace(F.regexp_replace(text, r" +", " "), r"^[A-Z][a-z]{2} (?=[A-Z][a-z]{2} )", "")
    tries = []
    for layout in layouts:
        value = clean
        if layout == "epoch":
            tries.append(F.timestamp_micros((F.when(clean.rlike(r"^\d+(\.\d+)?$"), clean).try_cast("decimal(28,6)") * 1_000_000).cast("bigint")))
            continue
        if layout == "iso":
            tries.append(F.try_to_timestamp(clean))
            continue
        if layout.startswith(("yyyy M", "yyyy d")):
            value = F.concat(F.lit(f"{year} "), clean)
        elif layout.startswith("HH"):
            value, layout = F.concat(F.lit(f"{year}-01-01 "), clean), f"yyyy-MM-dd {layout}"
        tries.append(F.try_to_timestamp(value, F.lit(layout)))
    return F.coalesce(*tries)


#: Between the captures of a line, and before those of a line that a pattern matches; taken out of lines beforehand.
_NEXT, _HIT = "\x1f", "\x1e"


def captures(text: Column, fmt: Format) -> Column:
    """The number of the first pattern that matches and its captures as an array of texts; one text if none matches.

    Each pattern runs once a line, for all its groups together.
    """
    out = F.when(text.contains(_NEXT) | text.contains(_HIT), F.translate(text, _NEXT + _HIT, "")).otherwise(text)
    for i, p in enumerate(fmt.patterns):
        plain, names = positional(p)
        parts = "".join(f"{_NEXT}${n}" for n in range(1, len(names) + 1))
        out = F.regexp_replace(out, F.lit(plain.replace("^", f"^(?!{_HIT})", 1)), F.lit(f"{_HIT}{i}{parts}"))
    return F.split(out, _NEXT, -1)


def parse(df: DataFrame, fmt: Format, line: str = "value", year: int = 1970, keep: bool = False) -> DataFrame:
    """The messages of a format: log_time, log_level, its columns, log_opid, log_body, log_format_regex, and for formats
    with durations span_start and span_end.

    keep: lines that no pattern matches stay, with nulls. The control characters 1E and 1F are left out of a line.
    """
    found = F.array(captures(F.col(line), fmt))
    # exploded, so that the patterns run once a line: a filter would be moved before the step that makes the column
    rows = df.withColumn("_parts", F.explode(found if keep else F.filter(found, lambda p: F.get(p, 0).startswith(_HIT))))
    hit = F.get("_parts", F.lit(0)).startswith(_HIT)
    rows = rows.withColumn("_which", F.when(hit, F.substring(F.get("_parts", F.lit(0)), 2, 3).cast("int")))
    forms = [positional(p)[1] for p in fmt.patterns]

    def group(name: str) -> Column:
        out = F.lit(None).cast("string")
        for i, names in enumerate(forms):
            if name in names:
                out = F.when(F.col("_which") == i, F.get("_parts", F.lit(names.index(name) + 1))).otherwise(out)
        return F.nullif(F.nullif(out, F.lit("")), F.lit("-")) if name not in ("body", "level") else out

    columns = {g: group(g) for g in fmt.groups() if g != "timestamp"}
    level = level_of(F.coalesce(columns.get(fmt.level_field, F.lit("")), F.lit("")), fmt.levels)
    opid = F.sha2(F.concat_ws("\x1f", *(F.coalesce(columns[x], F.lit("")) for x in fmt.opid)), 256) if fmt.opid else F.lit(None).cast("string")
    out = {"log_time": timestamp_of(group("timestamp"), fmt.times, year), "log_level": F.when(F.col("_which").isNotNull(), level)}
    out |= {g: x.try_cast(fmt.kinds[g]) if g in fmt.kinds else x for g, x in columns.items() if g != "level"}
    out |= {"log_opid": F.when(F.col("_which").isNotNull(), opid), "log_body": columns.get(fmt.body, F.col(line)), "log_format": F.lit(fmt.name), "log_format_regex": F.col("_which")}
    rows = rows.select("*", *(x.alias(n) for n, x in out.items() if n not in df.columns)).drop("_which", "_parts")
    if fmt.duration:
        from strandlog.sources.json_formats import with_spans

        rows = with_spans(rows.withColumn("_d", F.col(fmt.duration[0]) / fmt.duration[1]), fmt.stamp_is, duration="_d").drop("_d")
    return rows


def _fits(fmt, sample: str) -> bool:
    if hasattr(fmt, "needs"):
        try:
            return set(fmt.needs) <= set(json.loads(sample))
        except ValueError:
            return False
    return any(re.match(positional(p)[0], sample) for p in fmt.patterns)


def by_specificity(formats: dict[str, object]) -> dict[str, object]:
    """Formats that match fewer of the other formats' samples come first; equal ones keep their order."""
    others = {n: sum(_fits(f, g.sample) for m, g in formats.items() if m != n) for n, f in formats.items()}
    return dict(sorted(formats.items(), key=lambda x: others[x[0]]))


@functools.cache
def catalogue() -> dict[str, object]:
    """All formats, specific ones before those that match their lines as well."""
    from strandlog.sources.json_formats import JSON_FORMATS
    from strandlog.sources.more_formats import MORE
    from strandlog.sources.printed_formats import PRINTED

    return by_specificity({**JSON_FORMATS, **FORMATS, **{f.name: f for f in (*MORE, *PRINTED)}})


def with_user_formats(formats: dict[str, object], *own) -> dict[str, object]:
    """A user's formats go before the catalogue's; one of the same name takes its place."""
    return {**{f.name: f for f in own}, **{n: f for n, f in formats.items() if n not in {f.name for f in own}}}


def detect(lines: DataFrame, formats: dict[str, object] | None = None, path: str = "log_path", number: str = "file_line", line: str = "value", sample: int = 1000) -> DataFrame:
    """(log_path, log_format): for each file the format that most of its first lines match; the first listed wins ties."""
    from strandlog.sources import json_formats

    formats = catalogue() if formats is None else formats
    fits = lambda f: json_formats.matches(F.col(line), f) if isinstance(f, json_formats.JsonFormat) else matches(F.col(line), f)
    head = lines.where(F.col(number) < sample)
    counts = head.groupBy(path).agg(*(F.count_if(fits(f)).alias(n) for n, f in formats.items()))
    scored = F.array(*(F.struct(F.col(n).alias("hits"), F.lit(-i).alias("rank"), F.lit(n).alias("log_format")) for i, n in enumerate(formats)))
    best = counts.select(path, F.array_max(scored).alias("best"))
    return best.select(path, F.when(F.col("best.hits") > 0, F.col("best.log_format")).alias("log_format"), F.col("best.hits").alias("hits"))
