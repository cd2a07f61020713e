"""JSON log formats as data, and the parse of JSON lines by them in native expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.sources.formats import WORDS, level_of


@dataclass(frozen=True)
class JsonFormat:
    """columns: (name, pointer without the first slash, type); needs: top-level members that tell the format.

    time: a pointer and what its value is over seconds, 0 for a text; sub: a pointer to the part below the second and its
    units a second; levels: (level, regex) on the level's text; duration: a pointer and its units a second.
    """

    name: str
    columns: tuple[tuple[str, str, str], ...]
    needs: tuple[str, ...]
    time: tuple[str, int]
    level: str
    levels: tuple[tuple[str, str], ...]
    body: str
    opid: tuple[str, ...] = ()
    sub: tuple[str, int] | None = None
    duration: tuple[str, float] | None = None
    stamp_is: str = "end"
    sample: str = ""

    def schema(self) -> T.StructType:
        """The members that the format reads; those that hold the time, the level and so on as texts."""
        tree: dict = {}
        texts = [x for x in (self.time[0], self.level, self.body, *(p[0] for p in (self.sub, self.duration) if p)) if x]
        for pointer, kind in [*((p, "string") for p in texts), *((p, k) for _, p, k in self.columns)]:
            at, steps = tree, pointer.split("/")
            for s in steps[:-1]:
                at = at.setdefault(s, {})
            at.setdefault(steps[-1], "string")

        def struct(node: dict) -> T.StructType:
            return T.StructType([T.StructField(k, struct(v) if isinstance(v, dict) else T.StringType()) for k, v in node.items()])

        return struct(tree)


_NUMBERS = (("fatal", "^60"), ("error", "^50"), ("warning", "^40"), ("info", "^30"), ("debug", "^20"), ("trace", "^10"))

JSON_FORMATS: dict[str, JsonFormat] = {
    f.name: f
    for f in (
        JsonFormat("bunyan_log", (("name", "name", "string"), ("hostname", "hostname", "string"), ("pid", "pid", "bigint"), ("src_file", "src/file", "string"), ("src_line", "src/line", "bigint")), ("name", "hostname", "pid", "level", "msg", "time", "v"), ("time", 0), "level", _NUMBERS, "msg", ("name", "pid"), sample='{"name":"shop","hostname":"h","pid":8,"level":50,"msg":"value 6.55","time":"2024-01-01T00:00:07.179Z","v":0}'),
        JsonFormat("pino_log", (("hostname", "hostname", "string"), ("pid", "pid", "bigint")), ("level", "time", "pid", "hostname", "msg"), ("time", 1000), "level", _NUMBERS, "msg", ("pid",), sample='{"level":50,"time":1704067207179,"pid":8,"hostname":"h","msg":"value 6.55"}'),
        JsonFormat("ecs_log", (("logger", "log.logger", "string"), ("ecs_version", "ecs.version", "string")), ("@timestamp", "log.level", "message"), ("@timestamp", 0), "log.level", WORDS, "message", ("logger",), sample='{"@timestamp":"2024-01-01T00:00:07.179Z","log.level":"ERROR","message":"value 6.55","ecs.version":"1.2.0","log.logger":"shop"}'),
        JsonFormat("journald_json_log", (("unit", "_SYSTEMD_UNIT", "string"), ("identifier", "SYSLOG_IDENTIFIER", "string"), ("pid", "_PID", "bigint"), ("boot_id", "_BOOT_ID", "string")), ("__REALTIME_TIMESTAMP", "MESSAGE", "PRIORITY"), ("__REALTIME_TIMESTAMP", 1_000_000), "PRIORITY", (("fatal", "^[01]"), ("critical", "^2"), ("error", "^3"), ("warning", "^4"), ("stats", "^5"), ("info", "^6"), ("debug", "^7")), "MESSAGE", ("unit", "pid"), sample='{"__REALTIME_TIMESTAMP":"1704067207179575","PRIORITY":"3","_PID":"8","SYSLOG_IDENTIFIER":"shop","MESSAGE":"value 6.55"}'),
        JsonFormat("caddy_log", (("client_ip", "request/client_ip", "string"), ("method", "request/method", "string"), ("host", "request/host", "string"), ("uri", "request/uri", "string"), ("status", "status", "bigint"), ("size", "size", "bigint")), ("ts", "level", "logger", "msg", "request"), ("ts", 1), "level", WORDS, "msg", ("client_ip",), duration=("duration", 1.0), sample='{"level":"error","ts":1704067207.179575,"logger":"http.log.access","msg":"handled request","request":{"client_ip":"10.0.0.1","method":"GET","host":"shop.example","uri":"/view"},"duration":0.655,"status":500,"size":7}'),
        JsonFormat("mongodb_json_log", (("component", "c", "string"), ("id", "id", "bigint"), ("ctx", "ctx", "string"), ("ns", "attr/ns", "string")), ("t", "s", "c", "ctx", "msg"), ("t/$date", 0), "s", (("fatal", "^F"), ("error", "^E"), ("warning", "^W"), ("info", "^I"), ("debug", "^D")), "msg", ("ctx",), duration=("attr/durationMillis", 1000.0), sample='{"t":{"$date":"2024-01-01T00:00:07.179+00:00"},"s":"E","c":"STORAGE","id":8,"ctx":"conn1","msg":"value 6.55","attr":{"ns":"shop.events","durationMillis":655}}'),
        JsonFormat("rust_tracing_log", (("target", "target", "string"),), ("timestamp", "level", "fields", "target"), ("timestamp", 0), "level", WORDS, "fields/message", ("target",), sample='{"timestamp":"2024-01-01T00:00:07.179575Z","level":"ERROR","fields":{"message":"value 6.55"},"target":"shop"}'),
        JsonFormat("nextcloud_log", (("req_id", "reqId", "string"), ("user", "user", "string"), ("app", "app", "string"), ("method", "method", "string"), ("url", "url", "string")), ("reqId", "level", "time", "app", "message"), ("time", 0), "level", (("fatal", "^4"), ("error", "^3"), ("warning", "^2"), ("info", "^1"), ("debug", "^0")), "message", ("req_id",), sample='{"reqId":"r1","level":3,"time":"2024-01-01T00:00:07+00:00","user":"u","app":"shop","method":"GET","url":"/view","message":"value 6.55"}'),
        JsonFormat("cloudflare_log", (("client_ip", "ClientIP", "string"), ("host", "ClientRequestHost", "string"), ("method", "ClientRequestMethod", "string"), ("status", "EdgeResponseStatus", "bigint"), ("bytes", "EdgeResponseBytes", "bigint"), ("ray_id", "RayID", "string")), ("ClientIP", "EdgeStartTimestamp", "RayID"), ("EdgeStartTimestamp", 0), "EdgeResponseStatus", (("error", "^[45]"), ("info", ".")), "ClientRequestURI", ("client_ip",), stamp_is="start", sample='{"ClientIP":"10.0.0.1","ClientRequestHost":"shop.example","ClientRequestMethod":"GET","ClientRequestURI":"/view","EdgeResponseStatus":500,"EdgeResponseBytes":655,"EdgeStartTimestamp":"2024-01-01T00:00:07Z","RayID":"r"}'),
        JsonFormat("otel_collector_log", (("trace_id", "trace_id", "string"), ("span_id", "span_id", "string"), ("scope_name", "scope_name", "string"), ("severity_number", "severity_number", "bigint")), ("timestamp_ns", "severity", "body"), ("timestamp_ns", 1_000_000_000), "severity", WORDS, "body", ("trace_id",), sample='{"timestamp_ns":"1704067207179575000","severity":"ERROR","severity_number":17,"body":"value 6.55","trace_id":"t1","span_id":"s1","scope_name":"shop"}'),
        JsonFormat("github_events_log", (("actor", "actor/login", "string"), ("repo", "repo/name", "string"), ("action", "payload/action", "string"), ("public", "public", "boolean")), ("id", "type", "actor", "repo", "created_at"), ("created_at", 0), "type", (("error", "^Error"), ("info", ".")), "type", ("actor",), sample='{"id":"8","type":"ErrorEvent value 6.55","actor":{"login":"u8"},"repo":{"name":"shop/app"},"payload":{"action":"opened"},"public":true,"created_at":"2024-01-01T00:00:07Z"}'),
        JsonFormat("macosuni_log", (("process", "processImagePath", "string"), ("subsystem", "subsystem", "string"), ("category", "category", "string"), ("pid", "processID", "bigint"), ("tid", "threadID", "bigint")), ("timestamp", "messageType", "eventMessage", "processID"), ("timestamp", 0), "messageType", (("fatal", "^Fault"), ("error", "^Error"), ("debug", "^Debug"), ("info", "")), "eventMessage", ("pid", "tid"), sample='{"timestamp":"2024-01-01 00:00:07.179575+00:00","messageType":"Error","eventMessage":"value 6.55","processID":8,"threadID":9,"processImagePath":"/bin/shop","subsystem":"shop","category":"app"}'),
    )
}


def matches(line: Column, fmt: JsonFormat) -> Column:
    """Whether the line is an object with all members that tell the format."""
    missing = F.array_except(F.array(*map(F.lit, fmt.needs)).cast("array<string>"), F.json_object_keys(line))  # the keys are named once: a filter works out each mention
    return F.coalesce(F.size(missing) == 0, F.lit(False))


def parse_json_format(df: DataFrame, fmt: JsonFormat, line: str = "value") -> DataFrame:
    """The messages of a format: log_time, log_level, its columns, log_opid, log_body, span_start, span_end, extras.

    extras: the other top-level members as JSON texts. Lines that are no objects with the format's members go.
    """
    # exploded, so that a line that is made by an expression is made once: a filter would be moved before that step
    rows = df.withColumn("_line", F.explode_outer(F.array(line))).where(matches(F.col("_line"), fmt))
    rows = rows.withColumn("_j", F.from_json("_line", fmt.schema())).withColumn("_all", F.from_json("_line", "map<string,variant>"))

    def at(pointer: str) -> Column:
        out = F.col("_j")
        for step in pointer.split("/"):
            out = out.getField(step)
        return out

    text, divisor = at(fmt.time[0]), fmt.time[1]
    # decimals: a double cannot hold the microseconds of a count of nanoseconds
    stamp = F.timestamp_micros((text.try_cast("decimal(38,9)") * F.lit(1_000_000) / F.lit(divisor)).cast("bigint")) if divisor else F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2"))
    if fmt.sub:
        stamp = F.timestamp_micros(F.unix_micros(F.date_trunc("second", stamp)) + (at(fmt.sub[0]).try_cast("decimal(38,0)") * F.lit(1_000_000) / F.lit(fmt.sub[1])).cast("bigint"))
    columns = {name: at(p).try_cast(kind) for name, p, kind in fmt.columns}
    known = F.array(*(F.lit(x.name) for x in fmt.schema()))
    seconds = at(fmt.duration[0]).try_cast("double") / fmt.duration[1] if fmt.duration else F.lit(None).cast("double")
    opid = F.sha2(F.concat_ws("\x1f", *(F.coalesce(columns[x].cast("string"), F.lit("")) for x in fmt.opid)), 256) if fmt.opid else F.lit(None).cast("string")
    extras = F.transform_values(F.map_filter("_all", lambda k, v: ~F.array_contains(known, k)), lambda k, v: F.to_json(v))
    out = {"log_time": stamp, "log_level": level_of(F.coalesce(at(fmt.level), F.lit("")), fmt.levels), **columns, "log_opid": opid, "log_body": at(fmt.body), "duration": seconds, "log_format": F.lit(fmt.name), "extras": extras}
    rows = rows.select("*", *(x.alias(n) for n, x in out.items() if n not in df.columns))
    return with_spans(rows, fmt.stamp_is).drop("_line", "_j", "_all")


def with_spans(rows: DataFrame, stamp_is: str = "end", time: str = "log_time", duration: str = "duration") -> DataFrame:
    """span_start and span_end: the time and the duration (seconds) before it, or after it where stamps mark starts."""
    length = F.rint(F.coalesce(F.col(duration), F.lit(0.0)) * 1_000_000).cast("bigint")  # 1.007 s is not 1,006,999 microseconds
    moved = F.timestamp_micros(F.unix_micros(time) + (length if stamp_is == "start" else -length))
    ends = (F.col(time), moved) if stamp_is == "start" else (moved, F.col(time))
    return rows.withColumns({"span_start": ends[0], "span_end": ends[1]})


def spans_between(rows: DataFrame, start: str, end: str = "log_time") -> DataFrame:
    """Spans of logs that record both times: duration (seconds) is their difference."""
    length = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return rows.withColumns({"duration": length, "span_start": F.col(start), "span_end": F.col(end)})
