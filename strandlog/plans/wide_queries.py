"""Queries of the wider catalogue: more formats, discovered tables, sinks, JSON functions and scalar families."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strandlog import sinks
from strandlog.functions import json_text as J
from strandlog.functions import registered
from strandlog.functions import text as X
from strandlog.functions import time_slices
from strandlog.operators import analytics as A
from strandlog.operators import discovery as D
from strandlog.operators import messages as M
from strandlog.operators import scanner
from strandlog.operators import tables as T
from strandlog.operators.carry import numbered
from strandlog.operators.shared import folder, kept, spread
from strandlog.plans.queries import ACCESS, EVENTS, FMT, LEVEL, access_log, events, stamp, table
from strandlog.plans.registry import query
from strandlog.sources import formats, growing, json_formats, printed_formats, sqlite, structured, times

SECOND = f"strftime(date_trunc('second', ts), {FMT})"


def second(t: str) -> Column:
    return stamp(F.date_trunc("second", t))


# -- formats ------------------------------------------------------------------------


def _text(x: str) -> Column:
    return F.lit(x)


def _by_level(error: str, warning: str, info: str) -> Column:
    return F.when(F.col("log_level") == "error", error).when(F.col("log_level") == "warning", warning).otherwise(info)


def _body() -> Column:
    return F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))


def _regex_lines() -> dict[str, Column]:
    """A line of each format for an event."""
    at = lambda layout: F.date_format("log_time", layout)
    uid = F.col("user_id").cast("string")
    return {
        "error_log": F.concat(_text("[Mon "), at("MMM dd HH:mm:ss.SSSSSS yyyy"), _text("] [core:"), _by_level("error", "warn", "info"), _text("] [pid "), uid, _text("] "), _body()),
        "redis_log": F.concat(uid, _text(":M "), at("dd MMM yyyy HH:mm:ss.SSS"), _text(" "), _by_level(".", "#", "-"), _text(" "), _body()),
        "spdlog_log": F.concat(_text("["), at("yyyy-MM-dd HH:mm:ss.SSS"), _text("] [shop] ["), _by_level("error", "warning", "info"), _text("] "), _body()),
        "env_logger_log": F.concat(_text("["), at("yyyy-MM-dd'T'HH:mm:ss'Z'"), _text(" "), _by_level("ERROR", "WARN", "INFO"), _text(" shop::app] "), _body()),
        "mysql_error_log": F.concat(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), _text(" "), uid, _text(" ["), _by_level("Error", "Warning", "Note"), _text("] "), _body()),
        "cups_log": F.concat(_by_level("E", "W", "I"), at("' ['dd/MMM/yyyy:HH:mm:ss' +0000] Shop: '"), _body()),
        "openstack_log": F.concat(at("yyyy-MM-dd HH:mm:ss.SSS"), _text(" 8 "), _by_level("ERROR", "WARNING", "INFO"), _text(" shop.wsgi [req-"), uid, _text("] "), _body()),
        "nextflow_log": F.concat(at("MMM-dd HH:mm:ss.SSS"), _text(" [main] "), _by_level("ERROR", "WARN", "INFO"), _text(" shop.App - "), _body()),
        "logcat_log": F.concat(at("MM-dd HH:mm:ss.SSS"), _text("  8  9 "), _by_level("E", "W", "I"), _text(" shop: "), _body()),
        "zookeeper_log": F.concat(at("yyyy-MM-dd HH:mm:ss,SSS"), _text(" [myid:1] - "), _by_level("ERROR", "WARN", "INFO"), _text(" [main:QuorumPeer@69] - "), _body()),
    }


_NAMES = "(VALUES ('error_log'), ('redis_log'), ('spdlog_log'), ('env_logger_log'), ('mysql_error_log'), ('cups_log'), ('openstack_log'), ('nextflow_log'), ('logcat_log'), ('zookeeper_log'))"


@query(
    f"SELECT event_id, log_format, {SECOND} AS log_time, CASE WHEN log_format = 'redis_log' AND event_type = 'error' THEN 'debug' ELSE {LEVEL} END AS log_level, 'event ' || event_id || ' ' || event_type AS log_body "
    f"FROM events, {_NAMES} AS f(log_format)"
)
def i5_more_formats(spark, sf_dir):
    e = events(spark, sf_dir)
    out = None
    for name, line in _regex_lines().items():
        part = formats.parse(e.select("event_id", line.alias("value")), formats.catalogue()[name], year=2024)
        part = part.select("event_id", "log_format", second("log_time").alias("log_time"), "log_level", "log_body")
        out = part if out is None else out.unionByName(part)
    return out


def _json_lines() -> dict[str, Column]:
    iso = F.date_format("log_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    number, uid = _by_level("50", "40", "30"), F.col("user_id")
    o = lambda *cs: F.to_json(F.struct(*cs))
    body = _body()
    return {
        "bunyan_log": o(F.lit("shop").alias("name"), F.lit("h").alias("hostname"), uid.alias("pid"), number.cast("int").alias("level"), body.alias("msg"), iso.alias("time"), F.lit(0).alias("v")),
        "pino_log": o(number.cast("int").alias("level"), F.unix_millis("log_time").alias("time"), uid.alias("pid"), F.lit("h").alias("hostname"), body.alias("msg")),
        "ecs_log": o(iso.alias("@timestamp"), _by_level("ERROR", "WARN", "INFO").alias("log.level"), body.alias("message"), F.lit("1.2.0").alias("ecs.version")),
        "journald_json_log": o(F.unix_micros("log_time").cast("string").alias("__REALTIME_TIMESTAMP"), _by_level("3", "4", "6").alias("PRIORITY"), uid.cast("string").alias("_PID"), body.alias("MESSAGE")),
        "caddy_log": o(_by_level("error", "warn", "info").alias("level"), (F.unix_micros("log_time") / 1e6).cast("decimal(20,6)").alias("ts"), F.lit("http").alias("logger"), body.alias("msg"), F.struct(F.lit("10.0.0.1").alias("client_ip")).alias("request")),
        "mongodb_json_log": o(F.struct(iso.alias("$date")).alias("t"), _by_level("E", "W", "I").alias("s"), F.lit("NET").alias("c"), F.lit("conn1").alias("ctx"), body.alias("msg")),
        "rust_tracing_log": o(iso.alias("timestamp"), _by_level("ERROR", "WARN", "INFO").alias("level"), F.struct(body.alias("message")).alias("fields"), F.lit("shop").alias("target")),
        "nextcloud_log": o(uid.cast("string").alias("reqId"), _by_level("3", "2", "1").cast("int").alias("level"), iso.alias("time"), F.lit("shop").alias("app"), body.alias("message")),
    }


@query(
    f"SELECT event_id, log_format, {SECOND} AS log_time, {LEVEL} AS log_level, 'event ' || event_id || ' ' || event_type AS log_body FROM events, "
    "(VALUES ('bunyan_log'), ('pino_log'), ('ecs_log'), ('journald_json_log'), ('caddy_log'), ('mongodb_json_log'), ('rust_tracing_log'), ('nextcloud_log')) AS f(log_format)"
)
def i6_json_formats(spark, sf_dir):
    e = spread(events(spark, sf_dir))
    out = None
    for name, line in _json_lines().items():
        part = json_formats.parse_json_format(e.select("event_id", line.alias("value")), json_formats.JSON_FORMATS[name])
        part = part.select("event_id", "log_format", second("log_time").alias("log_time"), "log_level", "log_body")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT log_path, log_path AS log_format FROM (SELECT DISTINCT log_path FROM {_NAMES} AS f(log_path) UNION VALUES ('bunyan_log'), ('pino_log'), ('ecs_log'), ('journald_json_log'), ('caddy_log'), ('mongodb_json_log'), ('rust_tracing_log'), ('nextcloud_log')), (SELECT count(*) FROM events)")
def i3_detection_of_all_formats(spark, sf_dir):
    """One file for each format, in which every event has a line; the whole catalogue competes."""
    lines = F.array(*(F.struct(F.lit(n).alias("log_path"), x.alias("value")) for n, x in {**_regex_lines(), **_json_lines()}.items()))
    rows = events(spark, sf_dir).select("file_line", F.inline(lines))
    return formats.detect(rows).select("log_path", "log_format")


@query(f"SELECT event_id, strftime(ts - INTERVAL 1 MICROSECOND * (user_id * 1000), {FMT}) AS span_start, strftime(ts, {FMT}) AS span_end, user_id / 1000.0 AS seconds, strftime(ts + INTERVAL 1 MICROSECOND * (user_id * 1000), {FMT}) AS other_end FROM (SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM events)")
def i18_durations_and_spans(spark, sf_dir):
    """A stamp that marks an operation's end, and one that marks its start."""
    e = events(spark, sf_dir)
    line = F.concat(F.date_format("log_time", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC [8] LOG:  duration: "), F.col("user_id").cast("string"), F.lit(".000 ms  statement: select 1"))
    log = formats.parse(e.select("event_id", line.alias("value")), formats.FORMATS["postgres_log"])
    ends = json_formats.with_spans(log.withColumn("_s", F.col("duration") / 1000).drop("span_start", "span_end"), "start", duration="_s")
    both = log.join(ends.select("event_id", F.col("span_end").alias("other_end")), "event_id")
    return both.select("event_id", stamp("span_start").alias("span_start"), stamp("span_end").alias("span_end"), (F.col("duration") / 1000).alias("seconds"), stamp("other_end").alias("other_end"))


@query("SELECT 'c' || (user_id % 4) AS mux_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def i21_demultiplexed_json(spark, sf_dir):
    """A container's JSON lines, whose bodies are lines of a format of their own."""
    e = events(spark, sf_dir)
    inner = F.concat(F.date_format("log_time", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), F.upper("log_level"), F.lit(" "), F.col("event_type"))
    line = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("container"), F.concat(inner, F.lit("\n")).alias("log")))
    out = M.demultiplex_json(e.select(line.alias("value")), "container", "log")
    log = formats.parse(out, formats.FORMATS["generic_log"], line="body")
    return log.groupBy("mux_id").agg(F.count("*").alias("n"), F.count_if(F.col("log_level") == "error").alias("errors"))


# -- sinks ---------------------------------------------------------------------------------


def _target(spark) -> str:
    return f"{folder(spark)}/sink-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority || ', \"' || o_orderstatus || '\"' AS note FROM orders")
def k1_csv(spark, sf_dir):
    """Written as CSV and read again; quotes and commas in a value survive."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("note"))
    path = _target(spark)
    sinks.write_csv(o, path)
    return spark.read.schema(o.schema).option("header", True).option("escape", '"').csv(path)


@query("SELECT event_id, user_id, event_type FROM events")
def k2_json_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = _target(spark)
    sinks.write_json(e, path, ["event_id"], rows=1000)
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<event_id:bigint,user_id:bigint,event_type:string>>")).alias("r"))
    return rows.select("r.*")


@query(f"SELECT event_id, strftime(ts, {FMT}) AS at, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind FROM events")
def k3_json_lines(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", stamp("log_time").alias("at"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"))
    path = _target(spark)
    sinks.write_json_lines(e, path)
    return spark.read.schema(e.schema).json(path)


@query("SELECT event_id, event_type FROM events")
def k4_json_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = _target(spark)
    sinks.write_json(e, path, ["event_id"], columns=True, rows=1000)
    lists = spark.read.text(path).select(F.from_json("value", "event_id array<bigint>, event_type array<string>").alias("r"))
    return lists.select(F.inline(F.arrays_zip("r.event_id", "r.event_type"))).toDF("event_id", "event_type")


@query("SELECT event_type || ' ' || event_id AS value, count(*) AS times FROM events WHERE value > 100 GROUP BY 1 UNION ALL SELECT event_type || ' ' || event_id, 1 FROM events WHERE value <= 100 AND event_id % 2 = 0")
def k5_raw_and_marked(spark, sf_dir):
    """Marked lines written, then every other line appended that isn't marked."""
    e = events(spark, sf_dir).withColumn("log_raw_text", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    path = _target(spark)
    sinks.write_marked(M.mark_expr(e, "value > 100"), path)
    sinks.write_raw(e.where("value <= 100 AND event_id % 2 = 0"), path, mode="append")
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("times"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k6_create_table_as(spark, sf_dir):
    name = f"saved_{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").createOrReplaceTempView("event_rows")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{_target(spark)}' AS SELECT event_type, count(*) AS n FROM event_rows GROUP BY event_type")
    return spark.table(name)


# -- filters ---------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name LIKE '%e_n%' AS a, p_brand BETWEEN 'Brand#2' AND 'Brand#4' AS b, p_size IN (1, 5, 9) AS c, p_type IS DISTINCT FROM 'ECONOMY' AS d, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS e, CAST(p_size AS VARCHAR) AS f, TRY_CAST(p_name AS BIGINT) IS NULL AS g, regexp_matches(p_name, '^[a-m]') AS h FROM part")
def f10_predicates(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", c("p_name").like("%e_n%").alias("a"), c("p_brand").between("Brand#2", "Brand#4").alias("b"), c("p_size").isin(1, 5, 9).alias("c"), (~c("p_type").eqNullSafe("ECONOMY")).alias("d"),
        F.when(c("p_size") > 25, "big").otherwise("small").alias("e"), c("p_size").cast("string").alias("f"), c("p_name").try_cast("bigint").isNull().alias("g"), c("p_name").rlike("^[a-m]").alias("h"),
    )


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '2024-01-10'")
def f6_relative_time_bounds(spark, sf_dir):
    now = F.lit("2024-01-10 07:00:00").cast("timestamp")
    return M.between(events(spark, sf_dir), "-43h", "today", now=now).select("event_id")


@query("SELECT event_id, user_id FROM events")
def f12_hidden_fields(spark, sf_dir):
    return M.show_fields(M.hide_fields(events(spark, sf_dir), ["props", "value"]), ["user_id", "event_id", "value"])


# -- discovered tables ---------------------------------------------------------------------------


def _shop_bodies() -> Column:
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    return F.when(F.col("event_type") == "purchase", F.concat(F.lit("order="), eid, F.lit(" of user: "), uid, F.lit(" came to "), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(' with note="from '), uid, F.lit('"'))).when(
        F.col("event_type") == "signup", F.concat(F.lit("welcome user="), uid, F.lit(" by event "), eid)
    ).otherwise(F.concat(F.lit("nothing of "), eid))


_ORDER, _WELCOME = 'order=7 of user: 8 came to 6.55 with note="from 8"', "welcome user=8 by event 7"


@query('SELECT event_id, event_id AS "order", user_id AS user, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS col_2, \'from \' || user_id AS note FROM events WHERE event_type = \'purchase\'')
def d3_discovered_table(spark, sf_dir):
    return D.discovered_table(events(spark, sf_dir).withColumn("log_body", _shop_bodies()), _ORDER, ["event_id"])


@query("SELECT user, max(welcomes)::BIGINT AS welcomes, count(*) AS orders FROM (SELECT user_id AS user FROM events WHERE event_type = 'purchase') JOIN (SELECT user_id AS user, count(*) AS welcomes FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user) GROUP BY 1")
def j11_join_of_discovered_tables(spark, sf_dir):
    log = events(spark, sf_dir).withColumn("log_body", _shop_bodies())
    orders, welcomes = (D.discovered_table(log, x, ["event_id"]) for x in (_ORDER, _WELCOME))
    some = welcomes.groupBy("user").agg(F.count("*").alias("welcomes"))
    return orders.join(some, "user").groupBy("user").agg(F.max("welcomes").alias("welcomes"), F.count("*").alias("orders"))


@query("SELECT event_id, user_id AS uid, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS total, event_type AS kind FROM events")
def d4_guessed_types(spark, sf_dir):
    body = F.concat(F.lit("uid "), F.col("user_id").cast("string"), F.lit(" took "), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" as "), F.col("event_type"))
    out = D.named_search_table(events(spark, sf_dir).withColumn("log_body", body), r"uid (?<uid>\d+) took (?<total>\d+\.\d+) as (?<kind>\w+)", ["event_id"])
    return out.drop("match_index")


_SQL_UUID = "lpad(user_id::VARCHAR, 8, '0') || '-0000-0000-0000-000000000000'"


@query(
    "SELECT event_id, 'zk_notifications' AS name, 'LOOKING' AS first, 'n=' || user_id AS second FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'zk_commit_session_id', '0x' || user_id, NULL FROM events WHERE event_type = 'view' "
    f"UNION ALL SELECT event_id, 'vpx_lro_begin', 'lro-' || event_id, {_SQL_UUID} FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'vpx_lro_finish', 'lro-' || event_id, NULL FROM events WHERE event_type = 'error' "
    "UNION ALL SELECT event_id, 'sudo_log', 'u' || user_id, '/bin/ls ' || event_id FROM events WHERE event_type = 'signup'"
)
def d5_built_in_search_tables(spark, sf_dir):
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    of = lambda kind, *parts: F.when(F.col("event_type") == kind, F.concat(*parts))
    body = F.coalesce(
        of("click", F.lit("Notification: my state:LOOKING; n="), uid), of("view", F.lit("Committing global session 0x"), uid),
        of("purchase", F.lit("[VpxLRO] -- BEGIN lro-"), eid, F.lit(" -- vm-1 -- vm.PowerOn -- "), F.lpad(uid, 8, "0"), F.lit("-0000-0000-0000-000000000000")), of("error", F.lit("[VpxLRO] -- FINISH lro-"), eid),
        of("signup", F.lit("sudo:  u"), uid, F.lit(" : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/ls "), eid),
    )
    log = events(spark, sf_dir).withColumn("log_body", body).withColumn("log_level", F.lit("info"))
    out = None
    for name, a, b in (("zk_notifications", "my_state", "nvalues"), ("zk_commit_session_id", "session_id", None), ("vpx_lro_begin", "lro_id", "SessionId"), ("vpx_lro_finish", "lro_id", None), ("sudo_log", "login", "command")):
        t = D.built_in_search_table(log, name, ["event_id"])
        t = t.select("event_id", F.lit(name).alias("name"), F.col(a).alias("first"), (F.col(b) if b else F.lit(None).cast("string")).alias("second"))
        out = t if out is None else out.unionByName(t)
    return out


@query("SELECT event_id, '{\"uid\":' || user_id || ',\"kind\":\"' || event_type || '\"}' AS fields FROM events")
def d2_typed_fields(spark, sf_dir):
    body = F.concat(F.lit("uid="), F.col("user_id").cast("string"), F.lit(' kind: "'), F.col("event_type"), F.lit('" end'))
    return events(spark, sf_dir).select("event_id", D.typed_fields(body).alias("fields"))


# -- analytics ---------------------------------------------------------------------------------------


@query("SELECT event_type, round(avg(value), 6) AS value, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY 1")
def q3_average_and_sum_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = A.average_of(e, "value", "event_type").join(A.sum_of(e, "value", "event_type"), "event_type").join(A.by(e, ["event_type"], F.max("value").alias("high")), "event_type")
    return out.withColumns({"value": F.round("value", 6), "total": F.round("total", 4)})


@query(f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {FMT}) AS tslice, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def q4_timeseries(spark, sf_dir):
    out = A.timeseries(events(spark, sf_dir), 3600, F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))
    return out.withColumn("tslice", stamp("tslice"))


@query(
    f"WITH n AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, v) AS k FROM n), "
    f"g AS (SELECT b, CASE WHEN k < 3 THEN v ELSE 'Other' END AS v, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2) SELECT strftime(b, {FMT}) AS tslice, '{{' || string_agg('\"' || v || '\":' || n, ',' ORDER BY n DESC, v) || '}}' AS v FROM g GROUP BY 1"
)
def q4_hist_as_json(spark, sf_dir):
    return A.hist(events(spark, sf_dir), 86_400, "event_type", top=3).withColumn("tslice", stamp("tslice"))


@query(f"WITH b AS (SELECT DISTINCT time_bucket(INTERVAL 1 MINUTE, ts) AS b FROM events WHERE event_type = 'error'), l AS (SELECT b, lead(b) OVER (ORDER BY b) AS nxt FROM b) SELECT strftime(b, {FMT}) AS bucket, false AS gap FROM b UNION ALL SELECT strftime(b + INTERVAL 1 MINUTE, {FMT}), true FROM l WHERE nxt > b + INTERVAL 1 MINUTE")
def q2_histogram_with_gaps(spark, sf_dir):
    out = A.histogram(events(spark, sf_dir).where("event_type = 'error'"), 60, gaps=True)
    return out.select(stamp("bucket").alias("bucket"), F.col("errors").isNull().alias("gap"))


@query(f"SELECT event_id, CASE WHEN hour(ts) BETWEEN 8 AND 11 THEN strftime(date_trunc('day', ts) + INTERVAL 8 HOUR, {FMT}) END AS slice FROM events")
def q1_daily_slices(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", stamp(A.daily_slice("log_time", 8, 12)).alias("slice"))


@query(
    f"WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, floor((value - lo) / ((hi - lo) / 19))::BIGINT AS cell, count(*) AS total FROM events, r GROUP BY 1, 2) "
    f"SELECT strftime(b, {FMT}) AS bucket, round(quantile_cont(total, 0.15), 4) AS low, round(quantile_cont(total, 0.9), 4) AS high FROM c GROUP BY 1"
)
def q12_row_thresholds(spark, sf_dir):
    out = A.row_thresholds(A.spectrogram(events(spark, sf_dir), "value", 86_400, 20))
    return out.select(stamp("bucket").alias("bucket"), F.round(F.col("thresholds")[0], 4).alias("low"), F.round(F.col("thresholds")[5], 4).alias("high"))


@query("SELECT count(DISTINCT (c_ip, cs_user_agent)) AS visitors FROM " + ACCESS)
def q18_hash_keys(spark, sf_dir):
    return access_log(spark, sf_dir).agg(F.count_distinct(X.hash_key("c_ip", "cs_user_agent")).alias("visitors"))


# -- JSON functions -----------------------------------------------------------------------------------


_K = "json_extract_string(props, '$.k')"


@query(
    f"SELECT event_id, '{{\"k\":7}}' AS set_old, '{{\"k\":' || {_K} || ',\"n\":\"' || event_type || '\"}}' AS set_new, '{{\"k\":' || {_K} || '}}' AS insert_old, '{{\"k\":' || {_K} || '}}' AS replace_new, '{{}}' AS removed, "
    f"'{{\"k\":' || {_K} || ',\"deep\":{{\"list\":[1,' || user_id || ']}}}}' AS deep FROM events"
)
def s_json_edit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    deep = J.json_edit(J.json_edit("props", "set", ("$.deep", F.parse_json(F.lit('{"list":[1]}')))), "set", ("$.deep.list[#]", F.col("user_id")))
    return e.select(
        "event_id", J.json_edit("props", "set", ("$.k", 7)).alias("set_old"), J.json_edit("props", "set", ("$.n", F.col("event_type"))).alias("set_new"), J.json_edit("props", "insert", ("$.k", 7)).alias("insert_old"),
        J.json_edit("props", "replace", ("$.n", 7)).alias("replace_new"), J.json_remove("props", "$.k").alias("removed"), deep.alias("deep"),
    )


@query(
    f"SELECT event_id, '[{{\"k\":' || {_K} || '}},1,\"' || event_type || '\"]' AS joined, '[' || user_id || ',\"' || event_type || '\",null]' AS list, '{{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}}' AS object, '\"' || event_type || '\"' AS quoted, "
    "true AS valid, false AS invalid, 'object' AS kind, 'integer' AS kind_of_k, 3::BIGINT AS length FROM events"
)
def s_json_build(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    listed = J.json_array(F.col("user_id"), F.col("event_type"), None)
    return e.select(
        "event_id", J.json_concat("props", 1, F.col("event_type")).alias("joined"), listed.alias("list"), J.json_object(id=F.col("event_id"), kind=F.col("event_type")).alias("object"), J.json_quote(F.col("event_type")).alias("quoted"),
        J.json_valid("props").alias("valid"), J.json_valid("event_type").alias("invalid"), J.json_type("props").alias("kind"), J.json_type(X.json_pointer("props", "/k")).alias("kind_of_k"), J.json_length(listed).cast("bigint").alias("length"),
    )


@query("SELECT event_id, event_type = 'error' AS in_list, user_id = 7 AS scalar, false AS in_object FROM events")
def s_json_contains(spark, sf_dir):
    listed = F.to_json(F.array("event_type", F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", X.json_contains(listed, "error").alias("in_list"), X.json_contains(F.col("user_id").cast("string"), "7").alias("scalar"), X.json_contains("props", "7").alias("in_object"))


def _nested(depth: int) -> Column:
    inner = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]"))
    for _ in range(depth):
        inner = F.concat(F.lit('{"d":'), inner, F.lit("}"))
    return inner


@query("SELECT event_id, (i - 1)::INTEGER AS id, CASE WHEN i = 1 THEN '$' WHEN i = 14 THEN '$' || repeat('.d', 12) || '[0]' ELSE '$' || repeat('.d', i - 1) END AS fullkey, CASE WHEN i < 13 THEN 'object' WHEN i = 13 THEN 'array' ELSE 'integer' END AS type, CASE WHEN i = 14 THEN user_id::VARCHAR END AS atom FROM events, (SELECT unnest(range(1, 15))::INTEGER AS i)")
def d9_json_tree(spark, sf_dir):
    """Twelve objects in one another, a list in the last."""
    rows = table(spark, sf_dir, "events").select("event_id", _nested(12).alias("j"))
    return T.json_tree(rows, "j").select("event_id", "id", "fullkey", "type", "atom")


@query("SELECT event_id, '{\"' || repeat('d/', 3) || '0\":' || user_id || '}' AS flat FROM events")
def s_json_flatten(spark, sf_dir):
    return T.flatten_json(table(spark, sf_dir, "events").select("event_id", _nested(3).alias("j")), "j", "flat").select("event_id", "flat")


# -- scalar families ---------------------------------------------------------------------------------


@query(
    "SELECT p_partkey, round(acos(x) + asin(x) + atan(x) + atan2(x, 2.0), 6) AS arcs, round(acosh(1 + x) + asinh(x) + atanh(x), 6) AS area, round(cosh(x) + sinh(x) + tanh(x), 6) AS hyperbolic, round(cot(x) + cosh(x) / sinh(x), 6) AS co, "
    "round(degrees(x) + radians(x) + pi(), 6) AS angles, round(power(x, 3) + x * x, 6) AS powers, round(x, 2) AS r, abs(x - 0.5) AS a FROM (SELECT p_partkey, p_size / 60.0::DOUBLE AS x FROM part)"
)
def s_trigonometry(spark, sf_dir):
    x = F.col("p_size") / 60.0
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.acos(x) + F.asin(x) + F.atan(x) + F.atan2(x, F.lit(2.0)), 6).alias("arcs"), F.round(F.acosh(1 + x) + F.asinh(x) + F.atanh(x), 6).alias("area"), F.round(F.cosh(x) + F.sinh(x) + F.tanh(x), 6).alias("hyperbolic"),
        F.round(F.cot(x) + X.coth(x), 6).alias("co"), F.round(F.degrees(x) + F.radians(x) + F.pi(), 6).alias("angles"), F.round(F.power(x, 3) + x * x, 6).alias("powers"), F.round(x, 2).alias("r"), F.abs(x - 0.5).alias("a"),
    )


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE greatest(o_custkey % 7, o_orderkey % 5) END AS high, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE least(o_custkey % 7, o_orderkey % 5) END AS low, coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END, -1) AS c, nullif(o_orderstatus, 'F') AS n FROM orders")
def s_nulls_and_extremes(spark, sf_dir):
    a, b = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 7), F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").select("o_orderkey", X.greatest_or_null(a, b).alias("high"), X.least_or_null(a, b).alias("low"), F.ifnull(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.lit(-1)).alias("c"), F.nullif("o_orderstatus", F.lit("F")).alias("n"))


@query(
    "SELECT p_partkey, starts_with(p_name, 'a') AS s, ends_with(p_name, 'e') AS e, contains(p_name, 'in') AS c, ltrim('..' || p_brand || '..', '.') AS lt, rtrim('..' || p_brand || '..', '.') AS rt, trim('..' || p_brand || '..', '.') AS t, "
    "repeat(p_brand, 2) AS rep, right(p_brand, 2) AS r, substr(p_name, 3) AS rest, strpos(p_name, 'e')::BIGINT AS place, ascii(p_name)::BIGINT AS code, chr(65 + (p_size % 20)::INTEGER) AS ch, concat_ws('-', p_brand, p_size) AS ws, printf('%05d|%.2f', p_size::BIGINT, p_retailprice) AS f, "
    "regexp_replace(p_brand, '([A-Za-z]+)#([0-9]+)', '\\2:\\1') AS swapped, regexp_replace(p_name, '[^aeiou]', '', 'g') AS vowels FROM part"
)
def s_more_strings(spark, sf_dir):
    n, b, dots = F.col("p_name"), F.col("p_brand"), F.concat(F.lit(".."), F.col("p_brand"), F.lit(".."))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.startswith(n, F.lit("a")).alias("s"), F.endswith(n, F.lit("e")).alias("e"), F.contains(n, F.lit("in")).alias("c"), F.ltrim(dots, F.lit(".")).alias("lt"), F.rtrim(dots, F.lit(".")).alias("rt"), F.trim(dots, F.lit(".")).alias("t"),
        F.repeat(b, 2).alias("rep"), F.right(b, F.lit(2)).alias("r"), F.substr(n, F.lit(3)).alias("rest"), F.locate("e", n).cast("bigint").alias("place"), F.ascii(n).cast("bigint").alias("code"), F.char(65 + F.col("p_size") % 20).alias("ch"),
        F.concat_ws("-", b, F.col("p_size").cast("string")).alias("ws"), F.format_string("%05d|%.2f", F.col("p_size").cast("bigint"), "p_retailprice").alias("f"), F.regexp_replace(b, r"([A-Za-z]+)#(\d+)", "$2:$1").alias("swapped"), X.only_characters(n, "aeiou").alias("vowels"),
    )


@query("SELECT p_partkey, p_brand AS b, p_brand AS h, p_name AS u, hex(p_brand) AS hexed, 'a%20b%2Fc' AS uri FROM part")
def s_encode_and_decode(spark, sf_dir):
    b, n = F.col("p_brand"), F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.decode(X.encode(b, "base64"), "base64").alias("b"), X.decode(X.encode(b, "hex"), "hex").alias("h"), X.decode(X.encode(n, "uri"), "uri").alias("u"), X.encode(b, "hex").alias("hexed"), X.encode(F.lit("a b/c"), "uri").alias("uri")
    )


@query("SELECT p_partkey, p_size::BIGINT AS one, '{\"word\":\"' || split_part(p_name, ' ', 1) || '\",\"size\":' || p_size || '}' AS several FROM part")
def s_regexp_match(spark, sf_dir):
    """One capture is the value itself, several are an object."""
    text = F.concat(F.split("p_name", " ")[0], F.lit("="), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.regexp_match(text, r"=(\d+)").cast("bigint").alias("one"), X.regexp_match(text, r"(?<word>\w+)=(?<size>\d+)").alias("several"))


@query("SELECT event_id, 'file' || (event_id % 8) || '.log' AS base, '/var/log' AS dir, '/var/log/file' || (event_id % 8) || '.log' AS joined, '/x' AS absolute FROM events")
def s_paths(spark, sf_dir):
    path = F.concat(F.lit("/var/log/"), F.col("log_path"), F.lit(".log"))
    return events(spark, sf_dir).select("event_id", X.base_name(path).alias("base"), X.dir_name(F.concat(path, F.lit("/"))).alias("dir"), X.join_path(X.dir_name(path), X.base_name(path)).alias("joined"), X.join_path(path, F.lit("/x")).alias("absolute"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s >= 60 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's000' END AS length FROM (SELECT event_id, (event_id * 37 % 80000)::BIGINT AS s FROM events)")
def s_humanized_durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.humanize_duration(F.col("event_id") * 37 % 80_000).alias("length"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 2 END::BIGINT AS alike FROM part")
def s_phonetic_difference(spark, sf_dir):
    """Robert and Rupert are both R163; of R163 and R150 two places of four are equal."""
    return table(spark, sf_dir, "part").select("p_partkey", X.soundex_difference(F.lit("Robert"), F.when(F.col("p_size") % 2 == 0, "Rupert").otherwise("Rubin")).alias("alike"))


@query(f"SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS f, strftime(ts, '%j') AS j, epoch(date_trunc('second', ts))::BIGINT AS s, strftime(date_trunc('month', ts), {FMT}) AS month, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, {FMT}) AS tomorrow FROM events")
def s_strftime(spark, sf_dir):
    t = F.col("log_time")
    return events(spark, sf_dir).select(
        "event_id", X.strftime(t, "%d/%m/%Y %H:%M:%S").alias("f"), X.strftime(t, "%j").alias("j"), X.strftime(t, "%s").cast("bigint").alias("s"), stamp(X.modified(t, "start of month")).alias("month"), stamp(X.modified(t, "start of day", "+1 day")).alias("tomorrow")
    )


# -- windows, schema, functions ------------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END ASC NULLS LAST, event_id) AS last, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END DESC NULLS FIRST, event_id) AS first FROM events")
def w5_nulls_first_and_last(spark, sf_dir):
    x = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    w = Window.partitionBy("event_type")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w.orderBy(x.asc_nulls_last(), "event_id")).cast("bigint").alias("last"), F.row_number().over(w.orderBy(x.desc_nulls_first(), "event_id")).cast("bigint").alias("first"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def w12_views(spark, sf_dir):
    """A view over a view."""
    table(spark, sf_dir, "events").createOrReplaceTempView("event_rows")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW error_rows AS SELECT * FROM event_rows WHERE event_type = 'error'")
    return spark.sql("SELECT user_id, count(*) AS n FROM error_rows GROUP BY user_id")


@query("SELECT column_name AS col_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp' END AS kind FROM (DESCRIBE events)")
def w13_schema_listing(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("event_rows")
    out = spark.sql("DESCRIBE event_rows")
    return out.select("col_name", F.regexp_replace("data_type", "_ntz$", "").alias("kind"))


@query("SELECT p_partkey, lpad(p_brand, greatest(12, length(p_brand))::INTEGER, ' ') AS padded, CASE WHEN p_size >= 10 THEN printf('%.1fKB', p_size / 10.0) ELSE (p_size * 100) || 'B' END AS size, CASE WHEN length(p_name) > 5 THEN left(p_name, 5) ELSE p_name END AS start FROM part")
def u1_registered_functions(spark, sf_dir):
    """The library's functions under their SQL names."""
    registered.register_all(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("part_rows")
    return spark.sql("SELECT p_partkey, padl(p_brand, 12) AS padded, humanize_file_size(p_size * 100) AS size, leftstr(p_name, 5) AS start FROM part_rows")


@query(f"SELECT event_id, event_type AS shop_kind, log_level FROM {EVENTS}")
def u5_user_formats(spark, sf_dir):
    """A user's format is detected before the catalogue's, and parsed."""
    own = formats.Format("shop_log", (r"^(?<timestamp>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (?<level>[A-Z]+) #(?<event_id>\d+) (?<shop_kind>\w+)$",), ("yyyy-MM-dd HH:mm:ss",), {"event_id": "bigint"}, formats.WORDS, body="shop_kind", sample="2024-01-01 00:00:07 ERROR #1 view")
    line = F.concat(F.date_format("log_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("log_level"), F.lit(" #"), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    lines = events(spark, sf_dir).select("log_path", "file_line", line.alias("value"))
    mine = formats.detect(lines, formats.with_user_formats(formats.catalogue(), own)).where("log_format = 'shop_log'")
    return formats.parse(lines.join(mine.select("log_path"), "log_path", "left_semi"), own).select("event_id", "shop_kind", "log_level")


@query("SELECT event_id, value FROM events")
def u7_raised_errors(spark, sf_dir):
    """A check that stops the query with a message where a value is negative; none is."""
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 0, F.raise_error(F.lit("a negative value"))).otherwise(F.col("value")).alias("value"))


@query("SELECT p_partkey, p_size AS level FROM part")
def i26_attached_tables(spark, sf_dir):
    """A folder of tables attached under a name; its tables join with others."""
    structured.attach(spark, "shop", {name: f"{sf_dir}/{name}.parquet" for name in ("part", "supplier")})
    return spark.sql("SELECT p_partkey, p_size AS level FROM shop_part")


@query("SELECT count(*) AS lines, 0::BIGINT AS gaps FROM events")
def i1_text_scan(spark, sf_dir):
    """Lines written to several files are read again in pieces of 2,000 bytes: each file's offsets have no gap, and neither have line numbers."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("value"))
    path = _target(spark)
    e.repartition(4).write.text(path)
    rows = growing.read_lines(spark, path, split_bytes=2000)
    size = F.octet_length("value") + 1
    files = rows.groupBy("log_path").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(F.col("file_line") + size).alias("end"), F.count_distinct("file_line").alias("kinds"))
    numbers = structured.numbered_lines(rows).groupBy("log_path").agg(F.max("file_line").alias("last"), F.count_distinct("file_line").alias("numbers"))
    off = F.abs(F.col("end") - F.col("bytes")) + F.abs(F.col("kinds") - F.col("n")) + F.abs(F.col("last") + 1 - F.col("n")) + F.abs(F.col("numbers") - F.col("n"))
    return files.join(numbers, "log_path").agg(F.sum("n").alias("lines"), F.sum(off).cast("bigint").alias("gaps"))


@query(f"SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'yyyy-MM-dd HH:mm:ss,SSS' WHEN 1 THEN 'dd/MMM/yyyy:HH:mm:ss XX' WHEN 2 THEN 'year MMM d HH:mm:ss' WHEN 3 THEN 'us' WHEN 4 THEN 'ms' WHEN 5 THEN 'MMM d HH:mm:ss yyyy' WHEN 6 THEN 'd MMM yyyy HH:mm:ss.SSS' ELSE 'tai64n' END AS layout, {SECOND} AS log_time FROM events")
def i11_time_layouts(spark, sf_dir):
    """Eight files, each with stamps of a layout of its own, which its first lines tell."""
    e = events(spark, sf_dir)
    at = lambda layout: F.date_format("log_time", layout)
    micros = A.micros("log_time")
    hexed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    tai = F.concat(F.lit("@4"), hexed(F.floor(micros / 1_000_000) + 10, 15), hexed(F.pmod(micros, F.lit(1_000_000)) * 1000, 8))
    stamps = [at("yyyy-MM-dd HH:mm:ss,SSS"), at("dd/MMM/yyyy:HH:mm:ss '+0000'"), at("MMM d HH:mm:ss"), micros.cast("string"), F.floor(micros / 1000).cast("string"), F.concat(F.lit("Mon "), at("MMM d HH:mm:ss yyyy")), F.concat(F.lit("Mon, "), at("dd MMM yyyy HH:mm:ss.SSS")), tai]
    stamp_of = F.get(F.array(*stamps), (F.col("event_id") % 8).cast("int"))
    lines = e.select("event_id", "log_path", F.floor(F.col("event_id") / 8).alias("file_line"), stamp_of.alias("stamp"))
    return times.read_times(lines, "stamp", year=2024).select("event_id", "layout", second("log_time").alias("log_time"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE WHEN page_id % 2 = 0 THEN 'u' END AS username, CASE WHEN page_id % 2 = 0 THEN 'p' END AS password, '{\"a b\":\"' || page_id || '\",\"c\":null,\"d\":\"2\"}' AS parameters FROM pages")
def d13_url_credentials_and_parameters(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    user = F.when(F.col("page_id") % 2 == 0, "u:p@").otherwise("")
    made = F.concat(F.lit("https://"), user, host, F.lit("/x?a%20b="), F.col("page_id").cast("string"), F.lit("&c&d=1&d=2"))
    return table(spark, sf_dir, "pages").select("page_id", A.url_parts(made).alias("u")).select("page_id", "u.host", "u.username", "u.password", "u.parameters")


@query(f"SELECT event_type || ' of user #' AS format, count(*) AS total, 'x,y' AS log_formats, CASE WHEN l >= 86400 THEN (l // 86400) || 'd' || lpad((l % 86400 // 3600)::VARCHAR, 2, '0') || 'h' || lpad((l % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS length FROM (SELECT *, (round((max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w) / 1e3)::BIGINT // 1000) AS l FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type, l")
def q6_message_formats(spark, sf_dir):
    body = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"))
    log = events(spark, sf_dir).withColumns({"log_body": body, "log_format": F.when(F.col("event_id") % 2 == 0, "x").otherwise("y")})
    return A.format_summary(log).select("format", "total", F.array_join("log_formats", ",").alias("log_formats"), "length")


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) AS s, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS stdev, true AS near FROM events GROUP BY 1")
def a15_partial_and_final(spark, sf_dir):
    """Statistics of each file and kind, merged over the files."""
    e = events(spark, sf_dir)
    merged = A.merge_statistics(A.partial_statistics(e, ["log_path", "event_type"], "value"), ["event_type"])
    exact = e.groupBy("event_type").agg(F.count_distinct("value").alias("d"))
    near = F.abs(F.col("about_distinct") - F.col("d")) <= 0.1 * F.col("d")
    return merged.join(exact, "event_type").select("event_type", "n", F.round("s", 4).alias("s"), "low", "high", F.round("mean", 6).alias("mean"), F.round("stdev", 4).alias("stdev"), near.alias("near"))


@query("SELECT event_type, true AS half, true AS most FROM (SELECT DISTINCT event_type FROM events)")
def a14_quantiles(spark, sf_dir):
    """The approximate quantiles lie within two hundredths of the ranks of the exact ones."""
    e = table(spark, sf_dir, "events")
    found = A.column_statistics(e, ["event_type"], ["value"]).select("event_type", "value_quantiles")
    around = e.groupBy("event_type").agg(F.percentile("value", F.array(*map(F.lit, (0.48, 0.52, 0.93, 0.97)))).alias("a"))
    q, a = F.col("value_quantiles"), F.col("a")
    return found.join(around, "event_type").select("event_type", q[0].between(a[0], a[1]).alias("half"), q[1].between(a[2], a[3]).alias("most"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY (user_id * 37) % 256, event_id) AS by_address, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 40, event_id) AS by_name, row_number() OVER (PARTITION BY event_type ORDER BY (user_id % 9) * CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 1 END, event_id) AS by_size FROM events")
def w6_collated_orders(spark, sf_dir):
    """Addresses by number, names with digit runs by number, sizes with units by size."""
    uid = F.col("user_id")
    address = F.concat(F.lit("10.0.0."), (uid * 37 % 256).cast("string"))
    name = F.concat(F.lit("File"), (uid % 40).cast("string"), F.lit(".log"))
    size = F.concat((uid % 9).cast("string"), F.when(uid % 2 == 0, "KB").otherwise("B"))
    place = lambda key: F.row_number().over(Window.partitionBy("event_type").orderBy(key, "event_id")).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", place(X.ip_key(address)).alias("by_address"), place(X.natural_key(name, True)).alias("by_name"), place(X.measure(size)).alias("by_size"))


@query("SELECT o_orderstatus, count(*) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def q5_summary_without_dotted_partitions(spark, sf_dir):
    part = F.when(F.col("o_orderkey") % 3 == 0, ".hidden").when(F.col("o_orderkey") % 3 == 1, "shown")
    out = A.summarize(table(spark, sf_dir, "orders").withColumn("log_part", part), ["o_orderstatus", "o_totalprice"])
    return out.select("o_orderstatus", "count", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"))


@query("SELECT sum(length(event_type) + 1)::BIGINT AS bytes, count(*) AS lines FROM events")
def i24_file_listing(spark, sf_dir):
    """Files written from the table, listed with their sizes and contents."""
    path = _target(spark)
    table(spark, sf_dir, "events").select("event_type").write.text(path)
    files = structured.fstat(spark, f"{path}/part-*")
    lines = F.length(F.regexp_replace(F.decode("content", "UTF-8"), r"[^\n]", ""))
    return files.agg(F.sum("length").cast("bigint").alias("bytes"), F.sum(lines).cast("bigint").alias("lines"))


@query(f"WITH g AS (SELECT log_path, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY log_path ORDER BY file_line)) AS gap FROM {EVENTS}) SELECT log_path, count(*) AS gaps, max(gap // 1000)::BIGINT AS longest FROM g WHERE gap >= 3600000000 GROUP BY 1")
def q13_gaps_over_a_threshold(spark, sf_dir):
    """Stretches of an hour or more without a message, by file."""
    rows = M.idle(events(spark, sf_dir)).where("log_idle_msecs >= 3600000")
    return rows.groupBy("log_path").agg(F.count("*").alias("gaps"), F.max("log_idle_msecs").alias("longest"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))")
def w12_reaction_on_a_view(spark, sf_dir):
    """A view of counts, and a view over it that reacts to those above their mean."""
    events(spark, sf_dir).createOrReplaceTempView("message_rows")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW kind_counts AS SELECT event_type, count(*) AS n FROM message_rows GROUP BY event_type")
    return spark.sql("SELECT event_type, n FROM kind_counts WHERE n > (SELECT avg(n) FROM kind_counts)")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    body = F.concat(F.lit("user="), uid, F.lit(" fan speed: "), eid, F.lit(" rpm, from 10.0.0.1 ["), uid, F.lit(","), eid, F.lit("] (kind="), F.col("event_type"), F.lit(") at /srv/"), F.col("event_type"), F.lit(".log"))
    return events(spark, sf_dir).select("event_id", body.alias("log_body"))


@query("SELECT kind, n * (SELECT count(*) FROM events) AS tokens FROM (VALUES ('word', 8), ('equals', 2), ('number', 4), ('colon', 1), ('comma', 2), ('ipv4', 1), ('open', 2), ('close', 2), ('path', 1)) t(kind, n)")
def d1_token_classes(spark, sf_dir):
    """How many tokens of each class the messages have, each scanned once."""
    found = scanner.with_tokens(_scanned(spark, sf_dir))
    return found.select(F.explode("tokens.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("tokens"))


@query(
    "SELECT event_id, '{\"user\": ' || user_id || ', \"fan speed\": ' || event_id || ', \"col_0\": \"rpm\", \"col_1\": \"10.0.0.1\", \"col_2\": [' || user_id || ', ' || event_id || '], \"col_3\": {\"kind\": \"' || event_type || '\"}, \"col_4\": \"/srv/' || event_type || '.log\"}' AS fields, "
    "'user=# fan speed: # #, from # [#] (#) at #' AS format FROM events"
)
def d2_scanned_pairs(spark, sf_dir):
    """Pairs by separators, groups and places, with the messages' format."""
    return scanner.with_pairs(_scanned(spark, sf_dir)).select("event_id", "fields", "format")


@query(
    f"SELECT event_id, strftime(CASE WHEN hour(ts) = 8 THEN date_trunc('hour', ts) END, {FMT}) AS at_eight, strftime(CASE WHEN isodow(ts) = 5 THEN date_trunc('day', ts) END, {FMT}) AS fridays, "
    f"strftime(CASE WHEN hour(ts) < 12 AND isodow(ts) < 6 THEN date_trunc('day', ts) END, {FMT}) AS mornings, strftime(CASE WHEN hour(ts) >= 22 THEN date_trunc('day', ts) + INTERVAL 22 HOUR WHEN hour(ts) < 4 THEN date_trunc('day', ts) - INTERVAL 2 HOUR END, {FMT}) AS nights, "
    f"strftime(time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01'), {FMT}) AS slices, strftime(CASE WHEN month(ts) = 1 THEN date_trunc('month', ts) END, {FMT}) AS january FROM events"
)
def q1_time_expressions(spark, sf_dir):
    at = lambda text: stamp(time_slices.time_slice("log_time", text))
    return events(spark, sf_dir).select(
        "event_id", at("8 am").alias("at_eight"), at("fri").alias("fridays"), at("weekdays before 12pm").alias("mornings"), at("10pm to 4am").alias("nights"), at("1h30m").alias("slices"), at("jan").alias("january")
    )


@query(
    "WITH m AS (SELECT *, event_id % 5 AS sub FROM events), p AS (SELECT *, coalesce(lag(event_type = 'purchase') OVER w, TRUE) AS closed_before FROM m WINDOW w AS (PARTITION BY user_id, sub ORDER BY event_id)), "
    "r AS (SELECT *, sum(CASE WHEN event_type = 'signup' OR closed_before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, sub ORDER BY event_id) AS range FROM p) "
    f"SELECT user_id, sub, range::BIGINT AS range, strftime(min(ts), {FMT}) AS start, strftime(max(ts), {FMT}) AS stop, count(*) AS total, bool_or(event_type = 'purchase') AS closed FROM r GROUP BY 1, 2, 3"
)
def q9_sub_operation_ranges(spark, sf_dir):
    """A sub-operation that closes and opens again has several ranges."""
    rows = events(spark, sf_dir).withColumn("sub", F.col("event_id") % 5)
    out = T.sub_operation_ranges(rows, "user_id", "sub", F.col("event_type") == "signup", F.col("event_type") == "purchase", ["event_id"])
    return out.withColumns({"start": stamp("start"), "stop": stamp("stop")})


@query("SELECT event_type, count(*) AS n, TRUE AS median_fits, TRUE AS high_fits FROM events GROUP BY 1")
def a14_merged_quantiles(spark, sf_dir):
    """Quantiles merged from the sketches of eight files; each lies within 2 % of its rank among all values."""
    e = events(spark, sf_dir)
    merged = A.merge_quantiles(A.partial_quantiles(e, ["log_path", "event_type"], "value"), ["event_type"], median=0.5, high=0.95)
    rows = e.select("event_type", "value").join(merged, "event_type")
    share = lambda q: (F.count_if(F.col("value") < F.col(q)) / F.count("*"), F.count_if(F.col("value") <= F.col(q)) / F.count("*"))
    fits = lambda q, rank: (share(q)[0] <= rank + 0.02) & (share(q)[1] >= rank - 0.02)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), fits("median", 0.5).alias("median_fits"), fits("high", 0.95).alias("high_fits"))


@query("SELECT s_name, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT * FROM supplier WHERE s_suppkey > 5) JOIN events ON s_suppkey = user_id GROUP BY 1")
def i26_sqlite_join(spark, sf_dir):
    """A SQLite file read by ranges of rows, filtered by the database and joined with the messages."""
    path = f"{folder(spark)}/shop-{uuid.uuid4().hex}.db"
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sqlite.write_table(names, path, "supplier")
    found = sqlite.read_table(spark, path, "supplier", partitions=4).where("s_suppkey > 5")
    out = found.join(table(spark, sf_dir, "events"), F.col("s_suppkey") == F.col("user_id"))
    return out.groupBy("s_name").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "SELECT event_id, size, row_number() OVER (ORDER BY n, event_id) AS place FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (user_id + 1) || 'MB' WHEN event_id % 3 = 1 THEN (user_id + 1) || 'KB' ELSE (user_id + 1) || 'B' END AS size, "
    "(user_id + 1) * CASE event_id % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1 END AS n FROM events)"
)
def d4_captures_in_order(spark, sf_dir):
    """A search table whose sizes sort as sizes: 9KB before 10KB before 1MB."""
    unit = F.when(F.col("event_id") % 3 == 0, "MB").when(F.col("event_id") % 3 == 1, "KB").otherwise("B")
    log = events(spark, sf_dir).withColumn("log_body", F.concat(F.lit("sent "), (F.col("user_id") + 1).cast("string"), unit, F.lit(" done")))
    found = D.named_search_table(log, r"sent (?<size>\d+[KMG]?B) done", ["event_id"])
    rows = numbered(found.withColumn("_size", D.sort_key(found, "size")), ["_size", "event_id"], "place")
    return rows.select("event_id", "size", F.col("place").cast("bigint").alias("place"))


_PRINTED = [f.name for f in printed_formats.PRINTED]
_BY_SECONDS = [f.name for f in printed_formats.PRINTED if "SSS" not in f.times[0] and f.times[0] != printed_formats.ISO]


def _printed_time(layout: str) -> Column:
    """An event's time as the samples of formats of this layout have it."""
    at = lambda form: F.date_format("log_time", form)
    if layout == printed_formats.ISO:
        return at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if layout == printed_formats.CLF:
        return at("dd/MMM/yyyy:HH:mm:ss xx")
    if layout == printed_formats.WEEKDAY:
        return at("EEE MMM d HH:mm:ss yyyy")
    if layout.startswith("yyyy MMM d"):
        return F.concat(at("MMM "), F.lpad(at("d"), 2, " "), at(" HH:mm:ss"))
    if layout.startswith("MM/dd/yyyy"):
        return F.concat(at("MM/dd/yyyy hh:mm:ss:SSS a"), F.lit(" UTC"))
    return at(layout.replace("[.SSS]", ".SSS").replace("XXX", "xxx"))


@query(
    f"SELECT event_id, log_format, strftime(CASE WHEN log_format IN {tuple(_BY_SECONDS)} THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END, {FMT}) AS log_time, 'event ' || event_id AS log_body FROM (SELECT *, ({_PRINTED})[event_id % {len(_PRINTED)} + 1] AS log_format FROM events)"
)
def i5_printed_formats(spark, sf_dir):
    """A file of each format that a layout describes: detected among the whole catalogue and parsed."""
    from strandlog.streaming.ordered import parsed_as

    line = F.lit(None).cast("string")
    for i, f in enumerate(printed_formats.PRINTED):
        text = F.replace(F.lit(f.sample), F.lit(printed_formats.SAMPLE_TIME[f.times[0]]), _printed_time(f.times[0]))
        line = F.when(F.col("event_id") % len(_PRINTED) == i, F.replace(text, F.lit(printed_formats.BODY), F.concat(F.lit("event "), F.col("event_id").cast("string")))).otherwise(line)
    lines = events(spark, sf_dir).select((F.col("event_id") % len(_PRINTED)).cast("string").alias("log_path"), F.floor(F.col("event_id") / len(_PRINTED)).alias("file_line"), line.alias("value"))
    lines = kept(lines)  # each format reads its own part of it
    found = kept(lines.join(formats.detect(lines).select("log_path", "log_format"), "log_path"))
    out = parsed_as(found, _PRINTED, formats.catalogue(), 2024)
    body = F.regexp_extract("log_body", r"event (\d+)", 0)
    return out.select(F.regexp_extract("log_body", r"event (\d+)", 1).cast("bigint").alias("event_id"), "log_format", stamp("log_time").alias("log_time"), body.alias("log_body"))


@query("SELECT event_type || ' of user #' AS format, arg_min(event_type || ' of user ' || user_id, (ts, event_type || ' of user ' || user_id)) AS first_line FROM events GROUP BY event_type")
def q6_first_lines(spark, sf_dir):
    body = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"))
    return A.format_summary(events(spark, sf_dir).withColumn("log_body", body)).select("format", "first_line")


@query(
    f"WITH t AS (SELECT count(*) AS hits, count(DISTINCT (c_ip, cs_user_agent)) AS visitors, sum(sc_bytes)::BIGINT AS bytes FROM {ACCESS}), c AS (SELECT sc_status // 100 AS class, count(*) AS hits, count(DISTINCT (c_ip, cs_user_agent)) AS visitors, sum(sc_bytes)::BIGINT AS bytes FROM {ACCESS} GROUP BY 1) "
    "SELECT '# Shop' || chr(10) || chr(10) || '## totals' || chr(10) || chr(10) || '| hits | visitors | bytes |' || chr(10) || '|---|---|---|' || chr(10) || (SELECT '| ' || hits || ' | ' || visitors || ' | ' || bytes || ' |' FROM t) || chr(10) || chr(10) || "
    "'## classes' || chr(10) || chr(10) || '| class | hits | visitors | bytes |' || chr(10) || '|---|---|---|---|' || chr(10) || (SELECT string_agg('| ' || class || ' | ' || hits || ' | ' || visitors || ' | ' || bytes || ' |', chr(10) ORDER BY hits DESC, class) FROM c) || chr(10) AS document"
)
def k7_report_document(spark, sf_dir):
    """The report of the web log as one Markdown text."""
    tables = A.access_report(access_log(spark, sf_dir))
    return A.report_document({"totals": tables["totals"], "classes": tables["classes"].drop("percent")}, "Shop")
