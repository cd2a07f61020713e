"""Queries over the given tables; texts of log lines are rendered from `events`, parsed back and analysed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import text as X
from strandlog.operators import analytics as A
from strandlog.operators import pseudonyms as P
from strandlog.operators import messages as M
from strandlog.operators import tables as T
from strandlog.operators.carry import numbered
from strandlog.plans.registry import query
from strandlog.sources import formats, structured


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(t: Column | str) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: times as TIMESTAMP, a level, a line number in one of eight files."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").otherwise("info")
    return e.select(
        "*", F.col("ts").cast("timestamp").alias("log_time"), level.alias("log_level"), F.concat(F.lit("file"), (F.col("event_id") % 8).cast("string")).alias("log_path"), F.col("event_id").alias("file_line")
    )


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "404").otherwise("500")).otherwise("200")
    line = F.concat(
        F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(" - u"), F.col("user_id").cast("string"), F.date_format("log_time", " '['dd/MMM/yyyy:HH:mm:ss '+0000]'"), F.lit(' "GET /'), F.col("event_type"), F.lit("?k="),
        F.get_json_object("props", "$.k"), F.lit(' HTTP/1.1" '), status, F.lit(" "), F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit(' "'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("http://shop"), (F.col("event_id") % 3).cast("string"), F.lit(".example/a"))).otherwise("-"), F.lit('" "agent'), (F.col("user_id") % 3).cast("string"), F.lit('"'),
    )
    return e.select("log_path", "file_line", line.alias("value"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.parse(access_lines(spark, sf_dir), formats.FORMATS["access_log"])


STATUS = "CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 404 ELSE 500 END ELSE 200 END"
ACCESS = f"""(SELECT event_id, 'file' || (event_id % 8) AS log_path, '10.0.0.' || user_id AS c_ip, 'u' || user_id AS cs_username, date_trunc('second', ts) AS log_time, 'GET' AS cs_method, '/' || event_type AS cs_uri_stem,
 'k=' || json_extract_string(props, '$.k') AS cs_uri_query, CAST({STATUS} AS BIGINT) AS sc_status, CAST(round(value * 100) AS BIGINT) AS sc_bytes, 'agent' || (user_id % 3) AS cs_user_agent FROM events)"""
LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END"
EVENTS = f"(SELECT *, ts AS log_time, {LEVEL} AS log_level, 'file' || (event_id % 8) AS log_path, event_id AS file_line FROM events)"
FMT = "'%Y-%m-%d %H:%M:%S.%f'"


# -- ingest ------------------------------------------------------------------------


@query(f"SELECT event_id AS file_line, c_ip, cs_username, strftime(log_time, {FMT}) AS log_time, cs_method, cs_uri_stem, cs_uri_query, sc_status, sc_bytes, cs_user_agent, CASE WHEN sc_status >= 400 THEN 'error' ELSE 'info' END AS log_level FROM {ACCESS}")
def i5_access_log_parse(spark, sf_dir):
    log = access_log(spark, sf_dir)
    return log.select("file_line", "c_ip", "cs_username", stamp("log_time").alias("log_time"), "cs_method", "cs_uri_stem", "cs_uri_query", "sc_status", "sc_bytes", "cs_user_agent", "log_level")


@query(f"SELECT file_line - file_line % 3 AS first_line, string_agg(event_type || ' ' || user_id, chr(10) ORDER BY file_line) AS body, count(*)::BIGINT AS n_lines FROM (SELECT event_id AS file_line, * FROM events) GROUP BY 1")
def i2_multiline_assembly(spark, sf_dir):
    e = events(spark, sf_dir).select(F.lit("all").alias("log_path"), "file_line", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("value"))
    out = M.assemble(e, F.col("file_line") % 3 == 0)
    return out.select(F.col("file_line").alias("first_line"), F.col("value").alias("body"), "n_lines")


@query("SELECT 'file' || k AS log_path, CASE k WHEN 0 THEN 'glog_log' WHEN 1 THEN 'java_log' WHEN 2 THEN 'generic_log' ELSE 'access_log' END AS log_format FROM (SELECT DISTINCT event_id % 8 AS k FROM events)")
def i3_format_detection(spark, sf_dir):
    e = events(spark, sf_dir)
    uid, et = F.col("user_id").cast("string"), F.col("event_type")
    glog = F.concat(F.lit("I"), F.date_format("log_time", "MMdd HH:mm:ss.SSSSSS"), F.lit(" "), uid, F.lit(" app.cc:7] "), et)
    java = F.concat(F.date_format("log_time", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [t"), uid, F.lit("] INFO  shop.App - "), et)
    generic = F.concat(F.date_format("log_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), et)
    other = e.select("log_path", "file_line", F.when(F.col("log_path") == "file0", glog).when(F.col("log_path") == "file1", java).when(F.col("log_path") == "file2", generic).alias("value")).where("value is not null")
    lines = other.unionByName(access_lines(spark, sf_dir).where("log_path not in ('file0', 'file1', 'file2')"))
    lines = lines.withColumn("file_line", F.floor(F.col("file_line") / 8))
    return formats.detect(lines).select("log_path", "log_format")


@query(f"SELECT event_id, strftime(log_time, {FMT}) AS log_time, log_level, user_id, k FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM {EVENTS})")
def i6_json_lines_parse(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.to_json(F.struct("event_id", stamp("log_time").alias("ts"), F.upper("log_level").alias("lvl"), "user_id", F.get_json_object("props", "$.k").alias("k")))
    out = structured.parse_json(e.select(line.alias("value")), "event_id bigint, ts string, lvl string, user_id bigint", "ts", "lvl")
    return out.select("event_id", stamp("log_time").alias("log_time"), "log_level", "user_id", F.col("extras")["k"].alias("k"))


@query(f"SELECT event_id, strftime(log_time, {FMT}) AS log_time, log_level, event_type || ' of ' || user_id AS log_body, CAST(value AS DOUBLE) AS value FROM {EVENTS}")
def i7_logfmt_parse(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(' time="'), stamp("log_time"), F.lit('" level='), F.col("log_level"), F.lit(' msg="'), F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string"), F.lit('" value='), F.col("value").cast("string"))
    out = structured.parse_logfmt(e.select(line.alias("line")), "line")
    return out.select(F.col("fields")["id"].cast("bigint").alias("event_id"), stamp("log_time").alias("log_time"), "log_level", "log_body", F.col("fields")["value"].cast("double").alias("value"))


@query("SELECT event_id, CASE WHEN event_id < 500 THEN user_id ELSE NULL END AS uid, event_type AS service FROM events")
def i8_zeek_parse(spark, sf_dir):
    e = events(spark, sf_dir)
    row = F.concat_ws("\t", F.col("event_id").cast("string"), F.when(F.col("event_id") < 500, F.col("user_id").cast("string")).otherwise("-"), "event_type")
    rows = e.select("log_path", (F.col("file_line") + 10).alias("file_line"), row.alias("value"))
    heads = e.select("log_path").distinct().select("log_path", F.lit(1).cast("bigint").alias("file_line"), F.lit("#fields\tid\tuid\tservice").alias("value"))
    out = structured.parse_zeek(rows.unionByName(heads))
    return out.select(F.col("fields")["bro_id"].cast("bigint").alias("event_id"), F.col("fields")["bro_uid"].cast("bigint").alias("uid"), F.col("fields")["bro_service"].alias("service"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS log_time, event_type AS method FROM events")
def i9_w3c_parse(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.select("log_path", (F.col("file_line") * 4 + 8).alias("file_line"), F.concat_ws(" ", F.date_format("log_time", "HH:mm:ss"), F.col("event_id").cast("string"), "event_type").alias("value"))
    days = e.select("log_path", (F.col("file_line") * 4 + 7).alias("file_line"), F.concat(F.lit("#Date: "), F.date_format("log_time", "yyyy-MM-dd HH:mm:ss")).alias("value"))
    heads = e.select("log_path").distinct().select("log_path", F.lit(0).cast("bigint").alias("file_line"), F.lit("#Fields: time x-id cs-method").alias("value"))
    out = structured.parse_w3c(rows.unionByName(days).unionByName(heads))
    return out.select(F.col("fields")["x-id"].cast("bigint").alias("event_id"), stamp("log_time").alias("log_time"), F.col("fields")["cs-method"].alias("method"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS log_level, 'v ' || user_id AS body FROM events")
def i10_generic_log(spark, sf_dir):
    e = events(spark, sf_dir)
    word = F.when(F.col("log_level") == "error", "ERR").when(F.col("log_level") == "warning", "Warn").otherwise("info")
    line = F.concat(F.date_format("log_time", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), word, F.lit(": v "), F.col("user_id").cast("string"))
    return formats.parse(e.select("event_id", line.alias("value")), formats.FORMATS["generic_log"]).select("event_id", "log_level", "body")


@query(f"SELECT event_id, strftime(date_trunc('second', ts), {FMT}) AS log_time, 'host' || user_id AS log_hostname, event_type AS body FROM events")
def i11_syslog_times(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.concat(F.date_format("log_time", "MMM "), F.lpad(F.date_format("log_time", "d"), 2, " "), F.date_format("log_time", " HH:mm:ss"), F.lit(" host"), F.col("user_id").cast("string"), F.lit(" app[7]: "), F.col("event_type"))
    out = formats.parse(e.select("event_id", line.alias("value")), formats.FORMATS["syslog_log"], year=2024)
    return out.select("event_id", stamp("log_time").alias("log_time"), "log_hostname", "body")


@query(f"SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 350 DAYS, {FMT}) AS log_time FROM events")
def i12_year_rollover(spark, sf_dir):
    """Stamps without a year that run from December into January, read as of the later year."""
    e = events(spark, sf_dir)
    later = F.col("log_time") + F.expr("INTERVAL 350 DAYS")
    line = F.concat(F.date_format(later, "MMM "), F.lpad(F.date_format(later, "d"), 2, " "), F.date_format(later, " HH:mm:ss"), F.lit(" host app[7]: "), F.col("event_type"))
    log = formats.parse(e.select("event_id", F.lit("all").alias("log_path"), "file_line", line.alias("value")), formats.FORMATS["syslog_log"], year=2025)
    return M.repair_rollover(log).select("event_id", stamp("log_time").alias("log_time"))


@query(f"SELECT event_id, log_path, strftime(max(t) OVER w, {FMT}) AS log_time, max(t) OVER w > t AS time_skewed FROM (SELECT *, ts - CASE WHEN event_id % 7 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS t FROM {EVENTS}) WINDOW w AS (PARTITION BY log_path ORDER BY file_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def i14_time_skew(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("log_time", F.when(F.col("event_id") % 7 == 0, F.col("log_time") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("log_time")))
    return M.repair_skew(e).select("event_id", "log_path", stamp("log_time").alias("log_time"), "time_skewed")


@query(f"SELECT event_id, strftime(ts + CASE WHEN event_id % 8 = 1 THEN INTERVAL 1500 MILLISECOND ELSE INTERVAL 60 SECOND END, {FMT}) AS log_time FROM events")
def i15_file_offsets(spark, sf_dir):
    options = spark.createDataFrame([("file", "UTC", 60_000), ("file1", "UTC", 1_500)], "prefix string, zone string, offset_ms bigint")
    return M.offset_files(events(spark, sf_dir), options).select("event_id", stamp("log_time").alias("log_time"))


@query("SELECT event_id, concat_ws(',', CASE WHEN event_type IN ('click', 'view') THEN 'visit' END, CASE WHEN event_type = 'purchase' THEN 'sale' END, CASE WHEN event_type LIKE '%e%' THEN 'e' END) AS tags FROM events")
def i19_auto_tags(spark, sf_dir):
    out = M.tag(events(spark, sf_dir), {"visit": "^(click|view)$", "sale": "purchase", "e": "e"}, "event_type")
    return out.select("event_id", F.array_join("log_tags", ",").alias("tags"))


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN 'user ' || user_id END IGNORE NULLS) OVER (PARTITION BY log_path ORDER BY file_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS log_part FROM {EVENTS}")
def i20_auto_partitions(spark, sf_dir):
    starts = F.when(F.col("event_type") == "signup", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return M.partition(events(spark, sf_dir), starts, ["log_path"], "file_line").select("event_id", "log_part")


@query("SELECT 'c' || (user_id % 4) AS mux_id, event_type AS body, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2")
def i21_demultiplex(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.when(F.col("event_id") % 10 == 0, F.lit("-- control --")).otherwise(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string"), F.lit(" | "), F.col("event_type")))
    return M.demultiplex(e.select(line.alias("value")), r"^(c\d+)\s+\|()\s(.*)$").groupBy("mux_id", "body").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, strftime(log_time, {FMT}) AS log_time, log_level, event_type AS log_body, 'shop' AS service, user_id::VARCHAR AS uid FROM {EVENTS}")
def i22_otlp_shred(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service","value":{"stringValue":"shop"}}]},"scopeLogs":[{"scope":{"name":"s"},"logRecords":[{"timeUnixNano":"'), (F.unix_micros("log_time") * 1000).cast("string"),
        F.lit('","severityText":"'), F.upper("log_level"), F.lit('","body":{"stringValue":"'), F.col("event_type"), F.lit('"},"attributes":[{"key":"id","value":{"intValue":"'), F.col("event_id").cast("string"),
        F.lit('"}},{"key":"uid","value":{"stringValue":"'), F.col("user_id").cast("string"), F.lit('"}}]}]}]}]}'),
    )
    out = structured.shred_otlp(e.select(line.alias("value")))
    return out.select(F.col("attributes")["id"].cast("bigint").alias("event_id"), stamp("log_time").alias("log_time"), "log_level", "log_body", F.col("resource")["service"].alias("service"), F.col("attributes")["uid"].alias("uid"))


@query(f"SELECT log_path, count(*) AS lines, strftime(min(log_time), {FMT}) AS first_time, strftime(max(log_time), {FMT}) AS last_time FROM {EVENTS} GROUP BY 1")
def i23_file_inventory(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"value": F.col("event_type"), "log_format": F.lit("x")})
    return structured.inventory(e).select("log_path", "lines", stamp("first_time").alias("first_time"), stamp("last_time").alias("last_time"))


@query(f"SELECT log_path, count(*) AS lines FROM {EVENTS} WHERE log_path IN (SELECT min(p) FROM (SELECT log_path AS p, arg_min(event_type, file_line) AS f FROM {EVENTS} GROUP BY 1) GROUP BY f) GROUP BY 1")
def i25_duplicate_files(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("value", F.col("event_type"))
    return structured.without_duplicate_files(e).groupBy("log_path").agg(F.count("*").alias("lines"))


@query("SELECT s.message, count(*) AS hits FROM (VALUES (200, 'OK'), (404, 'Not Found'), (500, 'Internal Server Error')) AS s(status, message) JOIN " + ACCESS + " ON sc_status = status GROUP BY 1")
def i27_status_dimension(spark, sf_dir):
    log = access_log(spark, sf_dir)
    return log.join(T.http_status_codes(spark), F.col("sc_status") == F.col("status")).groupBy("message").agg(F.count("*").alias("hits"))


@query("SELECT event_id, event_type AS text FROM events")
def i29_ansi_scrub(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;31m"), F.col("event_type"), F.lit("\x1b[0m"))
    return events(spark, sf_dir).select("event_id", structured.scrub_ansi(coloured).alias("text"))


@query("SELECT log_opid, count(*) AS n FROM (SELECT sha256('10.0.0.' || user_id || chr(31) || 'agent' || (user_id % 3)) AS log_opid FROM events) GROUP BY 1")
def i17_operation_ids(spark, sf_dir):
    return access_log(spark, sf_dir).groupBy("log_opid").agg(F.count("*").alias("n"))


# -- sinks ---------------------------------------------------------------------------------


@query("SELECT event_type, '[' || string_agg(event_id::VARCHAR, ',' ORDER BY event_id) || ']' AS ids FROM events GROUP BY 1")
def k4_columns_as_json(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.to_json(F.array_sort(F.collect_list("event_id"))).alias("ids"))


# -- filters ----------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_type WHEN 'error' THEN '1' ELSE '2' END AS filters FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 10 <> 3")
def f2_filter_stack(spark, sf_dir):
    body = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    rules = [(1, "in", "^error"), (2, "in", "^purchase"), (3, "out", "3$")]
    out = M.filter_rows(events(spark, sf_dir).withColumn("log_body", body), rules)
    return out.select("event_id", F.array_join(F.transform("log_filters", lambda x: x.cast("string")), ",").alias("filters"))


@query("SELECT event_id FROM events WHERE value > 400 AND event_type <> 'view'")
def f3_filter_expression(spark, sf_dir):
    return M.filter_expr(events(spark, sf_dir), ":value > 400 AND :event_type <> 'view'").select("event_id")


@query("SELECT event_type, count(*) FILTER (WHERE value > 100) AS marked FROM events GROUP BY 1")
def f4_mark_expression(spark, sf_dir):
    return M.mark_expr(events(spark, sf_dir), "value > 100").groupBy("event_type").agg(F.count_if("log_mark").alias("marked"))


@query(f"SELECT event_id, log_level FROM {EVENTS} WHERE log_level IN ('warning', 'error')")
def f5_minimum_level(spark, sf_dir):
    return M.at_least(events(spark, sf_dir), "warning").select("event_id", "log_level")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06 12:00:00'")
def f6_time_bounds(spark, sf_dir):
    return M.between(events(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-06 12:00:00").select("event_id")


@query("SELECT 1 AS filter_id, 'in' AS kind, count(*) FILTER (WHERE event_type LIKE '%e%')::BIGINT AS hits FROM events UNION ALL SELECT 2, 'out', count(*) FILTER (WHERE event_type LIKE 'c%') FROM events")
def f8_filter_statistics(spark, sf_dir):
    return M.filter_statistics(events(spark, sf_dir), [(1, "in", "e"), (2, "out", "^c")], "event_type").select("filter_id", "kind", "hits")


@query("SELECT p_partkey FROM part WHERE p_name GLOB '*a?e*' AND lower(p_brand) LIKE 'brand#1%'")
def f10_glob_and_like(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike(M.glob_regex("*a?e*")) & F.col("p_brand").ilike("BRAND#1%")).select("p_partkey")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'second' WHEN event_id % 3 = 0 THEN 'first' END AS log_comment FROM events")
def f14_metadata_write_back(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.where("event_id % 3 = 0").select("log_path", "file_line", F.lit("first").alias("log_comment"), F.lit(1).alias("version"))
    second = e.where("event_id % 5 = 0").select("log_path", "file_line", F.lit("second").alias("log_comment"), F.lit(2).alias("version"))
    return M.write_back(e, first.unionByName(second), ["log_path", "file_line"], ["log_comment"], "version").select("event_id", "log_comment")


# -- joins -----------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def j1_equi_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_id, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM events")
def j3_next_lines_join(spark, sf_dir):
    hit = F.when(F.col("event_type") == "error", F.col("event_id"))
    out = M.following(events(spark, sf_dir), ["user_id"], ["log_time", "event_id"], "errors", hit, 10)
    return out.select("event_id", F.size("errors").cast("bigint").alias("n"))


@query("SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS purchase FROM events")
def j5_next_event_pairing(spark, sf_dir):
    hit = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return M.next_match(events(spark, sf_dir), ["user_id"], ["log_time", "event_id"], "purchase", hit).select("event_id", "purchase")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS some FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j7_anti_join(spark, sf_dir):
    """Customers without an urgent order (anti join), and whether they have one in progress (semi join)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    rows = c.join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    started = o.where("o_orderstatus = 'P'")
    some = rows.join(started, F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("some", F.lit(True))
    return some.unionByName(rows.join(started, F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("some", F.lit(False)))


# -- aggregates ---------------------------------------------------------------------------------


@query("SELECT event_type, round(sum(value), 4) AS total, round(stddev_samp(value), 6) AS stdev, round(var_samp(value), 4) AS variance FROM events GROUP BY 1")
def a5_total_and_deviation(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(A.total("value"), 4).alias("total"), F.round(A.stdev("value"), 6).alias("stdev"), F.round(A.variance("value"), 4).alias("variance"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, max(n) AS n FROM n GROUP BY 1) SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS mode FROM n JOIN m USING (user_id, n) GROUP BY 1")
def a6_mode(spark, sf_dir):
    return A.mode_of(table(spark, sf_dir, "events"), ["user_id"], "event_type")


_CUT = "round((min(value) FILTER (WHERE n_to * {b} >= n * {a}) + min(value) FILTER (WHERE n_to * {b} > n * {a})) / 2, 6)"


@query(f"SELECT user_id, {_CUT.format(a=1, b=2)} AS med, {_CUT.format(a=1, b=4)} AS lower, {_CUT.format(a=3, b=4)} AS upper FROM (SELECT user_id, value, count(*) OVER (PARTITION BY user_id ORDER BY value) AS n_to, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1")
def a7_median(spark, sf_dir):
    """A cut between two values is their mean; a cut that falls on a value is that value."""
    out = A.quantiles_of(table(spark, sf_dir, "events"), ["user_id"], "value", med=(1, 2), lower=(1, 4), upper=(3, 4))
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("med", "lower", "upper")))


_MEMBERS = "'{{' || string_agg('\"' || event_type || '\":' || {v}, ',' ORDER BY event_type) || '}}'"


@query(f"SELECT user_id, {_MEMBERS.format(v='n')} AS counts, {_MEMBERS.format(v='s')} AS sums FROM (SELECT user_id, event_type, count(*) AS n, sum(event_id)::BIGINT AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def a9_json_object_of_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.object_of(e, ["user_id"], "counts", "event_type", F.count("*")).join(A.sum_object(e, ["user_id"], "sums", "event_type", "event_id"), "user_id")


@query("SELECT event_type, count(value) AS value_count, round(sum(value), 4) AS value_sum, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY 1")
def a14_column_statistics(spark, sf_dir):
    out = A.column_statistics(table(spark, sf_dir, "events"), ["event_type"], ["value"])
    return out.select("event_type", "value_count", F.round("value_sum", 4).alias("value_sum"), "value_min", "value_max")


@query("SELECT event_type, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users FROM events GROUP BY 1")
def a3_group_concat(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",").alias("users"))


# -- windows, sets ---------------------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dense, round(percent_rank() OVER w, 6) AS percent, round(cume_dist() OVER w, 6) AS cumulated, lag(event_id, 1, -1) OVER w AS before, lead(event_id) OVER w AS after, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)")
def w1_window_functions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    one = lambda f: f.over(w)
    kinds = Window.partitionBy("user_id").orderBy("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", one(F.row_number()).cast("bigint").alias("rn"), one(F.rank()).cast("bigint").alias("rk"), one(F.ntile(4)).cast("bigint").alias("quarter"), F.dense_rank().over(kinds).cast("bigint").alias("dense"), F.round(one(F.percent_rank()), 6).alias("percent"), F.round(one(F.cume_dist()), 6).alias("cumulated"), one(F.lag("event_id", 1, -1)).alias("before"), one(F.lead("event_id")).alias("after"), one(F.first("event_id")).alias("first")
    )


@query(
    "SELECT 'except' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE value > 300) "
    "UNION ALL SELECT 'intersect', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE value > 300) "
    "UNION ALL SELECT 'union', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE value > 300) "
    "UNION ALL SELECT 'all', user_id FROM events WHERE event_type = 'error'"
)
def w9_set_operations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.where("event_type = 'error'").select("user_id"), e.where("value > 300").select("user_id")
    parts = {"except": a.distinct().exceptAll(b.distinct()), "intersect": a.intersect(b), "union": a.union(b).distinct(), "all": a}
    out = [x.select(F.lit(kind).alias("kind"), "user_id") for kind, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("WITH RECURSIVE d AS (SELECT date_trunc('day', min(ts)) AS day, date_trunc('day', max(ts)) AS last FROM events UNION ALL SELECT day + INTERVAL 1 DAY, last FROM d WHERE day < last) SELECT strftime(day, '%Y-%m-%d') AS day, count(e.event_id) AS errors FROM d LEFT JOIN events e ON date_trunc('day', e.ts) = d.day AND e.event_type = 'error' GROUP BY 1")
def w10_recursive_query(spark, sf_dir):
    """Every day from the first event to the last, by recursion, and its errors."""
    events(spark, sf_dir).createOrReplaceTempView("message_rows")
    days = (
        "WITH RECURSIVE d(day, last) AS (SELECT to_date(min(log_time)), to_date(max(log_time)) FROM message_rows UNION ALL SELECT date_add(day, 1), last FROM d WHERE day < last) "
        "SELECT date_format(day, 'yyyy-MM-dd') AS day, count(event_id) AS errors FROM d LEFT JOIN message_rows ON to_date(log_time) = day AND event_type = 'error' GROUP BY 1"
    )
    return spark.sql(days)


@query(f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE {LEVEL} WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, event_id) AS place FROM events")
def w6_order_by_level(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(X.level_ordinal("log_level").desc(), "event_id")
    return events(spark, sf_dir).select("event_id", F.row_number().over(w).cast("bigint").alias("place"))


# -- content --------------------------------------------------------------------------------------


@query("SELECT event_type || ' of user # took # ms for #' AS format, count(*) AS total FROM events GROUP BY 1 HAVING count(*) > 1")
def d1_message_templates(spark, sf_dir):
    """One template for each kind of event: its word stays, the numbers and the quoted text go."""
    body = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" took "), F.col("value").cast("string"), F.lit(' ms for "item '), F.col("event_id").cast("string"), F.lit('"'))
    return A.format_summary(events(spark, sf_dir).withColumn("log_body", body)).select("format", "total")


@query("SELECT event_id, user_id::VARCHAR AS uid, event_type AS kind FROM events")
def d2_field_discovery(spark, sf_dir):
    body = F.concat(F.lit("uid="), F.col("user_id").cast("string"), F.lit(' kind: "'), F.col("event_type"), F.lit('" end'))
    out = events(spark, sf_dir).select("event_id", A.fields_of(body).alias("f"))
    return out.select("event_id", F.col("f")["uid"].alias("uid"), F.col("f")["kind"].alias("kind"))


@query(r"SELECT doc_id, (i - 1)::BIGINT AS match_index, split_part(m, '@', 1) AS name, split_part(m, '@', 2) AS host FROM (SELECT doc_id, unnest(l) AS m, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[a-z][a-z0-9.]*@[a-z0-9]+\.[a-z]+') AS l FROM documents))")
def d4_search_table(spark, sf_dir):
    return A.search_table(table(spark, sf_dir, "documents"), r"([a-z][a-z0-9.]*)@([a-z0-9]+\.[a-z]+)", ["name", "host"], ["doc_id"], "text", literal="@")


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages")
def d13_url_parts(spark, sf_dir):
    out = table(spark, sf_dir, "pages").select("page_id", A.url_parts("url").alias("u"))
    return out.select("page_id", "u.scheme", "u.host", "u.path", "u.query", "u.fragment")


_PLAIN = P.PLAIN.replace("'", "''")
_HASH = "sha256('salt' || found[i])"
_STAND_IN = f"({list(P.STAND_INS)})[strpos('0123456789abcdef', {_HASH}[1])] || '-' || ({list(P.STAND_INS)})[strpos('0123456789abcdef', {_HASH}[2])] || '-' || substr({_HASH}, 3)"


@query(
    f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(range(1, len(between_) + 1), lambda i: between_[i] || CASE WHEN i <= len(found) THEN {_STAND_IN} ELSE '' END), '') END AS text, form "
    f"FROM (SELECT doc_id, text, string_split_regex(text, '{_PLAIN}') AS between_, regexp_extract_all(text, '{_PLAIN}') AS found, sha256(regexp_replace(text, '[A-Za-z0-9]+', 'x', 'g')) AS form FROM documents)"
)
def d10_anonymize(spark, sf_dir):
    """The whole texts with personal tokens replaced by their hashes; and with tokens and words permuted, the texts' form as it was."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = P.anonymize(P.hashed(docs, "text", "hashed", "salt"), "text", "salt", words=True)
    return out.select("doc_id", F.col("hashed").alias("text"), F.sha2(F.regexp_replace("text", "[A-Za-z0-9]+", "x"), 256).alias("form"))


_TOKENS = {"email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "ipv4": r"\b(?:\d{1,2}|1\d\d)(?:\.(?:\d{1,2}|1\d\d)){3}\b", "phone": r"\+\d[\d ()-]{7,}\d", "word": r"[A-Za-z]{5,}"}
_FOUND = " UNION ALL ".join(f"SELECT '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM documents" for kind, pattern in _TOKENS.items())


@query(f"SELECT kind, count(*)::BIGINT AS tokens, count(DISTINCT value)::BIGINT AS n_values, count(DISTINCT value)::BIGINT AS n_stand_ins, count(*)::BIGINT AS of_the_kind FROM ({_FOUND}) GROUP BY 1")
def d10_stand_ins(spark, sf_dir):
    """As many stand-ins as values of each kind, all of that kind."""
    docs = table(spark, sf_dir, "documents")
    parts = [docs.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("value")) for kind, pattern in _TOKENS.items()]
    counts = functools.reduce(DataFrame.unionByName, parts).groupBy("kind", "value").agg(F.count("*").alias("n"))
    rows = P.stand_ins(counts, "value", "kind", salt="salt")
    fits = F.lit(False)
    for kind, pattern in (*P.KINDS, P.WORD):
        fits = F.when(F.col("kind") == kind, F.col("stand_in").rlike(f"^(?:{pattern})$")).otherwise(fits)
    return rows.groupBy("kind").agg(F.sum("n").alias("tokens"), F.count_distinct("value").alias("n_values"), F.count_distinct("stand_in").alias("n_stand_ins"), F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("of_the_kind"))


# -- analytics --------------------------------------------------------------------------------------


@query(f"SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), {FMT}) AS slice, count(*) AS n FROM events GROUP BY 1")
def q1_time_slice(spark, sf_dir):
    return events(spark, sf_dir).groupBy(stamp(A.time_slice("log_time", 900)).alias("slice")).agg(F.count("*").alias("n"))


@query(f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {FMT}) AS bucket, count(*) FILTER (WHERE log_level = 'info') AS normal, count(*) FILTER (WHERE log_level = 'warning') AS warnings, count(*) FILTER (WHERE log_level = 'error') AS errors FROM {EVENTS} GROUP BY 1")
def q2_log_histogram(spark, sf_dir):
    return A.histogram(events(spark, sf_dir), 3600).withColumn("bucket", stamp("bucket"))


@query("SELECT c_ip, count(*) AS total FROM " + ACCESS + " GROUP BY 1")
def q3_count_by(spark, sf_dir):
    return A.count_by(access_log(spark, sf_dir), "c_ip")


@query(f"WITH n AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, user_id::VARCHAR AS v, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, v) AS k FROM n) SELECT strftime(b, {FMT}) AS bucket, CASE WHEN k < 10 THEN v ELSE 'Other' END AS value, sum(n)::BIGINT AS total FROM r GROUP BY 1, 2")
def q4_top_values_by_slice(spark, sf_dir):
    return A.top_values(events(spark, sf_dir), 86_400, "user_id").withColumn("bucket", stamp("bucket"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity, min(l_quantity) AS min_l_quantity, round(avg(l_quantity), 6) AS avg_l_quantity, median(l_quantity) AS median_l_quantity, round(stddev_samp(l_quantity), 6) AS stddev_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1, 2")
def q5_summarize(spark, sf_dir):
    out = A.summarize(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"])
    return out.withColumns({"sum_l_quantity": F.round("sum_l_quantity", 2), "avg_l_quantity": F.round("avg_l_quantity", 6), "stddev_l_quantity": F.round("stddev_l_quantity", 6)})


def _report(name: str, keys: str, sql: str):
    def run(spark, sf_dir):
        out = A.access_report(access_log(spark, sf_dir))[name]
        return out.withColumn("day", F.col("day").cast("string")) if name == "days" else out

    run.__name__ = f"q7_report_{name}"
    block = "count(*) AS hits, count(DISTINCT (c_ip, cs_user_agent)) AS visitors, sum(sc_bytes)::BIGINT AS bytes"
    share = "" if name == "totals" else ", 100.0 * count(*) / (SELECT count(*) FROM events) AS percent"
    return query(sql.format(block=block + share, t=ACCESS, keys=keys))(run)


_report("totals", "", "SELECT {block} FROM {t}")
_report("days", "", "SELECT strftime(log_time, '%Y-%m-%d') AS day, {block} FROM {t} GROUP BY 1")
_report("uris", "", "SELECT cs_uri_stem, cs_method, {block} FROM {t} GROUP BY 1, 2 ORDER BY hits DESC, 1, 2 LIMIT 10")
_report("missing", "", "SELECT cs_uri_stem, {block} FROM {t} WHERE sc_status = 404 GROUP BY 1 ORDER BY hits DESC, 1 LIMIT 10")
_report("addresses", "", "SELECT c_ip, {block} FROM {t} GROUP BY 1 ORDER BY hits DESC, 1 LIMIT 10")
_report("referrers", "", "SELECT cs_referer AS referrer, {block} FROM (SELECT *, 'shop' || (event_id % 3) || '.example' AS cs_referer FROM {t}) WHERE event_id % 2 = 0 GROUP BY 1 ORDER BY hits DESC, 1 LIMIT 10")
_report("classes", "", "SELECT (sc_status // 100)::BIGINT AS class, {block} FROM {t} GROUP BY 1")


@query(f"SELECT user_id, strftime(min(ts), {FMT}) AS earliest, strftime(max(ts), {FMT}) AS latest, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration, count(*) AS total, count(*) FILTER (WHERE log_level = 'error') AS errors, count(*) FILTER (WHERE log_level = 'warning') AS warnings, arg_min(event_type, ts) AS description FROM {EVENTS} GROUP BY 1")
def q8_operations(spark, sf_dir):
    out = M.operations(events(spark, sf_dir), "user_id", "event_type")
    return out.withColumns({"earliest": stamp("earliest"), "latest": stamp("latest")})


@query(f"SELECT log_path, strftime(min(ts), {FMT}) AS earliest, strftime(max(ts), {FMT}) AS latest, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration, count(*) AS total, count(*) FILTER (WHERE log_level = 'error') AS errors, count(*) FILTER (WHERE log_level = 'warning') AS warnings FROM {EVENTS} GROUP BY 1")
def q10_threads(spark, sf_dir):
    """The same shape as operations, one row for each thread; files stand for threads."""
    return M.operations(events(spark, sf_dir), "log_path").withColumns({"earliest": stamp("earliest"), "latest": stamp("latest")})


_SPAN = f"strftime(min(ts), {FMT}) AS start, strftime(max(ts), {FMT}) AS stop, count(*) AS total, count(*) FILTER (WHERE log_level = 'error') AS errors, count(*) FILTER (WHERE log_level = 'warning') AS warnings FROM {EVENTS}"


@query(
    f"SELECT 'file' AS kind, log_path AS name, {_SPAN} GROUP BY 2 UNION ALL SELECT 'operation', user_id::VARCHAR, {_SPAN} GROUP BY 2 UNION ALL SELECT 'thread', 't' || (user_id % 4), {_SPAN} GROUP BY 2 "
    f"UNION ALL SELECT 'partition', CASE WHEN event_id < 100 THEN 'early' END, {_SPAN} WHERE event_id < 100 GROUP BY 2 UNION ALL SELECT 'tag', 'visit', {_SPAN} WHERE event_type IN ('click', 'view') GROUP BY 2 UNION ALL SELECT 'tag', 'e', {_SPAN} WHERE event_type LIKE '%e%' GROUP BY 2"
)
def q11_timeline(spark, sf_dir):
    e = M.tag(events(spark, sf_dir), {"visit": "^(click|view)$", "e": "e"}, "event_type")
    thread = F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))
    kinds = {"file": "log_path", "operation": "user_id", "thread": thread, "tag": "log_tags", "partition": F.when(F.col("event_id") < 100, "early")}
    return A.timeline(e, kinds).withColumns({"start": stamp("start"), "stop": stamp("stop")})


@query(f"WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), {FMT}) AS bucket, floor((value - lo) / ((hi - lo) / 19))::BIGINT AS cell, count(*) AS total FROM events, r GROUP BY 1, 2")
def q12_spectrogram(spark, sf_dir):
    return A.spectrogram(events(spark, sf_dir), "value", 86_400, 20).select(stamp("bucket").alias("bucket"), "cell", "total")


@query(f"SELECT event_id, coalesce(((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY log_path ORDER BY file_line))) // 1000), 0)::BIGINT AS log_idle_msecs FROM {EVENTS}")
def q13_idle_gaps(spark, sf_dir):
    return M.idle(events(spark, sf_dir)).select("event_id", "log_idle_msecs")


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS seconds FROM events")
def q15_time_difference(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(A.time_difference(stamp("log_time"), F.lit("2024-01-01 00:00:00")), 6).alias("seconds"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+0900' AS tokyo, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '-0500' AS new_york FROM events")
def q16_zone_conversion(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", A.in_zone("log_time", "Asia/Tokyo").alias("tokyo"), A.in_zone("log_time", "America/New_York").alias("new_york"))


@query("SELECT session_user, count(*) AS n FROM (SELECT user_id AS session_user, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY session_user, s")
def x8_session_windows(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(F.session_window("log_time", "6 hours"), F.col("user_id").alias("session_user")).agg(F.count("*").alias("n")).select("session_user", "n")


# -- scalar functions over the tables ---------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 30 THEN p_name ELSE lpad(p_name, 30, ' ') END AS l, CASE WHEN length(p_name) >= 30 THEN p_name ELSE rpad(p_name, 30, '.') END AS r FROM part")
def s_pads(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.pad_left("p_name", 30).alias("l"), X.pad_right("p_name", 30, ".").alias("r"))


@query("SELECT o_orderkey, CASE WHEN v >= 1e6 THEN printf('%.1fMB', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fKB', v / 1e3) ELSE v::BIGINT || 'B' END AS size FROM (SELECT o_orderkey, floor(o_totalprice) * 10 + 3 AS v FROM orders)")
def s_humanized_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.humanize_size(F.floor("o_totalprice") * 10 + 3).alias("size"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def s_json_pointers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.json_pointer("props", "/k").alias("k"), X.json_pointer("props", "/missing", "none").alias("missing"))


@query("SELECT event_id, row_number() OVER (ORDER BY user_id % 50, user_id % 7, event_id) AS place FROM events")
def s_natural_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("file"), (F.col("user_id") % 50).cast("string"), F.lit("-"), (F.col("user_id") % 7).cast("string"))
    return numbered(e.select("event_id", X.natural_key(name).alias("name")), ["name", "event_id"], "place").select("event_id", "place")


@query("SELECT event_id, (user_id + 256 * 10)::BIGINT AS number FROM events")
def s_address_numbers(spark, sf_dir):
    """Every user has an address of their own, counted on from ::ffff:0.0.10.0 over all four bytes."""
    n = F.col("user_id") + 256 * 10
    address = F.concat(F.lit("::ffff:"), F.concat_ws(".", *(F.shiftright(n, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0))))
    return table(spark, sf_dir, "events").select("event_id", X.ipv4_number(address).alias("number"))


@query("SELECT p_partkey, round(p_size * 1024, 3) AS bytes FROM part")
def s_measures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.measure(F.concat(F.col("p_size").cast("string"), F.lit(" KiB"))), 3).alias("bytes"))
