"""Conformance of what Spark has itself, and queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlog.functions import text as X
from strandlog.operators import analytics as A
from strandlog.operators import discovery as D
from strandlog.operators import messages as M
from strandlog.operators import tables as T
from strandlog.plans.queries import EVENTS, FMT, events, stamp, table
from strandlog.plans.registry import query


@query("SELECT n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def j2_dimension_joins(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    out = n.join(r, n.n_regionkey == r.r_regionkey).join(s, s.s_nationkey == n.n_nationkey, "left")
    return out.groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("SELECT event_id, lead(event_id) OVER w AS next_start FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def j4_next_start(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("log_time", "event_id")
    return events(spark, sf_dir).where("event_type = 'signup'").select("event_id", F.lead("event_id").over(w).alias("next_start"))


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)")
def j6_neighbouring_matches(spark, sf_dir):
    w = Window.partitionBy("event_type", "user_id").orderBy("log_time", "event_id")
    return events(spark, sf_dir).select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("SELECT c_mktsegment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j8_joins_by_side(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "right").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def j9_lateral_json_members(spark, sf_dir):
    return T.json_each(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


@query("SELECT event_id, log_path FROM " + EVENTS + " WHERE log_path IN ('file1', 'file2')")
def j10_merge_of_files(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("log_path = 'file1'").unionByName(e.where("log_path = 'file2'")).orderBy("log_time", "log_path", "file_line").select("event_id", "log_path")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events")
def a1_basic_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS bought FROM events GROUP BY 1")
def a4_filtered_aggregates(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("event_rows")
    return spark.sql("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS bought FROM event_rows GROUP BY user_id")


@query("SELECT user_id, '[' || string_agg(event_id::VARCHAR, ',' ORDER BY event_id) || ']' AS ids FROM events GROUP BY 1")
def a8_json_group_array(spark, sf_dir):
    return A.list_group(table(spark, sf_dir, "events"), ["user_id"], "ids", "event_id", "event_id")


@query("SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || last, ',' ORDER BY event_type) || '}' AS latest FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2) GROUP BY 1")
def a8_json_group_object(spark, sf_dir):
    return A.object_group(table(spark, sf_dir, "events"), ["user_id"], "latest", "event_type", "event_id")


@query("SELECT user_id, sha256(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def a10_group_digest(spark, sf_dir):
    row = F.struct("event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]), ",")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sha2(joined, 256).alias("digest"))


@query("SELECT event_type, string_agg(substr(' ▁▂▃▄▅▆▇█', ceil(n * 8.0 / m)::INTEGER + 1, 1), '' ORDER BY d) AS bars FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n, max(count(*)) OVER (PARTITION BY event_type) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def a11_sparklines(spark, sf_dir):
    days = events(spark, sf_dir).groupBy("event_type", F.date_trunc("day", "log_time").alias("d")).agg(F.count("*").alias("n"))
    top = days.groupBy("event_type").agg(F.max("n").alias("m"))
    bar = F.struct("d", X.spark_bar("n", F.col("m").cast("double")).alias("b"))
    return days.join(top, "event_type").groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(bar)), lambda x: x["b"]), "").alias("bars"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 100")
def a12_group_by_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).where("n > 100")


@query("SELECT DISTINCT user_id, event_type FROM events")
def a13_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("SELECT event_id, first_value(event_id) OVER w AS first, last_value(event_id) OVER w AS last, nth_value(event_id, 2) OVER w AS second, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 100 AS busy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def w3_frames(spark, sf_dir):
    base = Window.partitionBy("user_id").orderBy("event_id")
    w, three = base.rowsBetween(-1, 1), base.rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select(
        "event_id", F.first("event_id").over(w).alias("first"), F.last("event_id").over(w).alias("last"), F.nth_value("event_id", 2).over(w).alias("second"), (F.sum("value").over(three) > 100).alias("busy")
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def w7_limit_and_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def w11_subqueries(spark, sf_dir):
    for name in ("customer", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"{name}_rows")
    return spark.sql("SELECT c_custkey, (SELECT max(o_orderkey) FROM orders_rows WHERE o_custkey = c_custkey) AS last_order FROM customer_rows WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer_rows)")


@query("SELECT event_id, CASE WHEN value > 300 THEN 'big ' || event_type END AS big, CASE WHEN event_type = 'error' THEN user_id::VARCHAR END AS who FROM events WHERE value > 300 OR event_type = 'error'")
def d12_annotations(spark, sf_dir):
    rules = {"big": ("value > 300", F.concat(F.lit("big "), F.col("event_type"))), "who": ("event_type = 'error'", F.col("user_id"))}
    out = T.annotate(events(spark, sf_dir), rules).where(F.size("log_annotations") > 0)
    return out.select("event_id", F.col("log_annotations")["big"].alias("big"), F.col("log_annotations")["who"].alias("who"))


@query("SELECT doc_id, match_index, capture_index, content FROM (SELECT doc_id, unnest(l) AS m, (unnest(range(len(l))))::INTEGER AS match_index FROM (SELECT doc_id, regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+') AS l FROM documents)) CROSS JOIN (VALUES (0), (1), (2)) AS c(capture_index), LATERAL (SELECT CASE capture_index WHEN 0 THEN m ELSE split_part(m, '@', capture_index) END AS content)")
def d6_regexp_captures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", "text")
    return T.regexp_capture(docs, "text", r"([a-z0-9.]+)@([a-z0-9.]+)").select("doc_id", "match_index", "capture_index", "content")


@query("SELECT event_id, '[{\"type\":\"' || event_type || '\",\"id\":' || user_id || '}]' AS found FROM events")
def d7_captures_as_json(spark, sf_dir):
    line = F.concat("event_type", F.lit("="), F.col("user_id").cast("string"))
    found = X.captures_json(line, r"([a-z]+)=(\d+)", ["type", "id"])
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")).alias("found"))


@query("SELECT event_id, '/e/u[' || i || ']' AS node_path, CASE i WHEN 1 THEN event_type ELSE user_id::VARCHAR END AS node_text FROM events, (VALUES (1), (2)) AS t(i)")
def d8_xpath_nodes(spark, sf_dir):
    xml = F.concat(F.lit('<e><u a="1">'), F.col("event_type"), F.lit("</u><u>"), F.col("user_id").cast("string"), F.lit("</u></e>"))
    return T.xpath_nodes(table(spark, sf_dir, "events").select("event_id", xml.alias("x")), "x", "./u").select("event_id", "node_path", "node_text")


@query(
    "SELECT event_id, 'ids' AS asked, 0 AS match_index, event_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, 'ids', 1, user_id::VARCHAR FROM events UNION ALL SELECT event_id, 'first', 0, event_type FROM events "
    "UNION ALL SELECT event_id, 'count', 0, '3' FROM events UNION ALL SELECT event_id, 'later', 0, 'end' FROM events WHERE event_type = 'error'"
)
def d8_xpath_values(spark, sf_dir):
    """Attributes, places, counts and conditions; every hundredth text is cut off and gives nothing, its whole copy does."""
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    xml = F.concat(F.lit("<e><u id='"), eid, F.lit("'>"), F.col("event_type"), F.lit("</u><u id='"), uid, F.lit("'>two</u><u>end</u></e>"))
    texts = F.when(F.col("event_id") % 100 == 0, F.array(xml, F.substring(xml, F.lit(1), F.length(xml) - 3))).otherwise(F.array(xml))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(texts).alias("x"))
    paths = {"ids": "//@id", "first": "/e/u[position()<2]/text()", "count": "count(//u)", "later": "//u[. = 'error']/following-sibling::u[last()]/text()"}
    return T.xpath_values_of(rows, "x", paths).select("event_id", "asked", "match_index", "value")


_OPENS = "CASE WHEN {i} = 1 OR regexp_matches(n[{i} - 1], '[^a-z0-9]') THEN 3 ELSE 0 END"


@query(
    "WITH p AS (SELECT p_partkey, p_name, lower(p_name) AS n, unnest(range(1, length(p_name) + 1)) AS i FROM part), "
    f"l AS (SELECT p_partkey, p_name, i, n[i] AS ch, 1 + {_OPENS.format(i='i')} AS points FROM p WHERE n[i] IN ('s', 'g', 'z')) "
    "SELECT a.p_partkey, a.p_name, max(a.points + b.points + c.points + CASE WHEN b.i = a.i + 1 THEN 4 ELSE 0 END + CASE WHEN c.i = b.i + 1 THEN 4 ELSE 0 END)::BIGINT AS score "
    "FROM l a JOIN l b USING (p_partkey) JOIN l c USING (p_partkey) WHERE a.ch = 's' AND b.ch = 'g' AND c.ch = 'z' AND a.i < b.i AND b.i < c.i GROUP BY 1, 2 ORDER BY score DESC, 1, 2 LIMIT 50"
)
def d11_fuzzy_search(spark, sf_dir):
    return T.fuzzy_search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "sgz", 50)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN '500 (Internal Server Error)' WHEN 'view' THEN '200 (OK)' ELSE '302' END AS status FROM events")
def f13_value_rewriting(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 200).otherwise(302)
    names = spark.createDataFrame([(200, "OK"), (500, "Internal Server Error")], "code int, message string")
    return T.rewrite(table(spark, sf_dir, "events").select("event_id", status.alias("status")), "status", names, "code", "message")


@query("SELECT event_id FROM events WHERE value > 50 AND event_id % 8 IN (1, 5)")
def f7_marked_messages(spark, sf_dir):
    """Only marked messages, of two chosen files."""
    return M.of_files(T.marked(M.mark_expr(events(spark, sf_dir), "value > 50")), ["file1", "file5"]).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND regexp_matches(props, '\"k\": 7')")
def f9_regex_search(spark, sf_dir):
    return events(spark, sf_dir).where((F.col("event_type") == "error") & F.col("props").rlike('"k": 7')).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'signup')")
def f11_breakpoints(spark, sf_dir):
    body = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"))
    return D.breakpoints(events(spark, sf_dir).withColumn("log_body", body), ["error of user 1", "signup of user 77"]).select("event_id")


@query(f"SELECT user_id, count(*) AS parts, max(total)::BIGINT AS largest FROM (SELECT user_id, event_type, count(*) AS total FROM events GROUP BY 1, 2) GROUP BY 1")
def q9_sub_operations(spark, sf_dir):
    out = T.sub_operations(events(spark, sf_dir), "user_id", "event_type")
    return out.select("user_id", F.size("ranges").cast("bigint").alias("parts"), F.array_max(F.transform("ranges", lambda r: r["total"])).alias("largest"))


@query(f"WITH g AS (SELECT log_path, event_id, ts, file_line, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY log_path ORDER BY ts, file_line))) / 1e6 AS gap FROM {EVENTS}) SELECT event_id, round((avg(gap) OVER w - gap) / greatest(max(gap) OVER w - min(gap) OVER w, 5.0), 4) AS rate_change FROM g WINDOW w AS (PARTITION BY log_path ORDER BY ts, file_line ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def q14_rate_acceleration(spark, sf_dir):
    return A.acceleration(events(spark, sf_dir), ["log_path"]).select("event_id", F.round("rate_change", 4).alias("rate_change"))


@query("SELECT user_id, count(*) AS leases, max(lease) AS longest FROM (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS lease FROM events WHERE event_type = 'signup') WHERE lease IS NOT NULL GROUP BY 1")
def q17_lease_intervals(spark, sf_dir):
    rows = A.leases(events(spark, sf_dir).where("event_type = 'signup'"), ["user_id"], ["log_time", "event_id"]).where("lease is not null")
    return rows.groupBy("user_id").agg(F.count("*").alias("leases"), F.max("lease").alias("longest"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS near, true AS near_median FROM events GROUP BY 1")
def q19_approximate_distinct(spark, sf_dir):
    """Approximate counts within a tenth of the exact ones, and approximate medians within two hundredths of the ranks."""
    e = table(spark, sf_dir, "events")
    found = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5, 1000).alias("median"), F.percentile("value", F.array(F.lit(0.48), F.lit(0.52))).alias("around"))
    return found.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("near"), F.col("median").between(F.col("around")[0], F.col("around")[1]).alias("near_median"))


@query("SELECT p_partkey, round(sin(p_size) + cos(p_size) * tan(p_size / 100.0), 6) AS trig, round(ln(p_size) + log10(p_size) + sqrt(p_size) + exp(p_size / 50.0), 6) AS logs, floor(p_retailprice)::BIGINT AS low, ceil(p_retailprice)::BIGINT AS high, sign(p_size - 25)::DOUBLE AS side FROM part")
def s_math(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.sin(s) + F.cos(s) * F.tan(s / 100.0), 6).alias("trig"), F.round(F.ln(s) + F.log10(s) + F.sqrt(s) + F.exp(s / 50.0), 6).alias("logs"),
        F.floor("p_retailprice").cast("bigint").alias("low"), F.ceil("p_retailprice").cast("bigint").alias("high"), F.signum(s - 25).cast("double").alias("side"),
    )


@query("SELECT p_partkey, upper(p_name) AS u, reverse(p_name) AS r, length(p_name)::BIGINT AS n, substr(p_name, 2, 3) AS part, instr(p_name, 'a')::BIGINT AS place, replace(p_name, 'e', '3') AS changed, left(p_brand, 5) AS l, hex(p_brand) AS h, base64(encode(p_brand)) AS b FROM part")
def s_strings(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("u"), F.reverse(n).alias("r"), F.length(n).cast("bigint").alias("n"), F.substring(n, 2, 3).alias("part"), F.instr(n, "a").cast("bigint").alias("place"),
        F.replace(n, F.lit("e"), F.lit("3")).alias("changed"), F.left("p_brand", F.lit(5)).alias("l"), F.hex("p_brand").alias("h"), F.base64(F.col("p_brand").cast("binary")).alias("b"),
    )


@query(f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 1 MONTH, {FMT}) AS later, round(epoch_us(ts) / 86400e6 + 2440587.5, 4) AS julian, dayofyear(ts)::BIGINT AS doy FROM events")
def s_dates(spark, sf_dir):
    t = F.col("log_time")
    return events(spark, sf_dir).select("event_id", F.date_format(t, "yyyy-MM-dd").alias("day"), stamp(t + F.expr("INTERVAL 1 MONTH")).alias("later"), F.round(A.micros(t) / 86400e6 + 2440587.5, 4).alias("julian"), F.dayofyear(t).cast("bigint").alias("doy"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def u4_bound_variables(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("event_rows")
    return spark.sql("SELECT event_type, count(*) AS n FROM event_rows WHERE value > :least GROUP BY event_type", args={"least": 10})


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' GROUP BY 1")
def u6_pipe_syntax(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("event_rows")
    return spark.sql("FROM event_rows |> WHERE event_type <> 'view' |> AGGREGATE count(*) AS n, round(sum(value), 4) AS total GROUP BY event_type")


@query("SELECT i::BIGINT AS id, count(event_id) AS n FROM range(0, 150, 5) AS t(i) LEFT JOIN events ON user_id = i GROUP BY 1")
def i28_generated_series(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return spark.range(0, 150, 5).join(e, F.col("id") == F.col("user_id"), "left").groupBy("id").agg(F.count("event_id").alias("n"))
