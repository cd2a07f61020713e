"""The format catalogue, discovered and search tables, sinks, JSON functions and scalars on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandlog import sinks
from strandlog.functions import json_text as J
from strandlog.functions import registered
from strandlog.functions import text as X
from strandlog.operators import analytics as A
from strandlog.operators import discovery as D
from strandlog.operators import messages as M
from strandlog.operators import shared
from strandlog.operators import tables as T
from strandlog.operators.carry import numbered
from strandlog.sources import printed_formats, formats, json_formats, structured, times


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_every_sample_is_detected_and_parsed(spark):
    all_formats = formats.catalogue()
    rows = spark.createDataFrame([(n, 0, f.sample) for n, f in all_formats.items()], "log_path string, file_line long, value string")
    assert {r.log_path: r.log_format for r in formats.detect(rows).collect()} == {n: n for n in all_formats}
    assert len(all_formats) >= 32
    for name, f in all_formats.items():
        own = rows.where(F.col("log_path") == name)
        parsed = json_formats.parse_json_format(own, f) if isinstance(f, json_formats.JsonFormat) else formats.parse(own, f, year=2024)
        (got,) = parsed.collect()
        assert got.log_time.replace(microsecond=0) == dt.datetime(2024, 1, 1, 0, 0, 7) or name == "strace_log", name
        assert got.log_format == name and got.log_level != "unknown", name


def test_lines_that_match_no_pattern(spark):
    rows = spark.createDataFrame([("no log line",), ("",), (None,), ("I0101 00:00:07.179575 8 app.cc:69] a\x1fb\x1e",)], "value string")
    got = formats.parse(rows, formats.FORMATS["glog_log"], year=2024, keep=True).collect()
    assert [x.log_level for x in got] == [None, None, None, "info"] and got[3].log_body == "ab"
    assert formats.parse(rows, formats.FORMATS["glog_log"]).count() == 1
    bad = spark.createDataFrame([("{",), ("[1]",), (None,), ('{"level":30}',)], "value string")
    assert json_formats.parse_json_format(bad, json_formats.JSON_FORMATS["pino_log"]).count() == 0


def test_spans(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 10), 2.5), (dt.datetime(2024, 1, 1, 0, 0, 10), None)], "log_time timestamp, duration double")
    end, start = (json_formats.with_spans(rows, k).select(F.unix_micros("span_end") - F.unix_micros("span_start"), F.col("span_end") == F.col("log_time")).collect() for k in ("end", "start"))
    assert [tuple(x) for x in end] == [(2_500_000, True), (0, True)] and [tuple(x) for x in start] == [(2_500_000, False), (0, True)]


def test_json_edit(spark):
    doc = F.lit('{"b":1,"a":{"list":[1,2]},"s":"x"}')
    e = lambda how, path, v: J.json_edit(doc, how, (path, v))
    got = one(
        spark, e("set", "$.b", 7), e("insert", "$.b", 7), e("insert", "$.n", "q\"q"), e("replace", "$.n", 7), e("set", "$.a.list[#]", None), e("set", "$.a.list[0]", True), e("set", "$.a.list[9]", 1),
        e("set", "$.no.such", 1), e("set", '$."b"', 2.5), J.json_remove(doc, "$.a", "$.b"), J.json_remove(doc, "$.a.list[1]"),
    )
    assert got == (
        '{"b":7,"a":{"list":[1,2]},"s":"x"}', '{"b":1,"a":{"list":[1,2]},"s":"x"}', '{"b":1,"a":{"list":[1,2]},"s":"x","n":"q\\"q"}', '{"b":1,"a":{"list":[1,2]},"s":"x"}', '{"b":1,"a":{"list":[1,2,null]},"s":"x"}',
        '{"b":1,"a":{"list":[true,2]},"s":"x"}', '{"b":1,"a":{"list":[1,2]},"s":"x"}', '{"b":1,"a":{"list":[1,2]},"s":"x"}', '{"b":2.5,"a":{"list":[1,2]},"s":"x"}', '{"s":"x"}', '{"b":1,"a":{"list":[1]},"s":"x"}',
    )
    bad = F.lit("{").cast("string")
    assert one(spark, J.json_edit(bad, "set", ("$.a", 1)), J.json_remove(F.lit(None).cast("string"), "$.a")) == (None, None)
    with pytest.raises(ValueError):
        J.path_steps("a.b")
    with pytest.raises(ValueError):
        J.path_steps("$.a[x]")


def test_json_concat_and_kinds(spark):
    null = F.lit(None).cast("string")
    got = one(spark, J.json_concat(F.lit("[null,true,0]"), 1.5, "x"), J.json_concat(null, None), J.json_concat(F.lit('{"a":1}'), 2), J.json_concat(F.lit("[1,"), 2), J.json_type(F.lit(" true ")), J.json_type(F.lit("null")), J.json_type(F.lit("1.5")), J.json_type(F.lit("x")))
    assert got == ("[null,true,0,1.5,\"x\"]", "[null]", '[{"a":1},2]', None, "true", "null", "real", None)


def test_json_tree_and_flatten(spark):
    deep = "[" * 30 + "1" + "]" * 30
    rows = spark.createDataFrame([(1, deep), (2, '{"a":{"b":[1,"x"]},"c d":false}'), (3, "{"), (4, None), (5, "")], "id long, j string")
    got = T.json_tree(rows.withColumnRenamed("id", "row"), "j").collect()
    assert sum(x.row == 1 for x in got) == 31 and {x.row for x in got} == {1, 2}
    assert [(x.id, x.parent, x.fullkey, x.type, x.atom) for x in got if x.row == 2] == [
        (0, None, "$", "object", None), (1, 0, "$.a", "object", None), (2, 1, "$.a.b", "array", None), (3, 2, "$.a.b[0]", "integer", "1"), (4, 2, "$.a.b[1]", "text", '"x"'), (5, 0, '$."c d"', "false", "false"),
    ]
    flat = {x.id: x.flat for x in T.flatten_json(rows, "j", "flat").collect()}
    assert flat == {1: None, 2: '{"a/b/0":1,"a/b/1":"x","c d":false}', 3: None, 4: None, 5: None}


def test_discovered_table(spark):
    example = 'login user=8 from 10.0.0.1 took 1.5 s as "root"'
    regex, columns = D.shape_of(example)
    assert columns == [("user", "bigint"), ("col_1", "string"), ("col_2", "double"), ("col_3", "string")]
    rows = spark.createDataFrame([(1, 'login user=9 from 10.0.0.2 took 2.5 s as "x y"'), (2, "logout user=9"), (3, None), (4, "")], "id long, log_body string")
    assert [tuple(x) for x in D.discovered_table(rows, example, ["id"]).collect()] == [(1, 9, "10.0.0.2", 2.5, "x y")]
    assert [x.id for x in D.breakpoints(rows, ["logout user=1"]).collect()] == [2]


def test_guessed_kinds():
    assert D.guess_kinds(r"(?<a>\d+) (?<b>\d+\.\d+) (?<c>\S+) (?<d>(?:x|y)+) (?<e>[-\d]+)") == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "bigint"}
    assert set(D.SEARCH_TABLES) >= {"sudo_log", "vpx_lro_begin", "procstate_procs"} and len(D.SEARCH_TABLES) == 12
    assert D.guess_kinds(D.SEARCH_TABLES["hdfs_finalized_blocks"].pattern)["blk_bytes"] == "bigint"


def test_built_in_search_tables(spark):
    slow = "# User@Host: u[u] @ h [1.1.1.1]  Id:    9\n# Query_time: 1.5  Lock_time: 0.1 Rows_sent: 3  Rows_examined: 4\nselect 1"
    procs = "root 12 1.5 0.2 100 200 ? Ss 10:00 0:01 /sbin/init splash"
    rows = spark.createDataFrame([(1, "f", "info", slow), (2, "f", "info", procs), (3, "/x/vpxd-profile.log", "info", "/SessionStats/SessionPool/Id='s'/Username='u'/total 7")], "id long, log_path string, log_level string, log_body string")
    assert D.built_in_search_table(rows, "mysql_slow_stats", ["id"]).select("user", "conn_id", "schema", "query_time", "rows_sent", "query").collect() == [("u[u]", 9, None, 1.5, 3, "select 1")]
    assert D.built_in_search_table(rows, "procstate_procs", ["id"]).select("pid", "cpu_pct", "cmd").collect() == [(12, 1.5, "/sbin/init splash")]
    assert D.built_in_search_table(rows, "vpxd_session_pool_stats", ["id"]).select("SessionId", "ProfileKey", "ProfileValue").collect() == [("s", "/total", "7")]


PRINTED = {
    "hdfs_finalized_blocks": ("src: /10.0.0.1:5, dest: /10.0.0.2:50010, bytes: 91178, op: HDFS_WRITE, cliID: DFSClient_1, offset: 0, srvID: a-b, blockid: BP-1:blk_2, duration(ns): 77", {"blk_src": "/10.0.0.1:5", "blk_bytes": 91178, "blk_id": "BP-1:blk_2", "blk_duration": 77}),
    "zk_established_session_id": ("Session establishment complete on server h/127.0.0.1:2181, sessionid = 0x15aB, negotiated timeout = 30000", {"session_id": "0x15aB"}),
    "zk_notifications": ("Notification: my state:LOOKING; n.sid:1, n.state:LOOKING", {"my_state": "LOOKING", "nvalues": "n.sid:1, n.state:LOOKING"}),
    "cloudvm_ram_sizes": ("vpxd 10 20 15 -1 2 3 4", {"ServiceName": "vpxd", "CurrRSS": -1, "MemoryLimit": 4}),
    "sudo_log": ("sudo:     bob : user NOT in sudoers ; TTY=pts/0 ; PWD=/home/bob x ; USER=root ; COMMAND=/bin/ls -l", {"login": "bob", "error_msg": "user NOT in sudoers", "tty": "pts/0", "pwd": "/home/bob x", "user": "root", "command": "/bin/ls -l"}),
    "vpx_lro_begin": ("[VpxLRO] -- BEGIN lro-1 --  -- vm.On -- 01234567-89ab-cdef-0123-456789abcdef(11234567-89ab-cdef-0123-456789abcdef)", {"lro_id": "lro-1", "entity": None, "operation": "vm.On", "SessionId": "01234567-89ab-cdef-0123-456789abcdef", "SessionSubId": "11234567-89ab-cdef-0123-456789abcdef"}),
    "vpxd_session_stats": ("/SessionStats/SessionPool/Session/Id='a'/Username='b'/ClientIP='c'/total 7 ms", {"SessionId": "a", "ClientIP": "c", "ProfileKey": "/total", "ProfileValue": "7 ms"}),
}


@pytest.mark.parametrize("name", PRINTED)
def test_search_tables_read_lines_as_printed(spark, name):
    line, want = PRINTED[name]
    rows = spark.createDataFrame([(1, "/x/vpxd-profile.log", "info", line), (2, "/x/vpxd-profile.log", "info", "nothing of this")], "id long, log_path string, log_level string, log_body string")
    got = D.built_in_search_table(rows, name, ["id"]).collect()
    assert [x.id for x in got] == [1] and {k: got[0][k] for k in want} == want


def test_layouts():
    import re

    from strandlog.sources.layouts import layout

    plain = layout("[[<a:int>: ]]<b>, x <c:word>").replace("(?<", "(?P<")
    assert re.fullmatch(plain, "7:  left, x  y").groupdict() == {"a": "7", "b": "left", "c": "y"}
    assert re.fullmatch(plain, "left over, x y").groupdict() == {"a": None, "b": "left over", "c": "y"}


def test_search_table_by_level_and_glob(spark):
    rows = spark.createDataFrame([(1, "a.log", "info", "n=1 n=2"), (2, "a.log", "error", "n=3"), (3, "b.txt", "error", "n=4")], "id long, log_path string, log_level string, log_body string")
    got = D.named_search_table(rows, r"n=(?<n>\d+)", ["id"], level="error", glob="*.log").collect()
    assert [tuple(x) for x in got] == [(2, 0, 3)]
    assert [tuple(x) for x in D.named_search_table(rows, r"n=(?<n>\d+)", ["id"]).where("id = 1").collect()] == [(1, 0, 1), (1, 1, 2)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, 'a"b,c' if i else None) for i in range(25)], "id long, t string").repartition(3)
    sinks.write_json(rows, f"{tmp_path}/lists", ["id"], rows=10)
    texts = [x.value for x in spark.read.text(f"{tmp_path}/lists").collect()]
    import json

    assert sorted(x["id"] for t in texts for x in json.loads(t)) == list(range(25)) and all(len(json.loads(t)) <= 10 for t in texts)
    sinks.write_json(rows, f"{tmp_path}/columns", ["id"], columns=True, rows=10)
    columns = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/columns").collect()]
    assert sorted(i for c in columns for i in c["id"]) == list(range(25)) and all(len(c["id"]) == len(c["t"]) for c in columns)
    sinks.write_csv(rows, f"{tmp_path}/csv")
    assert {tuple(x) for x in spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()} == {tuple(x) for x in rows.collect()}


def test_numbered(spark):
    rows = spark.createDataFrame([((i * 7919) % 1000, i) for i in range(1000)], "x long, i long").repartition(5)
    got = numbered(rows, ["x", "i"], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001)) and [(r.x, r.i) for r in got] == sorted((r.x, r.i) for r in got)


def test_blocks_see_the_same_neighbours(spark, monkeypatch):
    """Small blocks against windows over whole keys."""
    import functools

    from pyspark.sql import Window

    from strandlog.operators import carry

    rows = spark.createDataFrame([(i % 3 if i % 7 else 0, (i * 37) % 100, i, i if i % 4 == 0 else None) for i in range(200)], "k long, t long, i long, v long").repartition(3)
    w = Window.partitionBy("k").orderBy("t", "i")
    near = carry.near_rows(rows, ["k"], ["t", "i"], before=3, after=2, block=10)
    inner = Window.partitionBy("k", "_block").orderBy("_n").rowsBetween(-3, 2)
    got = {r.i: r.x for r in near.withColumn("x", F.collect_list("i").over(inner)).where("_own").collect()}
    assert got == {r.i: r.x for r in rows.withColumn("x", F.collect_list("i").over(w.rowsBetween(-3, 2))).collect()}
    monkeypatch.setattr(M, "carry", functools.partial(carry.carry, block=10))
    monkeypatch.setattr(M, "previous", functools.partial(carry.previous, block=10))
    got = {r.i: r.x for r in M.next_match(rows, ["k"], ["t", "i"], "x", F.col("v")).collect()}
    assert got == {r.i: r.x for r in rows.withColumn("x", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))).collect()}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        shared.folder(Far())


def test_lines_before_a_first_start(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "start"), ("a", 3, "z"), ("b", 0, "x"), ("b", 1, "x")], "log_path string, file_line long, value string")
    got = M.assemble(rows, F.col("value") == "start").orderBy("log_path", "file_line").collect()
    assert [(x.log_path, x.file_line, x.value, x.n_lines) for x in got] == [("a", 0, "x", 1), ("a", 1, "y", 1), ("a", 2, "start\nz", 2), ("b", 0, "x", 1), ("b", 1, "x", 1)]


def test_relative_times(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    at = lambda x: F.date_format(M.relative_time(x, now), "MM-dd HH:mm:ss")
    assert one(spark, *map(at, ("-15m", "1h30m ago", "+2d", "today", "yesterday", "now", "2024-01-02 03:04:05"))) == ("03-10 11:45:00", "03-10 10:30:00", "03-12 12:00:00", "03-10 00:00:00", "03-09 00:00:00", "03-10 12:00:00", "01-02 03:04:05")


def test_texts_and_dates(spark):
    t = F.lit("2024-03-10 12:34:56.789").cast("timestamp")
    got = one(spark, X.strftime(t, "%Y/%m/%d %T %%"), X.modified(t, "start of year", "-1 day").cast("string"), X.modified(t, "weekday 0").cast("string"), X.regexp_match(F.lit("a=1"), r"(\w)=(\d)"), X.regexp_match(F.lit("a"), r"=(\d)"), X.decode(X.encode(F.lit("é+ /"), "uri"), "uri"))
    assert got == ("2024/03/10 12:34:56 %", "2023-12-31 00:00:00", "2024-03-10 12:34:56.789", '{"col_0":"a","col_1":1}', None, "é+ /")
    names = ["f9", "f10", "f" + "1" * 120, "f" + "2" * 119, "f010", "g"]
    rows = spark.createDataFrame([(x,) for x in names], "x string").orderBy(X.natural_key("x"), "x").collect()
    assert [r.x for r in rows] == ["f9", "f010", "f10", "f" + "2" * 119, "f" + "1" * 120, "g"]
    assert one(spark, X.hash_key(F.lit("ab"), F.lit("c")) == X.hash_key(F.lit("a"), F.lit("bc")), X.hash_key(F.lit(None).cast("string")).isNotNull()) == (False, True)


def test_registered_functions(spark):
    registered.register_all(spark)
    registered.register_all(spark)
    got = spark.sql("SELECT padc('ab', 5), strfilter('abcabd', 'ab'), difference('Robert', 'Rupert'), square(3), humanize_file_size(1234567), timediff('2024-01-02', '2024-01-01'), timediff('x', '2024-01-01'), charindex('b', 'abc')").first()
    assert tuple(got) == (" ab  ", "abab", 4, 9.0, "1.2MB", 86400.0, None, 2)


def test_fuzzy_search_takes_the_best_places(spark):
    rows = spark.createDataFrame([(1, "sxx gz s gz"), (2, "no"), (3, None), (4, ""), (5, "sgz")], "id long, t string")
    got = [(x.id, x.score) for x in T.fuzzy_search(rows, "t", "sgz", 5).collect()]
    assert got == [(5, 3 + 3 + 4 + 4), (1, 3 + 3 + 3 + 4)]


def test_timeline_kinds_and_levels(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, "info", "f", ["a", "b"]), (t + dt.timedelta(1), "error", "f", []), (t, "warning", None, None)], "log_time timestamp, log_level string, file string, tags array<string>")
    got = {(x.kind, x.name): (x.total, x.errors, x.warnings) for x in A.timeline(rows, {"file": "file", "tag": "tags"}).collect()}
    assert got == {("file", "f"): (2, 1, 0), ("tag", "a"): (1, 0, 0), ("tag", "b"): (1, 0, 0)}
    assert A.timeline(rows, {"file": "file", "tag": "tags"}, least="error").count() == 1
    assert A.timeline(rows, {"file": "file", "tag": "tags"}, wanted="^b").count() == 1


def test_attached_database(spark, tmp_path):
    """A database of another kind, by the driver that comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string").write.format("jdbc").options(url=url, dbtable="things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:  # Spark without the driver
        pytest.skip(str(e)[:80])
    structured.attach(spark, "far", {"things": "things"}, source="jdbc", url=url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert spark.sql("SELECT count(*) AS n FROM far_things").first().n == 2


def test_time_layouts(spark):
    stamps = {
        "2024-01-02T03:04:05.123456Z": 123456, "2024-01-02T03:04:05.123Z": 123000, "2024-01-02T03:04:05Z": 0, "2024-01-02T05:04:05.123456+02:00": 123456, "2024-01-02T05:04:05+02:00": 0, "2024-01-02T05:04:05+0200": 0, "2024-01-02T03:04:05.123": 123000,
        "2024-01-02 03:04:05.123456 +0000": 123456, "2024-01-02 03:04:05,123": 123000, "2024-01-02 03:04:05": 0, "2024/01/02 03:04:05.123456": 123456, "02/Jan/2024:03:04:05 +0000": 0, "01/02/2024 03:04:05": 0, "02.01.2024 03:04:05": 0, "Tue, 2 Jan 2024 03:04:05 +0000": 0,
        "2 Jan 2024 03:04:05.123": 123000, "Tue Jan 02 03:04:05.123456 2024": 123456, "Tue Jan  2 03:04:05 2024": 0, "Jan  2 03:04:05": 0, "Jan 2 03:04:05.123": 123000, "01-02 03:04:05.123": 123000, "0102 03:04:05.123456": 123456, "20240102T030405Z": 0, "20240102 030405": 0,
        "03:04:05.123": 123000, "03:04:05": 0, "@4000000065937d2f075bca00": 123456, "1704164645123456789": 123456, "1704164645123456": 123456, "1704164645123": 123000, "1704164645.123": 123000, "1704164645": 0,
    }
    rows = spark.createDataFrame([(f"f{i}", n, s if n else "no time") for i, s in enumerate(stamps) for n in range(3)], "log_path string, file_line long, stamp string")
    got = times.read_times(rows, "stamp", year=2024, day="2024-01-02").collect()
    for i, (s, micros) in enumerate(stamps.items()):
        own = sorted((x.file_line, x.log_time) for x in got if x.log_path == f"f{i}")
        assert [t for _, t in own] == [None, *[dt.datetime(2024, 1, 2, 3, 4, 5, micros)] * 2], s
    none = times.read_times(spark.createDataFrame([("f", 0, None), ("f", 1, "")], rows.schema), "stamp").collect()
    assert [(x.layout, x.log_time) for x in none] == [(None, None)] * 2


def test_statuses(spark):
    assert dict(map(tuple, T.http_status_codes(spark).collect()))[404] == "Not Found"


def test_statistics_of_parts(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", None), ("c", "y", 5.0)], "k string, p string, v double")
    got = {x.k: (x.n, x.mean, x.stdev) for x in A.merge_statistics(A.partial_statistics(rows, ["k", "p"], "v"), ["k"]).collect()}
    assert got["a"][:2] == (2, 2.0) and abs(got["a"][2] - 2**0.5) < 1e-9 and got["b"][0] == 0 and got["c"] == (1, 5.0, 0.0)


@pytest.mark.parametrize("name", [f.name for f in printed_formats.PRINTED])
def test_printed_formats_read_their_samples(spark, name):
    fmt = formats.catalogue()[name]
    row = formats.parse(spark.createDataFrame([("f", 0, fmt.sample)], "log_path string, file_line long, value string"), fmt, year=2024).first()
    assert str(row.log_time)[:19] == "2024-01-01 00:00:07" and row.log_body.strip().removesuffix(")").endswith("value 6.55") and row.log_opid is not None or not fmt.opid
    assert row.log_level == ("info" if name in ("fsck_hfs_log", "procstate_log", "cloudvm_ram_log", "mysql_gen_log", "mysql_slow_log", "xmlrpc_log") else "error")


def test_printed_formats_further_lines(spark):
    of = lambda name, line: formats.parse(spark.createDataFrame([("f", 0, line)], "log_path string, file_line long, value string"), formats.catalogue()[name], year=2024).first()
    alb = of("alb_log", formats.catalogue()["alb_log"].sample)
    assert (alb.client_ip, alb.client_port, alb.response_processing_time, alb.elb_status_code, alb.cs_uri_stem, alb.cs_uri_query) == ("10.0.0.8", 80, -1.0, 404, "http://shop.example:80/view", "k=1")
    vmw = of("vmw_log", "[2011-04-01 15:14:34.203 F5A5AB90 info 'vm:/vmfs/a.vmx' opID=F6FC-d] Prepare")
    assert (vmw.tid, vmw.comp, vmw.opid, vmw.log_level, vmw.log_body) == ("F5A5AB90", "vm:/vmfs/a.vmx", "F6FC-d", "info", "Prepare")
    vdsm = of("vdsm_log", "2017-03-06 14:49:05,167 INFO  (vm/9e5d) [virt.vm] (vmId='9') started (vm:2104)")
    assert (vdsm.thread, vdsm.logger, vdsm.src_line, vdsm.log_body) == ("vm/9e5d", "virt.vm", 2104, "(vmId='9') started")
    assert str(of("mysql_slow_log", "# Time: 170213 16:00:33").log_time) == "2017-02-13 16:00:33"
    assert of("sssd_log", "(Tue Mar 31 05:58:38 2015) [sssd] [start] (0x0100): Queueing").service == "sssd"


def test_raise_error_raises(spark):
    from strandlog.functions import registered

    registered.register_all(spark)
    rows = spark.createDataFrame([(1,), (-1,)], "v int")
    checked = F.when(F.col("v") < 0, F.raise_error(F.lit("a negative value"))).otherwise(F.col("v"))
    assert rows.where("v > 0").select(checked).first()[0] == 1
    with pytest.raises(Exception, match="a negative value"):
        rows.select(checked).collect()


@pytest.mark.parametrize("name", json_formats.JSON_FORMATS)
def test_json_formats_read_their_samples(spark, name):
    fmt = json_formats.JSON_FORMATS[name]
    row = json_formats.parse_json_format(spark.createDataFrame([(fmt.sample,)], "value string"), fmt).first()
    assert str(row.log_time)[:19] == "2024-01-01 00:00:07" and row.log_level == "error" and row.log_body and row.log_opid


def test_json_times_with_a_zone_of_four_digits(spark):
    fmt = json_formats.JSON_FORMATS["macosuni_log"]
    row = json_formats.parse_json_format(spark.createDataFrame([(fmt.sample.replace("575+00:00", "575+0130"),)], "value string"), fmt).first()
    assert str(row.log_time) == "2023-12-31 22:30:07.179575"
