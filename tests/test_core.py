"""Operators on lines written by hand, and the registered queries' basic promises."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from strandlog.functions import text as X
from strandlog.operators import analytics as A
from strandlog.operators import messages as M
from strandlog.operators.carry import carry, previous
from strandlog.sources import growing, formats, structured


def lines(spark, *values, path="f"):
    return spark.createDataFrame([(path, i, v) for i, v in enumerate(values)], "log_path string, file_line long, value string")


def test_every_format_parses_its_sample(spark):
    for f in formats.FORMATS.values():
        row = formats.parse(lines(spark, f.sample), f, year=2024).collect()
        assert len(row) == 1 and row[0].log_time is not None and row[0].log_level != "unknown", f.name
        assert str(row[0].log_time).startswith("2024-01-01 00:00:07"), f.name


def test_detection_prefers_the_specific_format(spark):
    all_lines = lines(spark, *[formats.FORMATS["java_log"].sample] * 3, "\tat x.Y(Z)").unionByName(lines(spark, "nothing", path="g"))
    got = {x.log_path: x.log_format for x in formats.detect(all_lines).collect()}
    assert got == {"f": "java_log", "g": None}


def test_assembly_across_blocks(spark):
    df = lines(spark, "  tail", "start a", " b", " c", "start d", "start e", " f")
    for block in (1, 2, 100):
        rows = carry(df.withColumn("s", F.col("value").startswith("start")), ["log_path"], "file_line", block, n=("sum", F.col("s").cast("int")))
        assert [x.n for x in rows.orderBy("file_line").collect()] == [0, 1, 1, 1, 2, 3, 3]
    got = [(x.file_line, x.value, x.n_lines) for x in M.assemble(df, F.col("value").startswith("start")).orderBy("file_line").collect()]
    assert got == [(0, "  tail", 1), (1, "start a\n b\n c", 3), (4, "start d", 1), (5, "start e\n f", 2)]


@pytest.mark.parametrize("block", [1, 3, 50])
def test_carry_and_previous(spark, block):
    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate([3, None, 5, 1, None, 7])], "k string, i long, v long")
    got = carry(df, ["k"], "i", block, top=("max", F.col("v")), fill=("last", F.col("v"))).orderBy("k", "i").collect()
    assert [x.top for x in got] == [3, 3, 5, 5, 5, 7] * 2 and [x.fill for x in got] == [3, 3, 5, 1, 1, 7] * 2
    assert [x.p for x in previous(df, ["k"], "i", "v", "p", block).orderBy("k", "i").collect()] == [None, 3, None, 5, 1, None] * 2


def test_logfmt_zeek_w3c(spark):
    row = structured.parse_logfmt(lines(spark, 'level=WARN msg="a \\"b\\" c" n=1 n=2 time=2024-01-01T00:00:00Z')).collect()[0]
    assert (row.log_level, row.log_body, row.fields["n"]) == ("warn", 'a "b" c', "2")
    zeek = structured.parse_zeek(lines(spark, "#separator \\x09", "#fields\tts\tid.orig_h", "1\t10.0.0.1", "2\t-", "#fields\tx", "9")).orderBy("file_line").collect()
    assert [dict(x.fields) for x in zeek] == [{"bro_ts": "1", "bro_id_orig_h": "10.0.0.1"}, {"bro_ts": "2", "bro_id_orig_h": None}, {"bro_x": "9"}]
    w3c = structured.parse_w3c(lines(spark, "#Date: 2024-01-01 00:00:00", "#Fields: time c-ip", "00:00:01 1.1.1.1", "#Fields: date time", "2024-02-02 00:00:02")).orderBy("file_line").collect()
    assert [str(x.log_time) for x in w3c] == ["2024-01-01 00:00:01", "2024-02-02 00:00:02"]


def test_read_lines_keeps_file_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i}\n" for i in range(500)))
    want = [f"{n}{i}" for n in "ab" for i in range(500)]
    for split in (7, 100, 1 << 20):  # the same numbers however the files are cut
        lines = growing.read_lines(spark, str(tmp_path), split_bytes=split)
        got = lines.orderBy("log_path", "file_line").collect()
        assert [x.value for x in got] == want and [x.file_line for x in got[:12]] == [*range(0, 30, 3), 30, 34]
    assert "Join" not in lines._jdf.queryExecution().toString()
    assert [x.file_line for x in structured.numbered_lines(lines).orderBy("log_path", "file_line").collect()] == [*range(500)] * 2


def test_read_lines_of_odd_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\n\nx\r\n" + b"y" * 50 + b"\n\xff\xfe\nend")
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(b"packed\nlines\n"))
    want = [("", 0), ("", 1), ("x", 2), ("y" * 50, 5), ("\ufffd\ufffd", 56), ("end", 59), ("packed", 0), ("lines", 7)]
    for split in (1, 3, 10, 1000):
        got = growing.read_lines(spark, f"file://{tmp_path}", split_bytes=split).orderBy("log_path", "file_line").collect()
        assert [(x.value, x.file_line) for x in got] == want
    assert growing.read_lines(spark, f"{tmp_path}/none*").collect() == []


def test_sort_keys(spark):
    df = spark.createDataFrame([("file10", "1KB", "10.0.0.2"), ("file2", "1KiB", "10.0.0.10"), ("File1", "900B", "host")], "n string, m string, a string")
    assert [x.n for x in df.orderBy(X.natural_key("n", True)).collect()] == ["File1", "file2", "file10"]
    assert [x.m for x in df.orderBy(X.measure("m")).collect()] == ["900B", "1KB", "1KiB"]
    assert [x.a for x in df.orderBy(X.ip_key("a")).collect()] == ["host", "10.0.0.2", "10.0.0.10"]
    levels = spark.createDataFrame([("E",), ("warn",), ("fatal",), ("",)], "l string").select(X.level_ordinal("l")).collect()
    assert [x[0] for x in levels] == [11, 10, 13, None]


def test_scalar_helpers(spark):
    one = spark.range(1)
    pick = lambda *cs: list(one.select(*cs).first())
    s = F.lit
    assert pick(X.base_name(s("/a/b/")), X.dir_name(s("/a/b/")), X.dir_name(s("a")), X.join_path(s("a"), s("b"), s("/c"))) == ["b", "/a", ".", "/c"]
    assert pick(X.humanize_size(s(999)), X.humanize_size(s(1500)), X.humanize_duration(s(93784.0)), X.humanize_duration(s(4.5))) == ["999B", "1.5KB", "1d02h03m", "4s500"]
    assert pick(X.greatest_or_null(s(1), s(3)), X.greatest_or_null(s(1), s(None).cast("int")), X.pad_left(s("abcdef"), 4), X.pad_centre(s("ab"), 6)) == [3, None, "abcdef", "  ab  "]
    assert pick(X.json_contains(s('["a","b"]'), "b"), X.json_contains(s('{"a":"b"}'), "b"), X.json_pointer(s('{"a":[1,{"b":2}]}'), "/a/1/b")) == [True, False, "2"]
    assert pick(X.captures_json(s("a=1 b=x"), r"(\w)=(\w)", ["k", "v"])) == [['{"k":"a","v":1}', '{"k":"b","v":"x"}']]
    assert pick(X.spark_bar(s(100)), X.spark_bar(s(0)), X.soundex_difference(s("Robert"), s("Rupert"))) == ["█", " ", 4]


def test_aggregates_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 2.0), ("d", None)], "k string, v double")
    got = {x.k: x for x in df.groupBy("k").agg(A.stdev("v").alias("s"), A.total("v").alias("t")).collect()}
    assert (got["a"].s, got["d"].s, got["d"].t) == (0.0, 0.0, 0.0)
    assert {x.k: x.mode for x in A.mode_of(df, ["k"], "v").collect()} == {"a": 1.0, "b": 1.0, "c": None}
    nums = spark.createDataFrame([(float(i),) for i in range(1, 9)], "v double")
    q = A.quantiles_of(nums, [], "v", low=(1, 4), med=(1, 2), high=(3, 4)).first()
    assert (q.low, q.med, q.high) == (2.5, 4.5, 6.5)


def test_skew_filters_and_metadata(spark):
    df = spark.createDataFrame([("f", 0, "2024-01-01 00:00:05"), ("f", 1, "2024-01-01 00:00:01"), ("f", 2, "2024-01-01 00:00:09")], "log_path string, file_line long, t string").withColumn("log_time", F.to_timestamp("t"))
    got = M.repair_skew(df).orderBy("file_line").collect()
    assert [x.time_skewed for x in got] == [False, True, False] and got[1].log_time == got[0].log_time and str(got[1].log_actual_time).endswith("01")
    body = df.withColumn("log_body", F.concat(F.lit("m"), F.col("file_line").cast("string")))
    assert [x.file_line for x in M.filter_rows(body, []).collect()] == [0, 1, 2]
    assert [x.file_line for x in M.filter_rows(body, [(1, "out", "1")]).collect()] == [0, 2]
    changes = spark.createDataFrame([("f", 1, True, 1), ("f", 1, False, 2)], "log_path string, file_line long, log_mark boolean, v int")
    assert [x.log_mark for x in M.write_back(body, changes, ["log_path", "file_line"], ["log_mark"], "v").orderBy("file_line").collect()] == [None, False, None]


def test_templates_and_pseudonyms(spark):
    df = spark.createDataFrame([("user 12 from 10.0.0.1 took 5.5% of /var/log/a.txt",), ("user 7 from 10.0.0.2 took 1% of /tmp/b",)], "b string")
    assert {x[0] for x in df.select(A.template("b")).collect()} == {"user # from # took # of #"}


def test_entry_and_oracles(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 70
