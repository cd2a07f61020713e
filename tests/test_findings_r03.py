"""Queries on the inputs that round 3's findings name, each held against its SQL or what it stands for."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

EVENTS = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i + INTERVAL 1 MICROSECOND * (i * 179) AS ts, {user} AS user_id, (['view', 'error', 'signup'])[1 + i % 3] AS event_type, i / 100.0::DOUBLE AS value, '{{\"k\": ' || i || '}}' AS props FROM range({n}) t(i)"


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over events of these user ids gives what its SQL gives."""

    def run(name: str, user: str, n: int = 300) -> bool:
        db = duckdb.connect()
        db.execute(f"COPY ({EVENTS.format(user=user, n=n)}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
        want = db.execute(entry.oracle_sql()[name])
        names = [x[0] for x in want.description]
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(names).collect()]
        return sorted(got, key=repr) == sorted(want.fetchall(), key=repr)

    return run


def test_spans_of_durations_over_a_second(same):
    assert same("i18_durations_and_spans", "(i * 37 + 1000)")


def test_addresses_of_users_over_255(same):
    assert same("s_address_numbers", "(i * 997)")


def test_xpath_values_of_several_paths(spark, same):
    from strandlog.operators import tables as T

    texts = ["<a i='1'><b>x</b><b>y</b></a>", "<a i='2'>é<b>z</b></a>", "<p:a xmlns:p='u' i='3'/>", "<p:a i='4'/>", "<a i='5'/><a/>", "<a i='6'>", "<a i=7/>", "<a i='8'/> tail", "\n", None, "<!DOCTYPE a><a i='9'/>", "<a>&amp;</a>", "<a i='1' i='2'/>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    paths = {"i": "//@i", "b": "//b/text()", "all": "count(//*)"}
    got = sorted(tuple(r) for r in T.xpath_values_of(rows, "x", paths).select("asked", "n", "match_index", "value").collect())
    one = sorted((k, r.n, r.match_index, r.value) for k, p in paths.items() for r in T.xpath_values(rows, "x", p).collect())
    assert got == one == [("all", 0, 0, "3"), ("all", 1, 0, "2"), ("all", 2, 0, "1"), ("all", 3, 0, "1"), ("all", 11, 0, "1"), ("b", 0, 0, "x"), ("b", 0, 1, "y"), ("b", 1, 0, "z"), ("i", 0, 0, "1"), ("i", 1, 0, "2"), ("i", 2, 0, "3"), ("i", 3, 0, "4")]
    assert same("d8_xpath_values", "(i * 7)")


def test_costly_steps_are_dealt_evenly(spark, tmp_path):
    """A file of one row group in many parts: its rows used to stay in the one part that holds the group."""
    from strandlog.operators.shared import spread

    spark.range(40_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        sizes = [x["count"] for x in spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes) >= 4 and max(sizes) < 15_000


@pytest.mark.parametrize("name", ("xpath_nodes", "json_tree", "regexp_capture"))
def test_lists_are_worked_out_once(spark, name):
    """The optimizer used to put a filter on the list's size before it, for which Python worked it out a second time."""
    from strandlog.operators import tables as T

    rows = spark.createDataFrame([(1, '{"a":[1]}'), (2, "<a><b/></a>"), (3, None)], "n int, x string")
    out = getattr(T, name)(rows, "x", *{"xpath_nodes": ["./b"], "json_tree": [], "regexp_capture": ["a"]}[name])
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert sorted(r.n for r in out.collect()) == {"xpath_nodes": [2], "json_tree": [1, 1, 1], "regexp_capture": [1, 2, 2]}[name]


def test_anonymized_texts_are_given_whole(spark, tmp_path):
    """only a hash of the texts' form was given, which unchanged texts have as well."""
    texts = ["mail a.b@c.example from 10.0.0.1, é10.0.0.2 and 1.2.3.4.5", None, "", "id 123e4567-e89b-12d3-a456-426614174000 at https://bob:pw@c.example/a%20b?k='v'", "fe80::1 f2:09:1a:a2:e3:e2 /home/u/f.txt ü/a/b/ +49 (30) 1234567 0xBEEF", "éabcdef0123456789abcdef 6011-1111-1111-1117\x0bx\x00y😀a.b@c.example\n", "plain words", "a://b\x0bc \\d $1 \\0"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["d10_anonymize"])
    names = [x[0] for x in want.description]
    got = sorted(tuple(r) for r in entry.queries()["d10_anonymize"](spark, str(tmp_path)).select(names).collect())
    assert names == ["doc_id", "text", "form"] and got == sorted(want.fetchall())
    changed = [r[1] != t for r, t in zip(got, texts)]
    assert changed == [True, False, False, True, True, True, False, True] and "a.b@c.example" not in got[0][1] + got[5][1]


@pytest.mark.parametrize("kind,hold", (("repaired", None), ("repaired", "1 hour"), ("assembled", None)))
def test_a_file_of_a_stream_is_not_one_task(spark, tmp_path, kind, hold):
    """F8, F10, F14: joins with what is known of a file brought all of its lines into one task."""
    import re

    from strandlog.streaming import ordered

    schema = "log_path string, file_line long, value string, log_time timestamp"
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/none*")
    base = f"file://{tmp_path}/out"
    batches = ordered.repaired(stream, base, hold) if kind == "repaired" else ordered.assembled(stream, base, F.col("value").startswith("start"))
    rows = spark.range(100).select(F.lit("f").alias("log_path"), F.col("id").alias("file_line"), F.lit("x").alias("value"), F.current_timestamp().alias("log_time"))
    given, _ = batches.step(rows, batches._before(0), False)
    plan = given._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"SortMergeJoin \[log_path#\d+\]", plan)


def test_a_piece_of_a_file_is_read_alone():
    """each piece of 2,000 bytes read and split 8 MB of its file."""
    import io

    from strandlog.sources import growing

    data = b"".join(b"%d\n" % i for i in range(100_000)) + b"x" * 50_000 + b"\nlast"
    f, sizes, got = io.BytesIO(data), [], []
    for begin in range(0, len(data), 2000):
        f.seek(max(0, begin - 1))
        before = f.tell()
        got += [v for b in growing._lines("p", f.read, before, min(len(data), begin + 2000), begin > 0) for v in b.column("value").to_pylist()]
        sizes.append(f.tell() - before)
    assert got == data.decode().split("\n") and sorted(sizes)[len(sizes) // 2] < 10_000 and max(sizes) < 300_000


def test_json_lines_and_their_keys_are_worked_out_once(spark):
    """a filter worked out the line and its keys anew for each member that tells the format, and lines of one row group were one task."""
    from strandlog.plans import wide_queries
    from strandlog.sources import json_formats

    fmt = json_formats.JSON_FORMATS["bunyan_log"]
    line = F.to_json(F.struct(F.col("id").alias("pid"), *(F.lit("x").alias(n) for n in fmt.needs if n != "pid")))
    rows = json_formats.parse_json_format(spark.range(10).select("id", line.alias("value")), fmt).select("id", "pid", "log_time", "log_level", "log_body")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jsonObjectKeys") == 1 and plan.count("StructsToJsonEvaluator") == 1
    assert [r.pid for r in rows.orderBy("id").collect()] == list(range(10))
    plan = wide_queries.i6_json_formats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == plan.count("Relation [") == 8


def test_json_lines_are_told_by_their_members_alone(spark):
    """as before, members may be null, doubled or in any order; no other line is one of the format's."""
    from strandlog.sources import json_formats

    fmt = json_formats.JSON_FORMATS["rust_tracing_log"]
    good = ['{"timestamp":null,"level":null,"fields":null,"target":null}', '{"target":"a","level":"ERROR","fields":{"message":"m"},"timestamp":"2024-01-01T00:00:07Z","level":"WARN"} rest']
    bad = [None, "", "[]", "1", "null", '{"level":1,"fields":{},"target":2}', '{"timestamp":1,"level":1,"fields":{},"target":2', '{"a":{"timestamp":1,"level":1,"fields":{},"target":2}}']
    rows = spark.createDataFrame([(x,) for x in good + bad], "value string")
    assert sorted(r.value for r in json_formats.parse_json_format(rows, fmt).collect()) == sorted(good)
    assert rows.where(json_formats.matches(F.col("value"), fmt)).count() == 2
    assert rows.where(~json_formats.matches(F.col("value"), fmt)).count() == len(bad)


def test_a_json_format_without_needs_takes_every_object(spark):
    """as before."""
    from strandlog.sources import json_formats

    fmt = json_formats.JsonFormat("own_log", (), (), ("t", 0), "l", (), "m")
    rows = spark.createDataFrame([("{}",), ('{"m":"x"}',), ("[]",), (None,)], "value string")
    assert sorted(r.value for r in json_formats.parse_json_format(rows, fmt).collect()) == ['{"m":"x"}', "{}"]
