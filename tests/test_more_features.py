"""Time slices, SQLite files, ranges of sub-operations, merged quantiles, captures with an order."""

from __future__ import annotations

import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from strandlog.functions import time_slices
from strandlog.operators import analytics as A
from strandlog.operators import discovery as D
from strandlog.operators import tables as T
from strandlog.sources import sqlite

WEDNESDAY = "2017-01-04"


@pytest.mark.parametrize(
    "text,time,start",
    (
        ("10m", "05:05:00", "05:00:00"), ("every 90 minutes", "02:00:00", "01:30:00"), ("1h30m", "02:00:00", "01:30:00"), ("1 h", "23:59:59.999999", "23:00:00"), ("100 ms", "00:00:00.250000", "00:00:00.200000"),
        ("8 am", "08:59:59", "08:00:00"), ("8am", "09:00:00", None), ("8:30 pm", "20:30:59", "20:30:00"), ("20:30", "20:31:00", None), ("noon", "12:10:00", "12:00:00"), ("12 am", "00:10:00", "00:00:00"), ("midnight", "00:59:00", "00:00:00"), ("12pm", "12:00:00", "12:00:00"),
        ("before 4:30am", "04:29:59", "00:00:00"), ("before 4:30am", "04:30:00", None), ("after 4pm", "16:00:00", "16:00:00"), ("after 4pm", "15:59:59", None), ("9am to 5pm", "16:59:00", "09:00:00"), ("from 09:00 to 17:00", "17:00:00", None),
        ("after 9am before 10am", "09:30:00", "09:00:00"), ("after 9am before 10am", "10:30:00", None),
        ("wed", "13:00:00", "00:00:00"), ("wednesdays", "13:00:00", "00:00:00"), ("thu", "13:00:00", None), ("mon, wed and fri", "13:00:00", "00:00:00"), ("weekday", "13:00:00", "00:00:00"), ("weekend", "13:00:00", None),
        ("wed before 12pm", "11:00:00", "00:00:00"), ("tue before 12pm", "11:00:00", None), ("jan", "13:00:00", "2017-01-01 00:00:00"), ("feb", "13:00:00", None), ("jan wed 1 pm", "13:05:00", "13:00:00"), ("every 2 hours after 9am", "12:30:00", "11:00:00"),
        ("10pm to 4am", "23:00:00", "22:00:00"), ("10pm to 4am", "03:00:00", "2017-01-03 22:00:00"), ("10pm to 4am", "04:00:00", None), ("tue 10pm to 4am", "03:00:00", "2017-01-03 22:00:00"), ("wed 10pm to 4am", "03:00:00", None),
        ("today", "03:00:00", None), ("yesterday", "03:00:00", "00:00:00"),
    ),
)
def test_time_slices(spark, text, time, start):
    t = F.lit(f"{WEDNESDAY} {time}").cast("timestamp")
    got = spark.range(1).select(time_slices.time_slice(t, text, F.lit("2017-01-05 12:00:00").cast("timestamp")).alias("x")).first().x
    want = start and dt.datetime.fromisoformat(start if "-" in start else f"{WEDNESDAY} {start}")
    assert got == want


@pytest.mark.parametrize("text", ("", "blah", "8 parsecs", "before", "25:00", "13 pm", "before mon", "10m !"))
def test_time_slices_that_are_none(text):
    with pytest.raises(ValueError):
        time_slices.parse(text)


@pytest.fixture
def shop(tmp_path):
    path = tmp_path / "shop.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE items (id INTEGER PRIMARY KEY, "a name" TEXT, price REAL, raw BLOB, n INT)')
        db.executemany("INSERT INTO items VALUES (?, ?, ?, ?, ?)", [(i * 3, f"n{i}", i / 2, bytes([i % 256]), i if i % 5 else None) for i in range(1, 1001)])
        db.execute("INSERT INTO items VALUES (9999, 7, 'odd', 'text', 'x')")
        db.execute("CREATE TABLE pairs (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        db.executemany("INSERT INTO pairs VALUES (?, ?)", [("a", 1), ("b", None)])
        db.execute("CREATE TABLE none (x INT)")
        db.execute("CREATE VIEW dear AS SELECT * FROM items WHERE price > 400")
    return str(path)


def test_sqlite_tables(spark, shop):
    items = sqlite.read_table(spark, shop, "items", partitions=7)
    assert items.dtypes == [("id", "bigint"), ("a name", "string"), ("price", "double"), ("raw", "binary"), ("n", "bigint")]
    assert items.rdd.getNumPartitions() == 7 and items.count() == 1001 and items.select("id").distinct().count() == 1001
    assert items.where("id = 30").select("a name", "price", "raw", "n").collect() == [("n10", 5.0, bytearray(b"\n"), None)]
    assert items.where("id = 9999").select("a name", "price", "raw", "n").collect() == [("7", None, None, None)], "values of another kind"
    assert items.where("n IS NULL").count() == 201 and items.where("n > 995 AND `a name` <> 'n999'").count() == 3
    assert items.where(F.col("id").isin(3, 6, 7)).count() == 2
    assert sqlite.tables(shop) == ["dear", "items", "none", "pairs"]
    assert sqlite.attach(spark, "shop", shop) == ["shop_dear", "shop_items", "shop_none", "shop_pairs"]
    assert spark.sql("SELECT count(*) FROM shop_dear JOIN shop_items USING (id)").first()[0] == 201  # the odd price is a text, and texts are greater than numbers
    assert sorted(map(tuple, spark.table("shop_pairs").collect())) == [("a", 1), ("b", None)] and spark.table("shop_none").count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.read_table(spark, shop, "gone").collect()


def test_sqlite_filters_reach_the_database(shop):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    source = sqlite.Sqlite({"path": shop, "table": "items"})
    reader = source.reader(source.schema())
    left = list(reader.pushFilters([EqualTo(("id",), 30), In(("n",), (1, 2)), IsNotNull(("a name",)), EqualTo(("price",), 1.0)]))
    assert reader.where == ['"id" = ?', '"n" IN (?, ?)', '"a name" IS NOT NULL'] and reader.given == [30, 1, 2] and len(left) == 4


def test_sqlite_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.5, None), (2, None, None, b"x")], "i int, s string, d double, b binary")
    for _ in range(2):
        sqlite.write_table(rows, f"{tmp_path}/out.db", "t")
    assert sorted(map(tuple, sqlite.read_table(spark, f"{tmp_path}/out.db", "t").collect())) == [(1, "a", 2.5, None), (2, None, None, bytearray(b"x"))]


def test_sub_operation_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["p", "q", None]), r.choice(["x", "y", None]), r.choice(["open", "close", "", "", None])) for i in range(400)]
    state, want = {}, {}
    for i, op, sub, kind in rows:
        if op is None or sub is None:
            continue
        n, closed = state.get((op, sub), (0, True))
        n += closed or kind == "open"
        want.setdefault((op, sub, n), []).append((i, kind == "close"))
        state[op, sub] = n, kind == "close"
    table = spark.createDataFrame(rows, "i long, op string, sub string, kind string").withColumn("log_time", F.timestamp_micros("i")).repartition(3)
    got = T.sub_operation_ranges(table, "op", "sub", F.col("kind") == "open", F.col("kind") == "close", ["i"])
    at = lambda t: t.microsecond
    assert {(x.op, x.sub, x.range): (at(x.start), at(x.stop), x.total, x.closed) for x in got.collect()} == {k: (v[0][0], v[-1][0], len(v), any(c for _, c in v)) for k, v in want.items()}


def test_merged_quantiles(spark):
    rows = spark.range(40_000).select((F.col("id") % 8).alias("file"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), F.pow(F.rand(1), 3).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(1, "none", None)], "file long, k string, v double"))
    parts = A.partial_quantiles(rows, ["file", "k"], "v").cache()
    got = {x.k: x for x in A.merge_quantiles(parts, ["k"], low=0.1, mid=0.5, high=0.99).collect()}
    assert got["none"].mid is None
    for k in "ab":
        values = sorted(x.v for x in rows.where(F.col("k") == k).collect())
        for name, rank in (("low", 0.1), ("mid", 0.5), ("high", 0.99)):
            at = sum(v <= got[k][name] for v in values) / len(values)
            assert abs(at - rank) < 0.02
    assert parts.select(F.max(F.length("quantiles"))).first()[0] < 20_000


def test_captures_sort_in_their_own_order(spark):
    rows = spark.createDataFrame([(i, f"from {ip} got {size}") for i, (ip, size) in enumerate([("10.0.0.10", "10KB"), ("10.0.0.9", "9KB"), ("9.9.9.9", "1.5MB"), ("10.0.0.1", "900B")])], "id long, log_body string")
    found = D.named_search_table(rows, r"from (?<ip>\d+(?:\.\d+){3}) got (?<size>[\d.]+[KM]?B)", ["id"])
    assert D.guess_orders(r"(?<a>\S+) (?<b>\d+) (?<c>\d+(?:\.\d+){3}) (?<d>\d+ms|\d+s)") == {"c": "address", "d": "measure"}
    assert [x.size for x in D.in_order(found, "size").collect()] == ["900B", "9KB", "10KB", "1.5MB"]
    assert [x.ip for x in D.in_order(found.where("id >= 0").select("ip"), "ip").collect()] == ["9.9.9.9", "10.0.0.1", "10.0.0.9", "10.0.0.10"]


def test_leases(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.randint(0, 50)) for i in range(300)]
    got = A.leases(spark.createDataFrame(rows, "i long, k string, t long").withColumn("log_time", F.timestamp_seconds("t")).repartition(3), ["k"], ["t", "i"])
    want = {}
    for key in ("a", "b", None):
        own = sorted((t, i) for i, k, t in rows if k == key)
        want |= {i: (following[0] - t) * 1_000_000 for (t, i), following in zip(own, own[1:])} | {own[-1][1]: None}
    assert {x.i: x.lease for x in got.collect()} == want


def test_report_document(spark):
    table = spark.createDataFrame([("b", 1, 12.34), ("a", 3, 50.0), (None, 3, 37.66)], "name string, hits long, percent double")
    got = A.report_document({"Names": table, "Empty": table.limit(0)}, "All").first().document
    head = "| name | hits | percent |\n|---|---|---|"
    assert got == f"# All\n\n## Names\n\n{head}\n| - | 3 | 37.7 |\n| a | 3 | 50.0 |\n| b | 1 | 12.3 |\n\n## Empty\n\n{head}\n"


def test_xpath_values(spark):
    texts = ["<a><b id='1'>x</b><b id='2'>y</b><b>z</b></a>", "<?xml version='1.0'?>\n<a><b id='9'/></a> ", "<a>", "not xml", "<a></a>trailing", "<a/><a/>", "<a><b></a></b>", "", None, "<a>&x;</a>", "<a id=1/>", "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").withColumn("value", F.lit(1))
    got = lambda path: sorted((r.i, r.match_index, r.value) for r in T.xpath_values(rows, "x", path).collect())
    assert got("//@id") == [(0, 0, "1"), (0, 1, "2"), (1, 0, "9")]
    assert got("/a/b[position()<3]/text()") == [(0, 0, "x"), (0, 1, "y")]
    assert got("count(//b)") == [(0, 0, "3"), (1, 0, "1")] and got("string(//b[2])") == [(0, 0, "y"), (1, 0, "")]
    assert got("//b[@id > 1]/@id") == [(0, 0, "2"), (1, 0, "9")] and got("//none/text()") == []
