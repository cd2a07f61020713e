"""Streams over small folders, drained and compared with what batch says."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strandlog.sources import formats, growing
from strandlog.streaming import ops, ordered


def feed(spark, folder, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")


def test_assembly_across_batches(spark, tmp_path):
    rows = [[("f", 3, "start b"), ("f", 1, " 1"), ("f", 0, " 0"), ("g", 0, "start z")], [("f", 5, "start c"), ("f", 2, " late"), ("f", 4, " 4")], [("f", 6, None), ("g", 1, " y")]]
    stream = feed(spark, tmp_path, rows, "log_path string, file_line long, value string")
    out = ordered.assembled(stream, f"file://{tmp_path}/out", F.col("value").startswith("start")).drained(stream)
    got = sorted((x.log_path, x.file_line, x.value, x.n_lines, x.late_line) for x in out.collect())
    assert got == [("f", 0, " 0", 1, False), ("f", 1, " 1", 1, False), ("f", 2, " late", 1, True), ("f", 3, "start b\n 4", 2, False), ("f", 5, "start c", 2, False), ("g", 0, "start z\n y", 2, False)]


LOG = "log_path string, file_line long, log_time timestamp, extra long"


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def brute_repair(rows):
    out, top = [], {}
    for path, line, time, x in sorted(rows, key=lambda r: (r[0], r[1])):
        new = max(top.get(path, time), time)
        out.append((path, line, new, time, new > time, x))
        top[path] = new
    return sorted(out)


@pytest.mark.parametrize("hold", ("1 hour", "30 seconds"))
def test_repair_of_shuffled_batches(spark, tmp_path, hold):
    r = random.Random(4)
    rows = [(f"f{i % 3}", i, at(i * 2 - r.choice([0, 0, 9])), i) for i in range(300)]
    near = sorted(rows, key=lambda x: x[1] + r.random() * 12)  # lines are at most 12 from their place, 24 seconds
    batches = [near[i : i + 60] for i in range(0, 300, 60)]
    for b in batches:
        r.shuffle(b)
    stream = feed(spark, tmp_path, batches, LOG)
    out = ordered.repaired(stream, f"file://{tmp_path}/out", hold).drained(stream)
    got = sorted((x.log_path, x.file_line, x.log_time, x.log_actual_time, x.time_skewed, x.extra) for x in out.collect())
    assert got == brute_repair(rows) and out.where("late_line").count() == 0


def test_late_lines_after_later_ones_were_given_out(spark, tmp_path):
    rows = [[("f", 5, at(50), 0), ("f", 4, at(60), 0)], [("f", 1, at(10), 0), ("f", 6, at(55), 0), ("f", 2, at(70), 0)], []]
    stream = feed(spark, tmp_path, [x for x in rows if x], LOG)
    out = ordered.repaired(stream, f"file://{tmp_path}/out").drained(stream)
    got = sorted((x.file_line, x.log_time, x.time_skewed, x.late_line) for x in out.collect())
    assert got == [(1, at(60), True, True), (2, at(70), False, True), (4, at(60), False, False), (5, at(60), True, False), (6, at(60), True, False)]


def test_batches_run_again_and_restarted(spark, tmp_path):
    """A batch that is run twice gives its rows once, and a stream started again goes on with its state."""
    first = [[("f", 0, at(9), 0)], [("f", 1, at(5), 0)]]
    stream = feed(spark, tmp_path, first, LOG)
    base = f"file://{tmp_path}/out"
    batches = ordered.repaired(stream, base)
    batches.drained(stream, end=False)
    batches.run(spark.createDataFrame(first[1], LOG), 1)
    spark.createDataFrame([("f", 2, at(7), 0)], LOG).coalesce(1).write.parquet(f"{tmp_path}/in7")
    again = ordered.repaired(stream, base)
    got = sorted((x.file_line, x.log_time, x.time_skewed) for x in again.drained(stream).collect())
    assert got == [(0, at(9), False), (1, at(9), True), (2, at(9), True)]


def test_formats_are_fixed_as_in_batch(spark, tmp_path):
    r = random.Random(6)
    lines = {
        "a": [f"2024-01-01 00:00:{i % 60:02}.179 {r.choice(['ERROR', 'INFO'])} value {i}" for i in range(40)],
        "b": ["no format here"] * 3 + [f"I0101 00:00:{i % 60:02}.179575 8 app.cc:69] view {i}" for i in range(37)],
        "c": ["nothing"] * 25,
        "d": ["2024-01-01 00:00:01.179 ERROR one"] * 5,
    }
    rows = [(p, i, v) for p, x in lines.items() for i, v in enumerate(x)]
    r.shuffle(rows)
    stream = feed(spark, tmp_path, [rows[i : i + 30] for i in range(0, len(rows), 30)], "log_path string, file_line long, value string")
    got = ordered.recognized(stream, f"file://{tmp_path}/out", sample=20, year=2024).drained(stream)
    table = spark.createDataFrame(rows, "log_path string, file_line long, value string")
    known = formats.detect(table, sample=20).where("log_format IS NOT NULL").select("log_path", "log_format")
    assert {x.log_path: x.log_format for x in known.collect()} == {"a": "generic_log", "b": "glog_log", "d": "generic_log"}
    want = ordered.parsed_as(table.join(known, "log_path"), ["generic_log", "glog_log"], formats.catalogue(), 2024)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 82


def test_watch_and_statistics(spark, tmp_path):
    rows = [[(1, 5.0), (2, 50.0)], [(3, 500.0)]]
    stream = feed(spark, tmp_path, rows, "id long, v double").withColumn("log_time", F.lit("2024-01-01").cast("timestamp"))
    out = ops.drain(ops.watch(stream, {"big": "v > 10", "huge": "v > 100"}, ["id"]), f"file://{tmp_path}/out")
    assert sorted((x.watch, x.content) for x in out.collect()) == [("big", '{"watch":"big","id":2}'), ("big", '{"watch":"big","id":3}'), ("huge", '{"watch":"huge","id":3}')]
    total = ops.drain(ops.statistics(stream.withColumn("k", F.lit(1)), ["k"], "v"), f"file://{tmp_path}/out", "complete").collect()
    assert [(x["count"], x["sum"], x["max"]) for x in total] == [(3, 555.0, 500.0)]


def test_growing_files(spark, tmp_path):
    """Appended, truncated, replaced and rotated files between the runs of one stream: each line once, also after a restart."""
    logs, base = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.log").write_text("a1\na2\npart")
    (logs / "b.log").write_text("b1\nb2\nb3\n")
    (logs / "r.log").write_text("r1\nr2\n")
    (logs / "_hidden").write_text("no\n")

    def run():
        rows = growing.follow(spark, str(logs), split_bytes=4)
        rows.writeStream.format("parquet").option("path", str(base / "table")).option("checkpointLocation", str(base / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted(x.value for x in spark.read.schema(growing.SCHEMA).parquet(str(base / "table")).collect())

    seen = ["a1", "a2", "b1", "b2", "b3", "r1", "r2"]
    assert run() == seen
    with open(logs / "a.log", "a") as f:
        f.write("ial\na3\n")  # appended, the open line among it
    (logs / "b.log").write_text("c1\n")  # truncated
    with open(logs / "r.log", "a") as f:
        f.write("r3\n")  # appended before it is rotated
    (logs / "r.log").rename(logs / "r.log.1")
    (logs / "r.log").write_text("s1\ns2\ns3\ns4\n")
    seen = sorted([*seen, "partial", "a3", "c1", "r3", "s1", "s2", "s3", "s4"])
    assert run() == seen
    assert run() == seen, "nothing new, nothing read again"
    (logs / "r.log.1").rename(logs / "r.log.2")
    (logs / "r.log").rename(logs / "r.log.1")
    (logs / "new.log").write_text("n1\nn2")
    assert run() == sorted([*seen, "n1"])


def test_growing_offsets_of_equal_first_lines(tmp_path):
    (tmp_path / "x.log").write_text("#head\n1\n")
    reader = growing.Growing({"path": str(tmp_path)})
    first = reader.latestOffset()
    (tmp_path / "y.log").write_text("#head\n2\n")
    second = reader.latestOffset()
    assert [(r.path[-5:], r.begin, r.end) for r in reader.partitions(first, second)] == [("y.log", 0, 8)]
    (tmp_path / "x.log").write_text("#head\n")
    assert [(r.path[-5:], r.begin, r.end) for r in reader.partitions(second, reader.latestOffset())] == [("x.log", 0, 6)]
