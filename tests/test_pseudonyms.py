"""Stand-ins keep the form of what they stand for, and no two values share one."""

from __future__ import annotations

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from strandlog.operators import pseudonyms as P

PATTERNS = dict((*P.KINDS, P.WORD))


def text_of(spark, *texts, words=False, salt="salt"):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return [x.t for x in P.anonymize(rows, "t", salt, words).orderBy("id").collect()]


def test_tokens_in_texts(spark):
    got = text_of(
        spark,
        "mail a.b@c.example from 10.0.0.1 at /home/u/file.txt id 123e4567-e89b-12d3-a456-426614174000 and https://bob:pw@c.example/a%20b/10.0.0.1?key=val#frag",
        "a.b@c.example", None, "", "plain and/or words 12", "u'127.0.1.1' says hi", "ether f2:09:1a:a2:e3:e2 key f2:09:1a:a2", "cc 6011 1111 1111 1117 or 6011111111111117", '<item name="Bob" n=\'7\'>Bob</item>',
    )
    assert got[2:5] == [None, "", "plain and/or words 12"]
    first, mail = got[0].split(), got[1]
    assert first[1] == mail and re.fullmatch(PATTERNS["email"], mail) and mail != "a.b@c.example"
    assert re.fullmatch(r"https://[a-z]{3}:[a-z]{2}@[a-z]\.[a-z]{7}/[a-z]%20[a-z]/[\d.]+\?[a-z]{3}=[a-z]{3}#[a-z]{4}", first[9])
    assert first[9].split("@")[1].split("/")[0] == mail.split("@")[1], "a host has one stand-in"
    address = ipaddress.ip_address(first[3])
    assert str(address) != "10.0.0.1" and f"/{address}?" in first[9]
    assert re.fullmatch(r"/[a-z]{4}/[a-z]/[a-z]{4}\.[a-z]{3}", first[5]) and re.fullmatch(PATTERNS["uuid"], first[7])
    assert re.fullmatch(r"u'[\d.]+' says hi", got[5]) and "127.0.1.1" not in got[5]
    assert re.fullmatch(r"ether (?:[0-9a-f]{2}:){5}[0-9a-f]{2} key (?:[0-9a-f]{2}:){3}[0-9a-f]{2}", got[6]) and "f2:09" not in got[6]
    cards = re.fullmatch(r"cc (\d{4}(?: \d{4}){3}) or (\d{16})", got[7])
    assert cards and "6011" not in cards[1]
    assert re.fullmatch(r'<item name="[A-Z][a-z]{2}" n=\'\d\'>Bob</item>', got[8]) and "Bob" not in got[8][:16]


def test_words_keep_their_case_and_short_ones_stay(spark):
    (got,) = text_of(spark, "state is Constants.DOWNLOAD_STARTED since 2022-06-02T12:26:22.072Z", words=True)
    assert re.fullmatch(r"[a-z]{5} is [A-Z][a-z]{8}\.[A-Z]{8}_[A-Z]{7} [a-z]{5} 2022-06-02T12:26:22.072Z", got) and "DOWNLOAD" not in got


def test_salts_differ_and_partitions_agree(spark):
    assert text_of(spark, "a.b@c.example", salt="x") != text_of(spark, "a.b@c.example", salt="y")
    rows = spark.range(200).select(F.lit("10.1.2.3 user@host.example").alias("t")).repartition(7)
    assert P.anonymize(rows, "t", "s").distinct().count() == 1


@pytest.mark.parametrize("kind,make,limit", (("ipv4", lambda r: f"{r.choice((0, 255))}.{r.randrange(256)}.{r.randrange(4)}.{r.randrange(4)}", 8192), ("hex", lambda r: f"{r.randrange(256):02x}", 256), ("word", lambda r: "".join(r.choice("abz") for _ in range(3)), 27)))
def test_small_sets_permuted_whole(kind, make, limit):
    r = random.Random(1)
    p = P.Permuter("k")
    values = {make(r) for _ in range(30_000)}
    assert limit * 0.9 < len(values) <= limit and len({p.of(kind, v) for v in values}) == len(values)


def test_a_million_distinct_values(spark):
    i = F.col("id")
    value = (
        F.when(i % 4 == 0, F.concat_ws(".", *((F.floor(i / 256**k) % 256).cast("string") for k in (3, 2, 1, 0))))
        .when(i % 4 == 1, F.concat(F.lit("user"), i.cast("string"), F.lit("@host.example")))
        .when(i % 4 == 2, F.concat(F.lit("+"), F.lpad(i.cast("string"), 12, "0")))
        .otherwise(F.concat(F.lit("0x"), F.lower(F.hex(i))))
    )
    kind = F.get(F.array(*map(F.lit, ("ipv4", "email", "phone", "hex"))), (i % 4).cast("int"))
    rows = P.stand_ins(spark.range(0, 1_000_000, 1, 8).select(value.alias("v"), kind.alias("kind")), "v", "kind", salt="s")
    fits = F.lit(False)
    for name in ("ipv4", "email", "phone", "hex"):
        fits = F.when(F.col("kind") == name, F.col("stand_in").rlike(f"^(?:{PATTERNS[name]})$")).otherwise(fits)
    got = rows.agg(F.count_distinct("v").alias("n"), F.count_distinct("stand_in").alias("m"), F.count_if(~fits).alias("odd"), F.count_if(F.col("v") == F.col("stand_in")).alias("same")).first()
    assert (got.n, got.m, got.odd) == (1_000_000, 1_000_000, 0) and got.same < 100


def test_columns_and_empty_table(spark):
    rows = spark.createDataFrame([("x", "10.0.0.1", 3)], "stand_in string, v string, kind_no int").withColumn("kind", F.lit("ipv4"))
    got = P.stand_ins(rows, "v", "kind")
    assert got.columns == ["v", "kind_no", "kind", "stand_in"] and got.first().kind_no == 3
    assert P.anonymize(rows.limit(0), "v").collect() == []
