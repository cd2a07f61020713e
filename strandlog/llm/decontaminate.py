"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Test items are partitioned by the power of two below their number of distinct five-word shingles. Each partition has a
sketch size: of every item the so many smallest shingle hashes are its index keys. The size is one more than the
shingles that the partition's largest item may miss, so any document that contains an item to the threshold holds a
key of it: the search has no misses. Documents, however long, are not sketched; their shingles are held against a bit
table of fixed size first, then the rest against the keys, and each candidate is verified by exact containment.

The bit table only spares work: with very many items it fills up and lets more shingles through to the join.

Defined results: a null text counts as empty; a text or an item of fewer than five words has no shingles and matches
nothing; repeated rows of one doc_id and text give one row; items of equal item_id are searched each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept

SHINGLE = 5
THRESHOLD = 0.8
#: A power of two; the table has so many bits.
TABLE_BITS = 1 << 18

_BETWEEN_WORDS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _once(value: Column) -> Column:
    """value, in a form that the optimizer doesn't copy into the filters and projections above it.

    Those would work it out again for each element of a lambda. The id is never below 0.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _with_hashes(df: DataFrame, text: str, k: int) -> DataFrame:
    """df with _words: hashes of its words, lower-cased runs of ASCII letters and digits and non-ASCII characters."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _BETWEEN_WORDS), lambda w: w != "")
    return df.withColumn("_words", _once(F.transform(words, lambda w: F.xxhash64(w))))


def _shingles(k: int) -> Column:
    n = F.size("_words")
    parts = lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), parts)).otherwise(F.array().cast("array<bigint>"))


def item_index(items: DataFrame, item: str = "item_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(item, _set, _size, _keys): an item's distinct shingles, their number, and its index keys."""
    sets = _with_hashes(items.select(item, text), text, k).select(item, _once(F.array_sort(F.array_distinct(_shingles(k)))).alias("_set"))
    sets = sets.withColumn("_size", F.size("_set")).where(F.col("_size") > 0)
    largest = F.pow(F.lit(2), F.floor(F.log2("_size")) + 1) - 1
    missable = F.floor(largest * (1 - threshold) + 1e-9)
    return sets.withColumn("_keys", F.slice("_set", F.lit(1), (missable + 1).cast("int")))


def contained(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """(key, _row, item, n_shingles, n_shared, containment): the pairs in which a document has at least the threshold's share of an item's shingles.

    _row tells rows of one key with different texts apart: xxhash64 of the text.
    """
    index = item_index(items, item, text, k, threshold)
    at = F.col("h").bitwiseAND(TABLE_BITS - 1)
    bits = (
        index.select(F.explode("_set").alias("h"))
        .groupBy(F.shiftright(at, 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & {TABLE_BITS - 1} & 63 as int))")).alias("bits"))
    )
    table = [0] * (TABLE_BITS // 64)
    for r in bits.collect():  # TABLE_BITS / 64 rows at most
        table[r["word"]] = r["bits"]
    # one literal, made once by constant folding
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def maybe(h: Column) -> Column:
        place = h.bitwiseAND(TABLE_BITS - 1)
        return F.getbit(F.get(literal, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1

    rows = _with_hashes(docs.select(key, text), text, k).select(key, F.xxhash64(text).alias("_row"), _once(F.array_distinct(F.filter(_shingles(k), maybe))).alias("_hits"))
    rows = kept(rows.where(F.size("_hits") > 0))  # texts are read once, and candidates fetch their hits from here
    keys = index.select(F.col(item), F.explode("_keys").alias("_key"))
    found = rows.select(F.col(key).alias("_found"), F.col("_row").alias("_found_row"), F.explode("_hits").alias("_key")).join(keys, "_key").select("_found", "_found_row", item).distinct()
    found = found.join(rows, F.col("_found").eqNullSafe(F.col(key)) & (F.col("_found_row") == F.col("_row"))).select(key, "_row", item, "_hits")
    shared = F.size(F.array_intersect("_hits", "_set"))
    out = found.join(index.select(item, "_set", "_size").distinct(), item).withColumn("n_shared", shared.cast("long"))
    share = F.col("n_shared") / F.col("_size")
    return (
        out.where(F.col("n_shared") >= F.ceil(F.col("_size") * threshold - 1e-9))
        .select(key, "_row", item, F.col("_size").cast("long").alias("n_shingles"), "n_shared", share.alias("containment"))
        .distinct()
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no item."""
    hits = contained(docs, items, key=key, text=text).select(F.col(key).alias("_hit_key"), F.col("_row").alias("_hit_row")).distinct()
    return docs.join(hits, docs[key].eqNullSafe(F.col("_hit_key")) & (F.xxhash64(docs[text]) == F.col("_hit_row")), "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_row")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_shingles
"""
