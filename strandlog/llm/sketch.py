"""Document fingerprints: threshold-scaled sketches.

A fingerprint keeps every distinct five-word shingle hash below a fixed fraction of the hash range, whatever the
document's length, so that the sketch of a union is the union of sketches and containment between very unequal
documents is estimated from the same sample on both sides.

Defined results: a null text counts as empty; a text of fewer than five words is one shingle; a text without words,
or whose shingles all miss the fraction, has the empty fingerprint. Two empty fingerprints are alike (1.0) if the
texts are equal, else not at all (0.0). Equal texts have equal fingerprints. Memory: a few MB of texts at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._memory import tidy
from ._words import Words, chunks, shingle_sets, texts_of

SHINGLE = 5
ONE_OF = 8
BUCKET_BYTES = 8 << 20
#: The driver holds one border for each bucket of ids, so their number is bounded; rows stream through a bucket.
MOST_BUCKETS = 10_000


def sketches(texts: list[bytes], k: int = SHINGLE, one_of: int = ONE_OF) -> list[np.ndarray]:
    """Of each text the sorted shingle hashes below 2**64 / one_of."""
    out = []
    limit = np.uint64((1 << 64) // one_of - 1)
    for a, b in chunks(texts):
        first, hashes = shingle_sets(Words(texts[a:b]), k)
        out += [hashes[i : i + np.searchsorted(hashes[i:j], limit, "right")] for i, j in zip(first[:-1], first[1:])]
    return out


def likeness(a: np.ndarray, b: np.ndarray, equal: bool = False) -> float:
    """Estimated Jaccard similarity of two sketches."""
    if not len(a) and not len(b):
        return float(equal)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, text: str = "text", k: int = SHINGLE, one_of: int = ONE_OF) -> DataFrame:
    """docs with sketch: the kept hashes as sorted signed 64-bit integers. Other columns pass; one named sketch is replaced."""
    names = [c for c in docs.columns if c != "sketch"]
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("sketch", T.ArrayType(T.LongType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(x.view(np.int64)) for x in sketches(texts_of(batch.column(text)), k, one_of)]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(found, pa.list_(pa.int64()))], [*names, "sketch"])

    return docs.mapInArrow(run, schema)


def merged(a: Column | str, b: Column | str) -> Column:
    """The sketch of two documents' union."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column | str, b: Column | str) -> Column:
    """Estimated share of a's shingles that b has; null if a's sketch is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs as (_bucket, key, text, _halo), to be read in order: each row's next document by descending key follows it.

    Keys are dealt into ranges. A range ends with a copy of the next range's first document (_halo), the last range
    with one of the first of all. A null key comes last; rows of one key come by text.
    """
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias(text), order.alias("_order"))
    size = rows.agg(F.sum(F.octet_length(text)).alias("bytes")).first()["bytes"] or 0
    n = min(MOST_BUCKETS, max(1, math.ceil(size / BUCKET_BYTES)))
    borders = rows.agg(F.percentile_approx("_order", [i / n for i in range(1, n)] or [0.5], 100_000).alias("x")).first()["x"] or []
    borders = sorted(set(borders)) if n > 1 else []
    bucket = F.lit(0)
    if borders:  # first among groups of borders, then within one
        step = math.isqrt(len(borders)) + 1
        groups = [borders[i : i + step] for i in range(0, len(borders), step)]
        below = lambda xs: F.array_size(F.filter(xs, lambda x: x < F.col("_order")))
        group = below(F.array(*(F.lit(g[-1]) for g in groups)))
        inside = F.coalesce(F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group), F.array().cast("array<bigint>"))
        bucket = F.lit(len(borders)) - F.least(group * step + below(inside), F.lit(len(borders)))
    bucket = bucket.cast("int")
    rows = rows.withColumn("_bucket", bucket)
    heads = sorted((r["_bucket"], r["head"]) for r in rows.groupBy("_bucket").agg(F.max("_order").alias("head")).collect())
    if not heads:
        return rows.withColumn("_halo", F.lit(False)).drop("_order")
    links = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    to = docs.sparkSession.createDataFrame([(b, h) for b, h in links], "_to int, _order long")
    first = rows.where(F.col("_order").isin([h for _, h in links])).join(F.broadcast(to), "_order")  # at most MOST_BUCKETS rows
    halo = first.select(key, text, "_order", F.col("_to").alias("_bucket"), F.lit(True).alias("_halo"))
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo)
    return both.repartition("_bucket").sortWithinPartitions("_bucket", "_halo", F.desc("_order"), text).drop("_order")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "_bucket", "_halo"))))
                rows = waiting + rows
                yield from compare(rows)
                waiting = rows[-1:]

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[3]]
        if not pairs:
            return
        edited = []
        for x, y in pairs:
            k = len(x[1]) // 3
            edited.append((x[1][: len(x[1]) - k] + y[1][:k]).encode())
        own = sketches([r[1].encode() for r in rows])
        at = [i for i in range(len(rows) - 1) if not rows[i][3]]
        new = sketches(edited)
        as_hex = lambda s: s.astype(">u8").tobytes().hex()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x, _ in pairs], pa.int64()),
                pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array([as_hex(own[i]) for i in at]),
                pa.array([as_hex(e) for e in new]),
                pa.array([likeness(own[i], e, x[1].encode() == t) for i, e, (x, _), t in zip(at, new, pairs, edited)]),
                pa.array([likeness(own[i], own[i + 1], x[1] == y[1]) for i, (x, y) in zip(at, pairs)]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs, "doc_id", "text").mapInArrow(run, schema)
