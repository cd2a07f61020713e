"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a few transformed statistics (lengths, shares of character kinds, repetition). Per class the mean
and covariance come from sums over all labelled rows, gathered by Spark; the covariance is shrunk towards the pooled
one and a multiple of the identity. A score is the logistic of the difference of the classes' log densities, whose
Mahalanobis terms use the Cholesky factors that the driver computes once.

Defined results: a null or empty text has the statistics of an empty text and gets a score; a label that is null is
not used; repeated label rows all count; without a labelled row of both classes every score is the share of label 1
(0.5 without any). Only the text enters a score. Memory: a few MB of texts; the model has a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._memory import tidy
from ._shared import aside, kept
from ._words import Words, chunks, texts_of

FOLDS = 5
THRESHOLD = 0.3
#: Weights of the pooled covariance and of the identity in each class's covariance.
TO_POOLED, TO_IDENTITY = 0.1, 0.1

_KINDS = {
    "upper": bytes(range(0x41, 0x5B)),
    "digit": b"0123456789",
    "stop": b".,;:?-'\"()",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "line": b"\n",
    "blank": b" \t\r",
}
FEATURES = (*_KINDS, "other", "bytes", "words", "word_bytes", "distinct", "top_word", "repeated_lines", "odd_ends", "upper_words", "short_words", "sentence")


def _per_text(words: Words, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return sums[words.first[1:]] - sums[words.first[:-1]]


def _repeats(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words or lines of each text, and how often its most frequent one stands in it."""
    distinct, top = np.zeros(len(words)), np.zeros(len(words))
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        if b > a:
            x = np.sort(words.hashes[a:b])
            edges = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
            distinct[i], top[i] = len(edges) - 1, np.diff(edges).max()
    return distinct, top


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics, named by FEATURES, for each text."""
    words, lines = Words(texts), Words(texts, b"\n")
    size = np.fromiter(map(len, texts), np.float64, len(texts))
    borders = np.concatenate(([0], np.cumsum(size + 1))).astype(np.int64)
    kind = np.zeros(256, np.uint8)
    for i, chars in enumerate(_KINDS.values(), 1):
        kind[list(chars)] = i
    kind[0x80:] = len(_KINDS) + 1
    of = kind[words.buffer]
    shares = []
    for i in range(1, len(_KINDS) + 2):
        sums = np.concatenate(([0], np.cumsum(of == i)))
        shares.append(sums[borders[1:] - 1] - sums[borders[:-1]])
    n = words.counts().astype(np.float64)
    first, last = of[words.starts] if len(words.starts) else np.empty(0), of[words.ends - 1] if len(words.ends) else np.empty(0)
    names = list(_KINDS)
    length = (words.ends - words.starts).astype(np.float64)
    odd = np.isin(last, [1 + names.index(x) for x in ("bang", "bar", "symbol")])
    distinct, top = _repeats(words)
    n_lines, (distinct_lines, _) = lines.counts().astype(np.float64), _repeats(lines)
    few = 4  # one line said twice weighs little in a short text
    stops = np.isin(words.buffer[words.ends - 1], list(b".?!")) if len(words.ends) else np.empty(0)
    some = np.maximum(n, 1)
    return np.column_stack(
        [
            *(np.sqrt(x / np.maximum(size, 1)) for x in shares),
            np.log1p(size),
            np.log1p(n),
            np.log1p(_per_text(words, length) / some),
            distinct / some,
            np.sqrt(top / some),
            np.sqrt((n_lines - distinct_lines) / (n_lines + few)),
            np.sqrt(_per_text(words, odd) / some),
            np.sqrt(_per_text(words, first == 1) / some),
            _per_text(words, length <= 3) / some,
            np.log1p(n / (1 + _per_text(words, stops))),
        ]
    )


def with_statistics(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns and `statistics`, an array of doubles."""
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("statistics", T.ArrayType(T.DoubleType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts):
                rows = statistics(texts[a:b])
                flat = pa.array(rows.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(FEATURES), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(columns).columns, lists], [*columns, "statistics"])

    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Per class the mean, the inverse Cholesky factor and the log density's constant."""

    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    classes: tuple | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(rows), self.share)
        x = (rows - self.mean) / self.scale
        logs = []
        for centre, inverse, constant in self.classes:
            y = (x - centre) @ inverse.T
            logs.append(constant - 0.5 * (y * y).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit(rows: DataFrame) -> Model:
    """rows: statistics and label (0 or 1). Spark adds up counts, sums and products; the driver gets their totals."""
    d = len(FEATURES)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column("statistics")), np.asarray(batch.column("label"))
            for k in (0, 1):
                z = x[y == k]
                totals[k] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)))
        n = totals.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(totals.reshape(-1))], ["label", "at", "value"])

    sums = rows.select("statistics", "label").mapInArrow(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    totals = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # two classes of a few hundred numbers
        totals[r.label, r.at] = r.value
    counts = totals[:, 0]
    share = counts[1] / counts.sum() if counts.sum() else 0.5
    if counts.min() < 2:
        return Model(share)
    n, both = counts.sum(), totals.sum(axis=0)
    mean = both[1 : d + 1] / n
    scale = np.sqrt(np.maximum(np.diag(both[d + 1 :].reshape(d, d)) / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    centres, spreads = [], []
    for k in (0, 1):
        m = totals[k, 1 : d + 1] / counts[k]
        cov = totals[k, d + 1 :].reshape(d, d) / counts[k] - np.outer(m, m)
        centres.append((m - mean) / scale)
        spreads.append(cov / np.outer(scale, scale))
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / n
    classes = []
    for k in (0, 1):
        cov = (1 - TO_POOLED - TO_IDENTITY) * spreads[k] + TO_POOLED * pooled + TO_IDENTITY * np.eye(d)
        factor = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        classes.append((centres[k], np.linalg.inv(factor), np.log(counts[k] / n) - np.log(np.diag(factor)).sum()))
    return Model(share, mean, scale, tuple(classes))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with `statistics`) with score in its place."""
    names = [c for c in rows.columns if c not in ("statistics", "score")]
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("score", T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch.column("statistics")))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(scores)], [*names, "score"])

    return rows.mapInArrow(run, schema)


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, from the text to the score in one step."""
    names = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("score", T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts):
                scores = model.scores(statistics(texts[a:b]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(names).columns, pa.array(scores)], [*names, "score"])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that no model learns from; a null id, which no label can name, counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit_on_labels(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """rows: key and statistics; labels: key and quality."""
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out(key)).select(key, F.col("quality").cast("int").alias("label"))
    return fit(rows.where(~held_out(key)).join(marks, key).select("statistics", "label"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is at least the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_on_labels(with_statistics(docs, ["doc_id"]), labels)
    rows, back = aside(docs, "doc_id", "text")
    return back(with_scores(rows, model).where(F.col("score") >= THRESHOLD))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = kept(with_statistics(docs, ["doc_id"]))
    model = fit_on_labels(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(rows, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
