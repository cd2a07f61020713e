"""Periodic runs: stretches of words that repeat with a period, found by recursive frequency splitting and lag scans.

A run is a stretch of at least `least` words and two periods in which words one period apart are the same, that no
neighbouring word extends, under its smallest period.

Every word of a run stands in it twice or more. So a word that stands once in a segment is in no run of that segment and
splits it; what is left is shorter, its words are rarer there, and the splitting goes on until nothing changes. Prose
falls apart in a few rounds. The segments that survive are scanned by lags: at the middle of a segment every lag at
which the word beside the middle recurs is extended to both sides, which finds all runs over the middle, and both halves
go the same way. How far words agree at a lag comes from ranks of all spans of 1, 2, 4... words, compared exactly, so a
segment of n words takes about n log(n) steps, whatever it holds.

The splitting only saves work: a segment that is still changing after ROUNDS rounds is scanned as it is.

Defined results: a null text has no words and no runs, and its collapsed text is empty; words are separated by ASCII
white space; equal rows have equal results. Other columns pass unchanged; columns named like the operator's own are
replaced. Memory: a few MB of texts, or one longer text, at a time; words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._memory import tidy
from ._words import Words, chunks, texts_of

LEAST = 12
ROUNDS = 40

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_OUT = {"n_words": T.LongType(), "runs": T.ArrayType(_RUN), "collapsed": T.StringType()}


def split_by_frequency(word: np.ndarray, owner: np.ndarray, least: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Places that may be in runs, and borders of the segments they make: segment i has the places borders[i]:borders[i + 1].

    word: a number for each word; owner: its text's number, rising.
    """
    at, n = np.arange(len(word)), np.int64(word.max()) + 1 if len(word) else np.int64(1)
    borders = np.zeros(1, np.int64)
    for _ in range(rounds):
        if not len(at):
            return at, np.zeros(1, np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
        borders = np.append(np.flatnonzero(new), len(at))
        size = np.diff(borders)
        segment = np.repeat(np.arange(len(size)), size)
        keys = segment * n + word[at]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        single = np.ones(len(keys), bool)
        same = keys[1:] == keys[:-1]
        single[1:] &= ~same
        single[:-1] &= ~same
        stays = np.repeat(size >= least, size)
        stays[order[single]] = False
        if stays.all():
            return at, borders
        at = at[stays]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
    return at, np.append(np.flatnonzero(new), len(at))


class Spans:
    """Ranks of the spans of 1, 2, 4... numbers from each place on: equal spans, and no others, have equal ranks."""

    def __init__(self, numbers: np.ndarray, longest: int):
        self.ranks = [numbers.astype(np.int32)]
        while 1 << len(self.ranks) <= longest:
            last, half = self.ranks[-1], 1 << len(self.ranks) - 1
            if len(last) <= half:
                break
            keys = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.ranks.append(np.unique(keys, return_inverse=True)[1].astype(np.int32))

    def _agree(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ranks = self.ranks[level]
        inside = (i >= 0) & (j >= 0) & (i < len(ranks)) & (j < len(ranks))
        out = np.zeros(len(i), bool)
        out[inside] = ranks[i[inside]] == ranks[j[inside]]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and from j on agree."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            out += self._agree(level, i + out, j + out).astype(np.int64) << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers up to i and up to j, themselves included, agree."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            back = (1 << level) - 1
            out += self._agree(level, i - out - back, j - out - back).astype(np.int64) << level
        return out


def scan_lags(word: np.ndarray, borders: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs in the segments word[borders[i]:borders[i + 1]], by start, then period."""
    none = np.empty(0, np.int64)
    size = np.diff(borders)
    keep = size >= least
    if not keep.any():
        return none, none, none
    # one array of all segments, each behind a number of its own, which nothing agrees with
    n_segments = len(size)
    shifted = np.repeat(np.arange(1, n_segments + 1), size) + np.arange(len(word))
    numbers = np.empty(len(word) + n_segments, np.int64)
    fences = borders[:-1] + np.arange(n_segments)
    numbers[fences] = np.arange(n_segments)
    numbers[shifted] = word + n_segments
    numbers = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    spans = Spans(numbers, int(size.max()))
    low, high = (fences + 1)[keep], (fences + 1 + size)[keep]
    found = []
    while len(low):
        middle = (low + high) // 2
        width = high - low
        total = int(width.sum())
        node = np.repeat(np.arange(len(low)), width)
        at = np.arange(total) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        mid = middle[node]
        left = at < mid
        # a run over the middle has a whole period before it, and then the word at the middle one period earlier,
        # or one from it on, and then the word before the middle one period later
        recurs = numbers[at] == numbers[np.where(left, mid, mid - 1)]
        at, mid, left = at[recurs], mid[recurs], left[recurs]
        lag = np.where(left, mid - at, at - mid + 1)
        first = np.where(left, at, mid - 1)
        start = first - spans.backward(first - 1, first + lag - 1)
        stop = first + lag + spans.forward(first, first + lag)
        long = stop - start >= np.maximum(least, 2 * lag)
        found.append(np.column_stack((start[long], stop[long], lag[long])))
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
        wide = high - low >= least
        low, high = low[wide], high[wide]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # multiples of a run's period span the same words
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    fence = np.searchsorted(fences, rows[:, 0], "right") - 1
    shift = fence + 1
    return rows[:, 0] - shift, rows[:, 1] - shift, rows[:, 2]


def find_runs(word: np.ndarray, owner: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of all texts, by start, then period. word, owner: see split_by_frequency."""
    at, borders = split_by_frequency(word, owner, least, rounds)
    start, stop, period = scan_lags(word[at], borders, least)
    return at[start], at[stop - 1] + 1, period


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed.

    collapsed: the words joined by one space, without those that any run holds after its first period.
    """
    names = [c for c in docs.columns if c not in _OUT]
    schema = T.StructType([*docs.select(*names).schema.fields, *(T.StructField(k, v) for k, v in _OUT.items())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts):
                n_words, runs, collapsed = _of(texts[a:b], least)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(names).columns, n_words, runs, collapsed], [*names, *_OUT])

    return docs.select(*names, *([] if text in names else [text])).mapInArrow(run, schema)


def _of(texts: list[bytes], least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    words = Words(texts)
    owner = words.text_of_word()
    start, stop, period = find_runs(np.unique(words.hashes, return_inverse=True)[1].astype(np.int64), owner, least)
    gone = np.zeros(len(owner) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, stop, -1)
    stays = np.cumsum(gone[:-1]) == 0
    collapsed = []
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if stays[a:b].all():
            collapsed.append(b" ".join(texts[i].split()))
        else:
            keep = np.flatnonzero(stays[a:b]) + a
            collapsed.append(b" ".join([words.data[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist())]))
    text_of = owner[start] if len(start) else np.empty(0, np.int64)
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - words.first[text_of], stop - start, period)], ["start", "length", "period"])
    offsets = np.searchsorted(text_of, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.array(words.counts(), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(collapsed, pa.binary()).cast(pa.string())


def looped(key: str, text: str) -> Column:
    """The text, or for a tenth of the keys, by their checksum, its words with the end replaced by repetitions.

    With h the unsigned crc32 of the decimal key and g = floor(h / 10): where h % 10 = 0 and there are n > 0 words, each
    word i from a = g % n on is word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null key changes nothing.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))

    def made(w: Column) -> Column:
        g, n = F.floor(h / 10), F.array_size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = lambda x, i: F.get(w, F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p))
        return F.get(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(w, lambda _, i: at(x, i)), " ")), 0)

    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda x: x != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.array_size(w) > 0, made(w)).otherwise(F.col(text))), 0)
    return F.when(h % 10 == 0, changed).otherwise(F.col(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(docs.select("doc_id", looped("doc_id", "text").alias("text")))
    longest = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("start"), r.period.alias("period")))), 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    out = out.select("doc_id", F.array_size("runs").cast("long").alias("n_runs"), longest.alias("_top"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("_lines"), "collapsed")
    length = -F.col("_top.l")
    return out.select(
        "doc_id",
        "n_runs",
        F.col("_top.start").alias("start"),
        length.alias("length"),
        F.col("_top.period").alias("period"),
        F.floor(1000 * length / F.col("_top.period")).alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
