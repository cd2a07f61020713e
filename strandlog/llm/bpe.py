"""Byte-level BPE with a hierarchical-bitmap rank queue.

Texts are split as the public pattern says, on arrays of code points. The distinct pieces of a few MB of text that
the task hasn't met yet lie one behind another as linked lists of tokens, a border between them. Each merge rank has a
bucket with the places whose pair has this rank; three levels of 64-bit words say which buckets are in use, and
find-first-set picks the lowest. A bucket is worked off as one array: entries whose pair has changed meanwhile are
stale and skipped, the rest merge, and the pairs that arise go to their buckets.

Merging all of a bucket at once gives what merging one by one gives unless the merged token takes part in a pair of
lower rank; such tokens are known from the vocabulary. Of their buckets, pieces with several entries merge from left to
right, and what arises at this rank or a lower one goes first. An entry costs a logarithm of their number, so one
enormous piece takes time in proportion to its length, whatever it holds.

Defined results: a null or empty text has no ids and decodes to nothing. Other columns pass unchanged; columns named
like the operator's own are replaced. Memory: a text and a few MB of others; the vocabulary, whose file is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._memory import tidy
from ._shared import aside
from ._words import chunks, texts_of

CHUNK_BYTES = 512 << 10
#: Pieces a task remembers, and their bytes; beyond either it starts afresh.
REMEMBER, REMEMBER_BYTES = 100_000, 4 << 20
NO_RANK = np.int64(1 << 40)

# The code points of white space and the contractions that the public pattern names.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def code_point_classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[WHITE] = SPACE
    return out


def split_points(cp: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces start. cp: the code points of all texts; begins: flags of texts' first code points."""
    n = len(cp)
    kind = classes[cp]
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    follows = np.zeros(n, bool)  # the next code point is of the same text and not white
    follows[:-1] = ~white[1:] & ~begins[1:]
    last = white & follows
    start |= last  # the last white code point before a word is a piece of its own or opens the word's piece
    opens = np.flatnonzero(last & (cp == 0x20))
    start[opens + 1] = False
    quotes = np.flatnonzero((cp == 0x27) & start & follows)
    if len(quotes):
        border = np.flatnonzero(begins)
        end = np.append(border[1:], n)[np.searchsorted(border, quotes, "right") - 1]
        after = cp[quotes + 1]
        third = cp[np.minimum(quotes + 2, n - 1)]
        length = np.where(np.isin(after, [ord(c) for c in SHORT_ENDINGS]), 2, 0)
        for a, b in LONG_ENDINGS:
            length[(after == ord(a)) & (third == ord(b)) & (quotes + 2 < end)] = 3
        hit = length > 0
        start[quotes[hit] + 1] = False
        start[quotes[hit & (length == 3)] + 2] = False
        to = quotes[hit] + length[hit]
        start[to[to < n]] = True
    return np.flatnonzero(start)


class RankQueue:
    """Buckets of places by rank, and three levels of bits over the buckets in use."""

    def __init__(self, ranks: int):
        self.buckets: list[list] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.middle = [0] * (len(self.low) // 64 + 1)
        self.high = 0

    def push(self, rank: int, places) -> None:
        if not self.buckets[rank]:
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.middle[b] |= 1 << (a & 63)
            self.high |= 1 << b
        self.buckets[rank].append(places)

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.high:
            return None
        b = (self.high & -self.high).bit_length() - 1
        a = (b << 6) + (self.middle[b] & -self.middle[b]).bit_length() - 1
        rank = (a << 6) + (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.middle[b] &= ~(1 << (a & 63))
            if not self.middle[b]:
                self.high &= ~(1 << b)
        found, self.buckets[rank] = self.buckets[rank], []
        return rank, np.concatenate(found) if len(found) > 1 else found[0]

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edges = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        for r, i, j in zip(ranks[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(ranks)]):
            self.push(r, places[i:j])


def token_list(data: bytes) -> list[bytes]:
    """The tokens of a rank file, each at its rank."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, data.splitlines())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Vocabulary:
    """The tables of a rank file: base64 of a token and its rank on each line."""

    def __init__(self, data: bytes):
        tokens = token_list(data)
        self.ranks = {token: rank for rank, token in enumerate(tokens) if token}
        self.n, self.tokens = len(tokens), tokens
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.border = self.n  # no token; takes part in no pair
        self.shift = np.int64(self.n.bit_length() + 1)
        pairs, merged = [], []
        lower = np.zeros(self.n, bool)
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << int(self.shift)) | b)
                    merged.append(rank)
                    lower[a] |= rank < a
                    lower[b] |= rank < b
        order = np.argsort(pairs)
        self.pairs, self.merged = np.append(np.array(pairs)[order], 1 << 62), np.append(np.array(merged)[order], NO_RANK)
        self.lower = lower
        self.classes = code_point_classes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.ids, self.first = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << self.shift) | b
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.merged[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces, and the number of each piece's tokens, by the rank queue."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        heads = np.cumsum(lengths + 1) - lengths  # a border before each piece, and one at the end
        size = int((lengths + 1).sum()) + 1
        inside = np.ones(size, bool)
        inside[heads - 1] = inside[-1] = False
        token = np.full(size, self.border)
        token[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.cumsum(~inside)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        rank = np.full(size, NO_RANK)
        rank[:-1] = self.pair_ranks(token[:-1], token[1:])
        dead = np.zeros(size, bool)
        queue = RankQueue(self.n)
        have = np.flatnonzero(rank < NO_RANK)
        if len(have):
            queue.push_all(rank[have], have)
        while (popped := queue.pop()) is not None:
            r, at = popped
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                if self.lower[r]:
                    same = owner[at[1:]] == owner[at[:-1]]
                    if same.any():
                        several = np.append(same, False) | np.append(False, same)
                        self._in_turn(r, at[several], token, rank, after, before, dead, queue)
                        at = at[~several]
                        if not len(at):
                            continue
                elif (meets := after[at[:-1]] == at[1:]).any():  # as in "aaa": of touching entries every other one
                    take = np.ones(len(at), bool)
                    for i in np.flatnonzero(meets):
                        take[i + 1] = not take[i]
                    at = at[take]
            second = after[at]
            third = after[second]
            token[at] = r
            after[at] = third
            before[third] = at
            dead[second] = True
            rank[second] = NO_RANK
            places = np.concatenate((before[at], at))
            ranks = self.pair_ranks(token[places], token[after[places]])
            rank[places] = ranks
            some = ranks < NO_RANK
            if some.any():
                ranks, places = ranks[some], places[some]
                if len(ranks) > 48:
                    queue.push_all(ranks, places)
                else:
                    for i, x in enumerate(ranks.tolist()):
                        queue.push(x, places[i : i + 1])
        stays = inside & ~dead
        return token[stays].astype(np.uint32), np.bincount(owner[stays] - 1, minlength=len(pieces))

    def _in_turn(self, r: int, places: np.ndarray, token, rank, after, before, dead, queue: RankQueue) -> None:
        """Merges these entries of rank r one by one from the left; before each, all of lower rank that has arisen."""
        turn = [(r, at) for at in places.tolist()]
        while turn:
            x, at = heapq.heappop(turn)
            if rank[at] != x:
                continue
            second = after[at]
            third = after[second]
            token[at] = x
            after[at] = third
            before[third] = at
            dead[second] = True
            rank[second] = NO_RANK
            for q in (int(before[at]), at):
                a, b = token[q], token[after[q]]
                y = int(NO_RANK) if a == self.border or b == self.border else self.ranks.get(self.tokens[a] + self.tokens[b], int(NO_RANK))
                rank[q] = y
                if y <= r:
                    heapq.heappush(turn, (y, q))
                elif y < NO_RANK:
                    queue.push(y, np.array([q]))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text."""
        data = b"".join(texts)
        out = [np.empty(0, np.uint32)] * len(texts)
        if not data:
            return out
        cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        width = 1 + (cp >= 0x80).view(np.uint8) + (cp >= 0x800).view(np.uint8) + (cp >= 0x10000).view(np.uint8)
        place = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        begins = np.zeros(len(cp), bool)
        heads = np.searchsorted(place, borders[:-1])
        begins[heads[heads < len(cp)]] = True
        starts = place[split_points(cp, begins, self.classes)]
        ends = np.append(starts[1:], len(data))
        pieces = [data[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        if len(self.known) > REMEMBER or self.known_bytes > REMEMBER_BYTES:
            self.forget()
        self._learn([p for p in dict.fromkeys(pieces) if p not in self.known])
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        counts = np.diff(self.first)[at]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[at] - total[:-1], counts)]
        cuts = total[np.searchsorted(starts, borders)]
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:])]

    def _learn(self, pieces: list[bytes]) -> None:
        if not pieces:
            return
        whole = [self.ranks.get(p) for p in pieces]
        rest = [i for i, x in enumerate(whole) if x is None]
        counts = np.ones(len(pieces), np.int64)
        merged = np.empty(0, np.uint32)
        if rest:
            merged, counts[rest] = self.merge([pieces[i] for i in rest])
        first = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(first[-1], np.uint32)
        is_whole = np.array([x is not None for x in whole])
        ids[np.repeat(is_whole, counts)] = [x for x in whole if x is not None]
        ids[np.repeat(~is_whole, counts)] = merged
        self.known.update(zip(pieces, range(len(self.first) - 1, len(self.first) - 1 + len(pieces))))
        self.known_bytes += sum(map(len, pieces))
        self.first = np.concatenate((self.first, self.first[-1] + first[1:]))
        self.ids = np.concatenate((self.ids, ids))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """The tables of a rank file's content; a Python worker builds them once."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(data)
    return _loaded[key]


def _with(docs: DataFrame, **columns: T.DataType) -> tuple[list[str], T.StructType]:
    names = [c for c in docs.columns if c not in columns]
    return names, T.StructType([*docs.select(*names).schema.fields, *(T.StructField(k, v) for k, v in columns.items())])


def encode(docs: DataFrame, path: str, text: str = "text", back: bool = False) -> DataFrame:
    """docs with n_tokens and ids: a text's ids as little-endian unsigned 32-bit integers (binary).

    back: with decoded as well, what decode() makes of the ids, by the same Python worker.
    """
    new = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"decoded": T.BinaryType()} if back else {})
    names, schema = _with(docs, **new)
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value)
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts, CHUNK_BYTES):
                ids = v.encode(texts[a:b])
                out = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if back:
                    out.append(pa.array([b"".join([v.tokens[i] for i in x.tolist()]) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(names).columns, *out], [*names, *new])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with decoded: the bytes of the tokens in `ids` (as encode() gives them)."""
    names, schema = _with(docs, decoded=T.BinaryType())
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_list(ranks.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = part.column(ids).to_pylist()
                out = [b"".join([tokens[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in rows]
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return docs.mapInArrow(run, schema)


def _digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encode(docs, path, back=True)
    return out.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("decoded", 256))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with the number of their ids and the digests; columns of these names are replaced."""
    rows, _ = aside(docs, "doc_id", "text")
    names = dict(zip(docs.columns, rows.columns))
    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    return _digests(rows).select(*(F.col(new).alias(c) for c, new in names.items() if c not in own), *own)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
