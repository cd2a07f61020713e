"""Cross-tokenizer alignment: where tokens of two tokenizers end together, and how often two ids do so in the corpus.

Tokenizer A (a byte-level BPE file) reads a space and the text, tokenizer B (a piece model) the text, before which it
puts a space itself. Lists of ids are flattened with their parent indices, running sums of token bytes within each
parent give ends, and a hash join of both sides on (document, end) gives the links. Ends that both sides have cut a
document into groups. Id pairs are counted within batches of documents by group_by and added up by Spark.

Documents lie in blocks of 16 MB of text. A block asks once for each distinct pair it has, however many of its links
hold it, and gets the pair's count and whether it is the highest of its B id; so the most frequent pair costs a row a
block. The table of links is written to the shared folder: a texts' ids aren't worked out twice, and a lost executor
costs only its own part.

Defined results: a text that is null or empty, or whose tokens' bytes on either side aren't the space and the text (as
where it holds U+2581 itself), has no tokens: zeros and no groups. Special tokens' strings are plain text. Rows of one
key are documents of their own. Other columns pass unchanged; columns named like the operator's own are replaced.
Memory: both vocabularies, whose files are broadcast, about 1 MB of texts or one longer text with its tokens, and a
block's links.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._memory import tidy, tidy_cogroup
from ._shared import kept
from ._words import chunks, texts_of

BLOCK_BYTES = 16 << 20

_OUT = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(), "links": T.BinaryType(), "_block": T.LongType()}


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows and each row's number of them."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum())), sizes


class Side:
    """A vocabulary: encode() gives the ids of all texts, one behind another, and each text's number of them; per id its
    bytes, their number and the id in decimal."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = pa.array([len(t) for t in tokens], pa.int64())
        self.names = pa.array([str(i) for i in range(len(tokens))], pa.large_string())

    def __len__(self) -> int:
        return len(self.tokens)


class ByteLevel(Side):
    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        byte = byte_characters()
        entries = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        super().__init__([bytes(byte[c] for c in entries[i]) if i in entries else b"" for i in range(max(entries) + 1)])

        self.classes = bpe.code_point_classes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each piece of the vocabulary's pattern is worked out once and remembered; pieces don't depend on each other."""
        spaced = [b" " + t if t else b"" for t in texts]
        data = b"".join(spaced)
        if not data:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        width = 1 + (cp >= 0x80).view(np.uint8) + (cp >= 0x800).view(np.uint8) + (cp >= 0x10000).view(np.uint8)
        place = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        borders = np.concatenate(([0], np.cumsum([len(t) for t in spaced])))
        begins = np.zeros(len(cp), bool)
        heads = np.searchsorted(place, borders[:-1])
        begins[heads[heads < len(cp)]] = True
        starts = place[bpe.split_points(cp, begins, self.classes)]
        pieces = [data[i:j] for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(data)])]
        self._learn([p for p in dict.fromkeys(pieces) if p not in self.known])
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        counts = np.diff(self.first)[at]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[at] - total[:-1], counts)]
        if len(self.known) > bpe.REMEMBER or self.known_bytes > bpe.REMEMBER_BYTES:
            self._forget()
        return ids, np.diff(total[np.searchsorted(starts, borders)])

    def _learn(self, pieces: list[bytes]) -> None:
        if pieces:
            rows = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            self.known.update(zip(pieces, range(len(self.first) - 1, len(self.first) - 1 + len(pieces))))
            self.known_bytes += sum(map(len, pieces))
            flat, sizes = _flat(rows)
            self.ids = np.concatenate((self.ids, flat))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))


class Pieces(Side):
    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)

        def of(i: int) -> bytes:
            piece = self.model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

        super().__init__([of(i) for i in range(self.model.get_piece_size())])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.model.encode([t.decode() for t in texts], num_threads=1))


_loaded: dict[str, Side] = {}


def side(kind: type[Side], data: bytes) -> Side:
    """The tables of a vocabulary file's content; a Python worker builds them once."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = kind(data)
    return _loaded[key]


class Flat:
    """One side's tokens of all texts: ids, their texts' numbers, and where each ends in its text, in bytes."""

    def __init__(self, side: Side, texts: list[bytes]):
        ids, counts = side.encode(texts)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts)))), pa.array(ids))
        self.ids, self.doc = lists.flatten(), pc.list_parent_indices(lists)
        sums = pc.cumulative_sum(side.sizes.take(self.ids)).to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        self.base = np.concatenate(([0], sums))[offsets]
        self.end = pc.subtract(pa.array(sums), pa.array(self.base[:-1]).take(self.doc))
        data = side.tokens.take(self.ids).buffers()[2]
        data = data.to_pybytes() if data else b""
        self.right = [bool(t) and data[a:b] == b" " + t for t, a, b in zip(texts, self.base[:-1].tolist(), self.base[1:].tolist())]

    def table(self, right: pa.Array, shift: pa.Array, name: str) -> pa.Table:
        """(at, name, place) of the texts that are right; at: the document-end key, the end moved by the document's shift."""
        keys = pc.add(self.end, shift.take(self.doc))
        place = pa.array(np.arange(len(self.ids)))
        return pa.table({"at": keys, name: self.ids, f"{name}_at": place}).filter(right.take(self.doc))


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def _grouped(names: pa.Array, keys: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The names of each group's tokens, comma-joined. keys: the tokens' ends, rising; cuts: where groups end."""
    offsets = pa.array(np.concatenate(([0], np.searchsorted(keys, cuts, "right"))))
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, names), _text(","))


def align_texts(texts: list[bytes], a: Side, b: Side) -> tuple[dict[str, np.ndarray], pa.Array, list[np.ndarray]]:
    """Per text the counts, the groups as text, and the pairs of linked ids, a * len(b) + b, in order."""
    flat_a, flat_b = Flat(a, texts), Flat(b, texts)
    right = pa.array([x and y for x, y in zip(flat_a.right, flat_b.right)], pa.bool_())
    n = len(texts)
    # keys of all texts in one rising order: those of text i are moved by all earlier texts' bytes and by i
    shift = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))[:n]
    left_table, right_table = (x.table(right, pa.array(shift, pa.int64()), name) for x, name in ((flat_a, "a"), (flat_b, "b")))
    links = left_table.join(right_table, "at", join_type="inner", use_threads=False).sort_by([("a_at", "ascending"), ("b_at", "ascending")])
    column = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
    at = column(links, "at")
    cuts = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    keys_a, keys_b = column(left_table, "at"), column(right_table, "at")
    names = lambda t, c, side: side.names.take(t[c].combine_chunks())
    both = pc.binary_join_element_wise(
        _grouped(names(left_table, "a", a), keys_a, cuts), _grouped(names(right_table, "b", b), keys_b, cuts), _text("|")
    )
    texts_at = np.append(shift, np.iinfo(np.int64).max)
    cut_of = np.searchsorted(cuts, texts_at)
    groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cut_of), both), _text(";"))
    pairs = column(links, "a").astype(np.int64) * len(b) + column(links, "b")
    link_of = np.searchsorted(at, texts_at)
    count = lambda keys: np.diff(np.searchsorted(keys, texts_at))
    counts = {"n_a": count(keys_a), "n_b": count(keys_b), "n_groups": np.diff(cut_of), "n_links": np.diff(link_of)}
    return counts, groups, [pairs[i:j] for i, j in zip(link_of[:-1], link_of[1:])]


def _width(n_pairs: int) -> str:
    return "<u4" if n_pairs <= 1 << 32 else "<u8"


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, groups, links and _block.

    groups: `a1,a2|b1;a3|b2,b3`, or with digest its SHA-256 in hexadecimal, '' without tokens.
    links: the pairs of linked ids in order, a * (B's size) + b, as little-endian unsigned integers of 4 bytes (8 where
    the vocabularies need it). _block: where with_counts() counts the row.
    """
    names = [c for c in docs.columns if c not in (text, *_OUT)]
    schema = T.StructType([*docs.select(*names).schema.fields, *(T.StructField(k, v) for k, v in _OUT.items())])
    files = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = docs.sparkSession.sparkContext.broadcast(files)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(ByteLevel, sent.value[0]), side(Pieces, sent.value[1])
        width = _width(len(a) * len(b))
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = texts_of(batch.column(text))
            for i, j in chunks(texts, min(1 << 20, block_bytes)):
                part = texts[i:j]
                counts, groups, links = align_texts(part, a, b)
                if digest:
                    groups = [hashlib.sha256(x).hexdigest() if x else "" for x in groups.cast(pa.large_binary()).to_pylist()]
                total = sum(map(len, part))
                if size and size + total > block_bytes:
                    block, size = block + 1, 0
                size += total
                out = [*(pa.array(counts[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(groups, pa.string()) if digest else groups.cast(pa.string())]
                out += [pa.array([x.astype(width).tobytes() for x in links], pa.binary()), pa.array(np.full(j - i, block), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).select(names).columns, *out], [*names, *_OUT])

    return docs.select(*names, text).mapInArrow(run, schema)


def _pairs(column: pa.Array | pa.ChunkedArray, width: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' pairs one behind another, and where each row begins, with the end of the last."""
    rows = [np.frombuffer(x or b"", width) for x in column.to_pylist()]
    return np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)


def pair_counts(rows: DataFrame, width: str) -> DataFrame:
    """(_block, pair, n): how many links of some of a block's rows hold a pair; a block may have several such rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, first = _pairs(batch.column("links"), width)
            block = np.repeat(np.asarray(batch.column("_block")), np.diff(first))
            found = pa.table({"_block": block, "pair": pairs}).group_by(["_block", "pair"], use_threads=False).aggregate([([], "count_all")])
            yield from found.rename_columns(["_block", "pair", "n"] if found.column_names[0] == "_block" else ["n", "_block", "pair"]).select(["_block", "pair", "n"]).combine_chunks().to_batches()

    return rows.select("_block", "links").mapInArrow(run, "_block long, pair long, n long")


def with_counts(rows: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """aligned()'s rows with n_best and count_sum in place of links and _block.

    A pair's count: how many links of all rows hold it. count_sum: the counts of a row's links added up. n_best: links
    whose count is the highest of their B id, ties included.
    """
    width = _width(size_a * size_b)
    rows = kept(rows)
    parts = kept(pair_counts(rows, width))
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % size_b)
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # a row for each id of B at most
    judged = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    replies = parts.select("_block", "pair").join(judged, "pair")
    names = [c for c in rows.columns if c not in ("links", "_block", "n_best", "count_sum")]
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    @tidy_cogroup
    def look_up(table: pa.Table, known: pa.Table) -> pa.Table:
        pairs, first = _pairs(table["links"], width)
        at = pc.index_in(pa.array(pairs), value_set=known["pair"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64) if len(pairs) else np.empty(0, np.int64)
        add = lambda c: np.diff(np.concatenate(([0], np.cumsum(np.asarray(known[c].cast(pa.int64()))[at])))[first])
        return table.select(names).append_column("n_best", pa.array(add("best"), pa.int64())).append_column("count_sum", pa.array(add("n"), pa.int64()))

    return rows.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(look_up, schema)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    import sentencepiece
    import tokenizers

    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size_a = tokenizers.Tokenizer.from_file(path_a).get_vocab_size()
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    out = with_counts(aligned(docs, path_a, path_b, digest=True), size_a, size_b)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
