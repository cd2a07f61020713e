"""Words and word hashes of many texts at once, on numpy arrays over the raw UTF-8 bytes.

A text is never turned into Python word objects: the bytes of a block of texts lie in one array,
word borders come from a table of separator bytes, and word hashes from steps of eight bytes over all words at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space and \t \n \v \f \r.
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Every ASCII byte that is neither a digit nor a lower-case letter; used after A-Z are lower-cased.
NOT_ALNUM = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Keys of the word hash, one for each eight bytes of a word and one for its length.
_KEYS = np.random.Generator(np.random.PCG64(0x5EED)).integers(1, 1 << 64, 9, np.uint64)
#: Words of more bytes are hashed by BLAKE2.
_LANES = 8
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that any of their bits can be used."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order; it isn't linear, so that no pattern of words cancels out."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: eight bytes after eight bytes are scrambled under keys; BLAKE2 for long spans."""
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _KEYS[-1])
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # at each place the eight bytes from it on
    short = size <= 8 * _LANES
    left = np.flatnonzero(short & (size > 0))
    for lane in range(_LANES):
        if not len(left):
            break
        rest = size[left] - 8 * lane
        out[left] = mix(out[left] ^ _KEYS[lane] ^ (eights[starts[left] + 8 * lane] & _LOW_BYTES[np.minimum(rest, 8)]))
        left = left[rest > 8]
    for i in np.flatnonzero(~short).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=_KEYS.tobytes()[:64]).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


class Words:
    """The words of a block of texts.

    buffer: bytes of all texts, one separator byte between them; starts, ends: byte places of the words;
    first: index of each text's first word, with the number of words at the end; hashes: one a word.
    """

    def __init__(self, texts: list[bytes], separators: bytes = WHITESPACE, lower: bool = False):
        joiner = separators[:1]
        data = joiner.join(texts) + joiner
        if lower:
            data = data.translate(LOWER)
        self.data = data
        self.buffer = np.frombuffer(data, np.uint8)
        lut = np.ones(256, bool)
        lut[list(separators)] = False
        inside = np.concatenate(([False], lut[self.buffer]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        borders = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.starts, borders)
        self.hashes = hash_spans(data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on, whether or not they leave the text; see whole()."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        power, span, out, at = self.hashes, 1, None, 0  # power: of spans of 1, 2, 4... words; out: of the first `at` words
        while True:
            if k & span:
                out = power[:n] if out is None else chain(out, power[at : at + n])
                at += span
            if at == k:
                return mix(out + np.uint64(k))
            power = chain(power[:-span], power[span:])
            span *= 2

    def whole(self, k: int) -> np.ndarray:
        """Places whose k words lie in one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        room = np.repeat(self.first[1:], self.counts())[:n]
        return np.flatnonzero(np.arange(n) + k <= room)

    def short(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of 1 to k - 1 words, and a hash of each one's whole word sequence."""
        counts = self.counts()
        texts = np.flatnonzero((counts > 0) & (counts < k))
        out = np.zeros(len(texts), np.uint64)
        for j in range(k - 1):
            has = counts[texts] > j
            out[has] = chain(out[has], self.hashes[self.first[texts[has]] + j])
        return texts, mix(out ^ np.uint64(0xD6E8FEB86659FD93))


def longest_first(words: Words, k: int) -> np.ndarray:
    """The hashes of shingles() with their words' bytes in the top four bits, most bytes lowest.

    Long words are rare words, so by these hashes shingles that few texts share by chance come first.
    """
    hashes = words.shingles(k)
    total = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    size = total[k:][: len(hashes)] - total[: len(hashes)]
    return (hashes >> np.uint64(4)) | ((15 - np.clip((size - 12) // 2, 0, 15)).astype(np.uint64) << np.uint64(60))


def shingle_sets(words: Words, k: int, hashed=Words.shingles) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct k-word shingles as (first, hashes): text i has hashes[first[i]:first[i + 1]], sorted.

    A text of fewer words has its whole sequence as one shingle; a text without words has none. hashed: what hashes
    the shingles, in the order of their places.
    """
    counts = words.counts()
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(sizes)))
    hashes = np.empty(first[-1], np.uint64)
    few, whole = words.short(k)
    long = np.repeat(counts >= k, sizes)
    hashes[long] = hashed(words, k)[words.whole(k)]
    hashes[first[few]] = whole
    for a, b in zip(first[:-1], first[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[first[:-1][sizes > 0]] = True
    return np.concatenate(([0], np.cumsum(new)))[first], hashes[new]


class Texts:
    """A text column's values as UTF-8 bytes, nulls as empty texts; only what is asked for is copied out of the column."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        self.lengths = pc.fill_null(pc.binary_length(self.column), 0).to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, _ = at.indices(len(self))
            return [x or b"" for x in self.column.slice(start, stop - start).to_pylist()]
        return self.column[int(at)].as_py() or b""


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    return Texts(column)


def chunks(texts: Texts | list[bytes], size: int = 1 << 20):
    """(from, to) ranges of texts of about `size` bytes; a longer text is a range of its own."""
    lengths = texts.lengths.tolist() if isinstance(texts, Texts) else list(map(len, texts))
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
