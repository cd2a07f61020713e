"""Exchange of packed hashes between blocks of documents.

Documents are dealt at random into blocks of a few MB. A block sends each of its distinct keys once, however
many of its documents hold it, to the bucket that owns the key's range; the bucket answers every block with the
keys that concern it. A key that a third of all documents share thus costs one entry a block, never one a document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import tidy_group

BLOCK_BYTES = 4 << 20
#: Keys are cut to so many bits; a chance meeting only sends a key to the exact check that follows.
KEY_BITS = 48


def in_blocks(df: DataFrame, text: str, spread: Iterable[str], block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """df with a column _block, dealt by a hash of the columns `spread`, and the number of blocks."""
    total = df.agg(F.sum(F.octet_length(text)).alias("bytes")).first()["bytes"] or 0
    n = max(1, math.ceil(total / block_bytes))
    return df.withColumn("_block", F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int")), n


def pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) * 8 // KEY_BITS, 8), np.uint8)
    wide[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    return wide.reshape(-1).view("<u8")


def cut(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64((1 << KEY_BITS) - 1)


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def by_bucket(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted keys of so many bits."""
    top = keys >> np.uint64(bits - 32)
    return np.searchsorted((top * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def shared_keys(blocks: DataFrame, n_blocks: int, keys_of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(_block, keys): for each block those of its keys, packed, that another block has too.

    keys_of gives a block's keys, cut to KEY_BITS.
    """
    buckets = max(1, n_blocks // 4)

    @tidy_group
    def send(table: pa.Table) -> pa.Table:
        keys = np.unique(keys_of(table))
        borders = by_bucket(keys, KEY_BITS, buckets)
        full = np.flatnonzero(np.diff(borders))
        block = table["_block"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "_block": pa.array([block] * len(full), pa.int32()),
                "keys": pa.array([pack(keys[borders[i] : borders[i + 1]]) for i in full], pa.binary()),
            }
        )

    @tidy_group
    def answer(table: pa.Table) -> pa.Table:
        sets = [unpack(x) for x in table["keys"].to_pylist()]
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        shared = found[counts > 1]
        return pa.table({"_block": table["_block"].combine_chunks(), "keys": pa.array([pack(x[member(x, shared)]) for x in sets], pa.binary())})

    sent = blocks.groupBy("_block").applyInArrow(send, "bucket int, _block int, keys binary")
    return sent.groupBy("bucket").applyInArrow(answer, "_block int, keys binary").where(F.octet_length("keys") > 0)


def joined(table: pa.Table, column: str = "keys") -> np.ndarray:
    """The packed keys of all rows as one sorted array."""
    rows = [unpack(x) for x in table[column].to_pylist()]
    return np.unique(np.concatenate(rows)) if rows else np.empty(0, np.uint64)
