"""Memory that a Python worker gives back at the end of a task, so that idle workers stay small."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # a C library that has no such call keeps its memory
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]):
    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return wrapped


def tidy_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]):
    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return wrapped
