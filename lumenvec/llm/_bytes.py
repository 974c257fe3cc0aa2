"""Vectorised byte-level text helpers for Arrow batches.

Everything works on the raw UTF-8 buffers of an Arrow string column, a bounded number of bytes
at a time, so no Python string is made per word and memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: The word separators of every contract here: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Texts are worked on in slices of about so many bytes (one longer text makes a slice alone).
SLICE_BYTES = 1 << 19

#: Bytes of a batch of rows that goes to a Python worker, so that its memory doesn't follow the length of texts.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Has Spark cut batches by bytes as well as by rows, in a session where larger ones are allowed."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Gives freed memory back to the system; a worker lives on, so what a stage needed would add to the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; its worker gives memory back before it starts and when it is done."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return out


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for every byte, so that the polynomial below has no weak digits.
DIGIT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            up, down = np.full(m, _BASE), np.full(m, _INVERSE)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if m > 16 * SLICE_BYTES:
                return up, down  # one huge text: not kept
            cls.up, cls.down = up, down
        return cls.up, cls.down


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and by row the offsets into those; space: for every byte, whether it parts words."""
    solid = ~space[data]
    n = len(data)
    first = np.empty(n, bool)
    if n:
        first[0] = True
        np.logical_not(solid[:-1], out=first[1:])
        edges = offsets[offsets < n]
        first[edges] = True
    starts = np.flatnonzero(solid & first)
    last = np.empty(n, bool)
    if n:
        last[-1] = True
        np.logical_not(solid[1:], out=last[:-1])
        edges = offsets[(offsets > 0) & (offsets <= n)] - 1
        last[edges] = True
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random digits, then mixed; the same in every process."""
    up, down = _Powers.get(len(lowered) + 1)
    total = np.zeros(len(lowered) + 1, np.uint64)
    np.cumsum(DIGIT[lowered] * up[: len(lowered)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
