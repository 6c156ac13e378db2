"""Whole Arrow columns of text as byte and word arrays.

Words are found and hashed for a batch at once: a word is a maximal run of word bytes inside one row, its hash a
polynomial over its bytes taken as the difference of two prefix sums. Rows of any length work; the largest temporary
array is a few times the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20
"""Bytes of text in one Arrow batch handed to Python."""


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, so that long texts don't add up to batches of gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType) -> DataFrame:
    """Apply a function of one Arrow batch; it may return no rows at all."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                if made is not None:
                    yield from made.to_batches() if isinstance(made, pa.Table) else [made]

    return df.mapInArrow(run, schema)


def view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True at the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Word ``i`` has the bytes ``starts[i]:ends[i]``; row ``r`` has the words ``rows[r]:rows[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def words(column: pa.Array, word_bytes: np.ndarray = SPACED) -> Words:
    """The words of all rows of a column."""
    return words_in(*view(column), word_bytes)


def words_in(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACED) -> Words:
    """The words of consecutive rows of bytes."""
    inside = word_bytes[data]
    other = np.zeros(len(data), bool)
    other[1:] = inside[:-1]
    begins = offsets[:-1]
    other[begins[begins < len(data)]] = False
    starts = np.flatnonzero(inside & ~other)
    other[:] = False
    other[:-1] = inside[1:]
    ends = offsets[1:]
    other[ends[ends > 0] - 1] = False
    stops = np.flatnonzero(inside & ~other) + 1
    return Words(data, starts, stops, np.searchsorted(starts, offsets))


@cache
def _multipliers(seed: int) -> tuple[np.ndarray, int, int]:
    draw = np.random.default_rng(seed)
    table = draw.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
    factor = int(draw.integers(0, 1 << 63, dtype=np.uint64)) * 8 + 5 & (1 << 64) - 1
    return table, factor, pow(factor, -1, 1 << 64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(seed: int, inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        _, factor, back = _multipliers(seed)
        have = np.full(max(n, 1 << 16), back if inverse else factor, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 20:
            _POWERS[seed, inverse] = have
    return have[:n]


@cache
def _folded(seed: int, lower: bool) -> np.ndarray:
    table = _multipliers(seed)[0].copy()
    if lower:
        table[65:91] = table[97:123]
    return table


def word_hashes(found: Words, seed: int = 1, lower: bool = False, span: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A-Z count as a-z."""
    table = _folded(seed, lower)
    out = np.empty(len(found.starts), np.uint64)
    i = 0
    while i < len(out):
        low = found.starts[i]
        j = max(i + 1, int(np.searchsorted(found.ends, low + span, "right")))
        size = int(found.ends[j - 1] - low)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(table[found.data[low : low + size]] * _powers(seed, False, size), out=sums[1:])
        first, last = found.starts[i:j] - low, found.ends[i:j] - low
        out[i:j] = splitmix((sums[last] - sums[first]) * _powers(seed, True, size)[first] + (last - first).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of ``size`` consecutive values; as many fewer as a run is longer than one."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, factor, _ = _multipliers(seed + 1000)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(factor)
        out += hashes[k : k + n]
    return splitmix(out)


def row_of(rows: np.ndarray) -> np.ndarray:
    """The row of each word, from the offsets of rows."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def whole_windows(found: Words, size: int) -> np.ndarray:
    """True at each word that begins a run of ``size`` words of its own row, for the first ``n - size + 1`` words."""
    n = max(0, len(found.starts) - size + 1)
    left = np.repeat(found.rows[1:], found.counts)[:n] - np.arange(n)
    return left >= size
