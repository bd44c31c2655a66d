"""Helpers shared by the training-data operators: byte columns, words and hashes, beside lineage cuts and code shipping of the library."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.lineage import forget, fresh_path, shared_dir, sweep, written  # noqa: F401
from graphloom.shipping import ship  # noqa: F401

#: Prefix of every helper column, so that columns of the caller never clash with ours.
OWN = "__gl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about most_bytes of text (one longer text is a piece of its own)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if len(col) == 0:
            continue
        ends = np.cumsum(lengths(col))
        start, base = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop
        tidy()


def tidy() -> None:
    """Give memory that was used for a batch back to the system: workers live on, and otherwise keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and where each row's bytes start (one more entry at the end)."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    size = lengths(col)
    starts = np.concatenate([[0], np.cumsum(size)])
    if not len(col) or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), starts
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if len(data) != starts[-1]:  # bytes under nulls
        keep = np.zeros(len(data) + 1, np.int64)
        for i in np.flatnonzero(size):
            keep[offsets[i] - offsets[0]] += 1
            keep[offsets[i] - offsets[0] + size[i]] -= 1
        data = data[np.cumsum(keep[:-1]) > 0]
    return data, starts


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.default_rng(20240229)
_BYTE = _MIX.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, starts: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space (or of those marked in `solid`), never across rows: begin, end (bytes), row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data] if solid is None else solid
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, mixed."""
    if len(begin) == 0:
        return np.zeros(0, np.uint64)
    size = end - begin
    at = np.arange(int(size.sum()), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = at - np.repeat(first, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()) + 1, _STEP, np.uint64))
        value = _BYTE[data[np.repeat(begin, size) + inside]] * power[inside]
        return mix(np.add.reduceat(value, first) + size.astype(np.uint64))
