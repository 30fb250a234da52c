"""Vectorised word and shingle hashing over Arrow text columns, and small Spark helpers.

Texts are hashed in slices of about one megabyte, so the memory of a task does not depend on the
size of an Arrow batch; one document longer than that makes a slice of its own. A null text counts
as an empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import scratch, shared_dir, written

__all__ = ["scratch", "shared_dir", "written"]

SLICE_BYTES = 1 << 20
#: ASCII white space, bytes 9 to 13 and 32.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits; bytes of longer UTF-8 characters belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, m in enumerate((_M, _M_INV)):
            steps = np.full(size, m, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets_buffer, data_buffer = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, bounds: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words end at the ends of rows."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(spaces[data], out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words that starts at one of the first len(words) - n + 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    return out


def word_rows(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the index of its first word, and the number of words at the end."""
    return np.searchsorted(starts, bounds, "left")


def distinct_shingles(data: np.ndarray, bounds: np.ndarray, n: int, spaces: np.ndarray = SPACES, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct ``n``-word shingles of lower-cased rows, ordered by both.

    With ``short`` a row of fewer words, but one at least, has its whole sequence as one shingle.
    """
    starts, ends = word_spans(data, bounds, spaces)
    words = span_hashes(data, starts, ends, True)
    first = word_rows(starts, bounds)
    count = np.diff(first)
    hashes = windows(words, n)
    row = np.repeat(np.arange(len(count)), count)
    whole = row[: len(hashes)] == row[n - 1 :][: len(hashes)] if len(hashes) else np.zeros(0, bool)
    rows, hashes = row[: len(hashes)][whole], hashes[whole]
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            extra = np.zeros(len(few), np.uint64)
            for k in range(1, n):  # a row of k words is one run of them
                own = count[few] == k
                if own.any():
                    extra[own] = sequences(words, k)[first[few[own]]]
            rows, hashes = np.concatenate([rows, few]), np.concatenate([hashes, extra])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return rows, hashes


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words taken as a whole short text, from each of the first len(words) - n + 1."""
    out = np.full(max(len(words) - n + 1, 0), n + 0x1234567, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + len(out)])
    return out


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def release_memory() -> None:
    """Gives back what Arrow's pool and the allocator hold beyond what is in use; a worker lives on after its task beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
