"""Helpers that the operators of this subpackage share: batches of texts, and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
_POLY = 0x9E3779B97F4A7C15 | 1
_POLY_INV = pow(_POLY, -1, 1 << 64)
#: Bytes of text that one vectorised pass takes; it bounds the memory of a pass, not the length of a text.
PASS_BYTES = 1 << 19
#: Rows of a batch that goes to a Python worker, where the session says nothing: Spark's own 10,000 long texts can be more than a worker holds.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to ``BATCH_ROWS`` for the session, unless it has set a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def null_safe_text(text: str = "text") -> F.Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of the polynomial's base and of its inverse, modulo 2**64."""
    have = cache.get("n", 0)
    if have < n:
        n = max(n, PASS_BYTES + 4096)
        for key, base in (("up", _POLY), ("down", _POLY_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            cache[key] = np.cumprod(p, dtype=np.uint64)
        cache["n"] = n
    return cache["up"], cache["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Which bytes belong to words, and what each byte counts as.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
WORD_BYTES[128:] = True


def _pass(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``data``; ``bounds``: positions where a text begins or ends."""
    n = len(data)
    ns = inside[data]
    start, end = ns.copy(), ns.copy()
    start[1:] &= ~ns[:-1]
    end[:-1] &= ~ns[1:]
    b = bounds[bounds < n]
    start[b] |= ns[b]
    b = bounds[bounds > 0] - 1
    b = b[b < n]
    end[b] |= ns[b]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum((ASCII_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=p[1:])
    return mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64)), s


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive UTF-8 texts, and for each text the index of its first word.

    ``offsets`` has the texts' bounds in ``data`` and begins with 0. Words are maximal runs of bytes that ``inside`` marks, with A-Z lowered. Long input is taken in passes that end between words.
    """
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        to = min(n, at + PASS_BYTES)
        while to < n and inside[data[to - 1]] and inside[data[to]]:
            step = np.flatnonzero(~inside[data[to : to + PASS_BYTES]])
            to = to + int(step[0]) if len(step) else min(n, to + PASS_BYTES)
        lo, hi = np.searchsorted(offsets, [at, to], "left")
        h, s = _pass(data[at:to], offsets[lo : hi + 1] - at, inside)
        hashes.append(h)
        starts.append(s + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets, "left")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the texts' bounds in them; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def release() -> None:
    """Gives back what a worker holds and does not use: it stays for other tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int | str, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of about ``most`` bytes of text, so that a batch's size does not decide the memory that a pass takes; after the last, memory is released."""
    for batch in batches:
        _, off = text_buffers(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()
