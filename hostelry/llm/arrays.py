"""NumPy helpers shared by the operators that work on whole texts inside tasks."""

from __future__ import annotations

import ctypes
import functools
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import SparkSession

#: Bytes handled at a time; bounds the working arrays whatever a text's length.
SLICE = 1 << 20
#: Bytes of words hashed at a time, which take about thirty times as much.
HASHED = 1 << 18
#: Bytes of an Arrow batch. Texts of ten thousand rows, Spark's batch, are of any size.
BATCH = 5 << 20
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its n+1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of every word ``[^\\x20\\x09-\\x0D]+``, in order."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    The bytes are taken a slice at a time; a word longer than a slice widens it.
    """
    values = mixed(np.arange(1, 257))
    if lower:
        values = values[LOWER]
    out = np.empty(len(start), np.uint64)
    at, up, down = 0, powers(BASE, HASHED), powers(UNBASE, HASHED)
    while at < len(start):
        first = start[at]
        to = max(at + 1, int(np.searchsorted(end, first + HASHED, "right")))
        size = int(end[to - 1] - first)
        if size > len(up):
            up, down = powers(BASE, size), powers(UNBASE, size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[first : first + size]] * up[:size], out=total[1:])
        s, e = start[at:to] - first, end[at:to] - first
        out[at:to] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(UNBASE))
        at = to
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, of up to 64 bits, byte plane by byte plane, compressed; the first byte tells the planes."""
    numbers = np.asarray(numbers).astype("<u8")
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    """What ``packed`` took: uint32 where all numbers fit, else uint64."""
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    kind = "<u4" if width <= 4 else "<u8"
    out = np.zeros((planes.shape[1], 4 if width <= 4 else 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).ravel()


def gathered(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[p]:offsets[p + 1]]`` of all picks end to end, and their lengths."""
    lengths = offsets[picks + 1] - offsets[picks]
    ends = np.cumsum(lengths)
    index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - offsets[picks], lengths)
    return values[index], lengths


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def in_slices(batch: pa.RecordBatch, column: str, most: int = SLICE // 2):
    """The batch in runs of rows whose texts come to about ``most`` bytes; a longer text stands alone."""
    pa.default_memory_pool().release_unused()
    sizes = np.asarray(pa.compute.binary_length(batch[column]).fill_null(0), np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    # What is freed goes back, so that a worker does not keep the most that it ever held.
    pa.default_memory_pool().release_unused()


def in_batches(session: SparkSession) -> None:
    """Hold the Arrow batches of ``session`` to ``BATCH`` bytes, unless it has a bound of its own.

    A batch stands several times in memory: as it grows in the JVM, as it is sent, and in Python.
    """
    if session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def released() -> None:
    """Give the system what is free: of Arrow's pool, and what the C library keeps of arrays and strings."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def freed(run):
    """``run`` over a task's batches, after which the worker gives the memory of the last ones back before it waits for the next task."""

    @functools.wraps(run)
    def each(batches):
        yield from run(batches)
        released()

    return each


def per_process(key, make):
    """What ``make`` builds, once for each Python worker; workers are used again by later tasks."""
    held = sys.__dict__.setdefault("_hostelry_held", {})
    if key not in held:
        held[key] = make()
    return held[key]
