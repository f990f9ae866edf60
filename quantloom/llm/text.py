"""Shared ground for the text operators: column selection, Arrow plumbing and vectorised word hashes.

Words are maximal runs of bytes outside space and 0x09-0x0D; those bytes never occur inside a UTF-8
sequence, so the byte view and the code point view find the same words.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240517)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text alone (null text: empty), so other columns can neither clash nor be read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def ranges_for(docs: DataFrame) -> int:
    """Ranges to deal documents to by their order: one for 16 MB of text, from 2,000 ranges on for up to 256 MB. A
    number that depends on the data alone gives the same ranges under all settings."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    return max(1, min(size >> 24, 2000), size >> 28)


def give_back() -> None:
    """Returns freed memory to the machine: workers are reused, and one stage's peak would stay for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def one_thread() -> None:
    """Products of matrices in a Python worker run on the one core that its task has; threads that wait for each
    other cost as much time again."""
    with open("/proc/self/maps") if os.path.exists("/proc/self/maps") else nullcontext(()) as maps:
        found = {line.split()[-1] for line in maps if "openblas" in line}
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from function(batches)
        finally:
            give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its row offsets (length rows + 1, from 0)."""
    array = array.cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; none crosses a row boundary."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word in order, and the index in it of each row's first word (length rows + 1).

    A polynomial over random byte keys is read off prefix sums, so no word is handled on its own."""
    starts, ends = word_spans(data, offsets)
    up, down = _POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[_LOWER[data] if lower else data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window inside a row, and each row's first window (length rows + 1).

    A row with 1 to k - 1 words gives its whole sequence as one window."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    size = np.repeat(np.minimum(n, k), count).astype(np.uint64)
    out = size * _STEPS[63]
    for j in range(k):
        inside = size > j
        out[inside] += hashes[at[inside] + j] * _STEPS[j]
    return mix(out), begin


def chunks(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` text bytes (a longer text makes a slice of its own)."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
