"""Packing along a space-filling curve.

Each document's words are hashed to a vector of length 1, projected to a few dimensions and placed on a Hilbert curve.
Documents are range-sorted by that key, so texts with similar words become neighbours, and each range is cut
along the curve into sequences of at most 1024 tokens. What is left at the end of a range goes into sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.text import chunks, documents, map_arrow, mix, only, ranges_for, raw, word_hashes

VOCABULARY = "byte_bpe_50k"
SEPARATOR = 0
LENGTH = 1024
#: Cells of a document's hashed vector; dimensions of the curve and bits of each, whose product stays below 63.
CELLS = 256
DIMENSIONS = 4
BITS = 15
#: Sequences of one range; a range's index stands above these bits of sequence_id.
RANGE_BITS = 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path without suffix of a vocabulary that lies beside its ranks (.json and .tiktoken)."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.json")).removesuffix(".json")


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):  # noqa: ANN202
    """The byte-level vocabulary of path.json over its ranks, several times faster than from the JSON file. Both hold the
    same merges in the same order behind the same pattern, so the ids are the same; tests compare them with the JSON
    library's over a whole table. A special token's string in a text is that token, as in that library."""
    import json

    import tiktoken

    with open(f"{path}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(f"{path}.json", encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_ids(texts: list[str], path: str, pattern: str) -> list[np.ndarray]:
    """Each text's ids and the separator, as unsigned 32-bit numbers."""
    e = _encoder(path, pattern)
    end = np.array([SEPARATOR], np.uint32)
    return [np.concatenate([np.array(e.encode(t, allowed_special="all"), np.uint32), end]) for t in texts]


def _directions(dimensions: int) -> np.ndarray:
    """Fixed random directions through the cells, a column for each dimension."""
    return np.random.Generator(np.random.PCG64(20240517)).standard_normal((CELLS, dimensions))


def projected(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Projections of each row's hashed vector; 0 without words.

    A vector holds the words of each cell less their mean and is scaled to length 1, so that texts of any length lie
    equally far out and what they say, not how much, gives their place."""
    hashes, first = word_hashes(data, offsets)
    rows = len(first) - 1
    cell = np.repeat(np.arange(rows), np.diff(first)) * CELLS + (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    vector = np.bincount(cell, minlength=rows * CELLS).reshape(rows, CELLS).astype(float)
    vector -= vector.mean(axis=1, keepdims=True)
    length = np.sqrt((vector * vector).sum(axis=1, keepdims=True))
    return (vector / np.maximum(length, 1e-12)) @ _directions(dimensions)


def quantised(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each coordinate through the logistic curve to whole numbers of the given bits."""
    return np.minimum((1 / (1 + np.exp(-np.clip(points, -30, 30))) * 2**bits).astype(np.int64), 2**bits - 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of cells along the Hilbert curve through the cube of 2**bits cells a side.

    The transposed index is built by undoing excess work and Gray encoding, then its bits are interleaved."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, curve (the Hilbert key of each row) and order, a hash of the text that settles ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                key = hilbert_key(quantised(projected(*raw(part.column("text")))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(key, pa.int64())], ["doc_id", "text", "curve"])

    return map_arrow(only(docs), run, "doc_id long, text string, curve long").withColumn("order", F.xxhash64("text"))


def tail_lengths(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Cuts a stream of documents' ids into sequences."""

    def __init__(self, first: int, length: int) -> None:
        self.sequence, self.length = first, length
        self.held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append((doc_id, 0, ids, len(ids)))
        self.size += len(ids)
        while self.size >= self.length:
            self.cut(self.length)

    def cut(self, length: int) -> None:
        """One sequence from the first length held ids."""
        offset = taken = 0
        while offset < length:
            doc_id, start, ids, total = self.held[taken]
            piece = ids[: length - offset]
            self.rows.append((doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(piece)
            if len(piece) < len(ids):
                self.held[taken] = (doc_id, start + len(piece), ids[len(piece) :], total)
            else:
                taken += 1
        del self.held[:taken]
        self.size -= length
        self.sequence += 1

    def finish(self) -> None:
        for n in tail_lengths(self.size):
            self.cut(n)


def pack(docs: DataFrame, path: str | None = None, pattern: str | None = None, length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """SCHEMA, one row for each piece. Every row of docs, repeated ones too, is packed whole, as its ids and the
    separator; null and empty texts are the separator alone; a null doc_id stays null; an empty table gives no
    rows; a text longer than a sequence is cut. Equal keys go by doc_id and text, so a lost task repeats itself.
    The number of ranges follows from the texts alone, and only numbers, no texts, are sampled for their bounds."""
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    keys = ["curve", "doc_id", "order"]
    dealt = curve_keys(docs).repartitionByRange(partitions or ranges_for(only(docs)), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << RANGE_BITS, length)
        kinds = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for part in chunks(batch):
                for d, ids in zip(part.column("doc_id").to_pylist(), token_ids(part.column("text").to_pylist(), path, pattern), strict=True):
                    packer.add(d, ids)
                if packer.rows:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return map_arrow(dealt.sortWithinPartitions(*keys, "text").select("doc_id", "text"), run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
