"""Byte-level BPE as a tree reduction.

A text is cut into leaves, each leaf is split and encoded alone, and neighbours are joined pairwise up the
tree: only a window around the seam is done again, and it grows until what lies outside is proved stable.

*Pieces* (matches of the split pattern): the pattern has no lookbehind, so a scan depends on its position
alone; once the window's pieces end where a piece of the right side starts, all later ones are the right
side's. A piece looks at most LOOK characters past its end, so pieces that far from a window's end hold.

*Tokens* inside a long piece: a token sequence is the BPE encoding of its bytes exactly if each adjacent pair
is the encoding of its own bytes. Both sides are valid encodings, so a join is proved by two pairs at the
window's edges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.text import documents, map_arrow, only

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 4096
LEAF_BYTES = 48
LOOK = 3
#: Pieces remembered by a worker; a full memory is emptied.
CACHE = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Codec:
    """Encoder and decoder for one ranks file and split pattern."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(2, leaf_bytes)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # Tokens of one piece.

    def merged(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, until no neighbours merge."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        best = [ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while best:
            low = min(best)
            if low == 1 << 60:
                break
            i = best.index(low)
            parts[i] += parts.pop(i + 1)
            best.pop(i)
            if i:
                best[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(best):
                best[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[x] for x in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        w = 1
        if self.apart(left[-1], right[0]):
            return left + right
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            middle = self.merged(b"".join(map(self.tokens.__getitem__, left[a:] + right[:b])))
            if (not a or self.apart(left[a - 1], middle[0])) and (b == len(right) or self.apart(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            w *= 2

    def bytes_encoded(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        nodes = [self.merged(data[i : i + self.leaf_bytes]) for i in range(0, len(data), self.leaf_bytes)]
        while len(nodes) > 1:
            nodes = [self.join_tokens(nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def piece(self, text: str) -> tuple[int, ...]:
        known = self.pieces.get(text)
        if known is None:
            data = text.encode()
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None else tuple(self.bytes_encoded(data))
            if len(text) <= 64:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[text] = known
        return known

    # Pieces of one text.

    def leaf(self, text: str) -> tuple[list[str], list[tuple[int, ...]]]:
        pieces, get, make = self.split(text), self.pieces.get, self.piece
        return pieces, [get(p) or make(p) for p in pieces]

    def join(self, left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list]:
        (lp, lt), (rp, rt) = left, right
        if not lp or not rp:
            return (lp or rp), (lt or rt)
        w = 2
        while True:
            a, b = max(0, len(lp) - w), min(len(rp), w)
            from_left = sum(map(len, lp[a:]))
            held = from_left + sum(map(len, rp[:b]))
            if a and from_left < LOOK:
                w *= 2
                continue
            pieces = self.split("".join(lp[a:]) + "".join(rp[:b]))
            if b == len(rp):
                new, rest = pieces, len(rp)
            else:
                seams, at = {}, from_left
                for j in range(b + 1):
                    seams[at] = j
                    at += len(rp[j]) if j < b else 0
                new, rest, at = None, 0, 0
                for i, p in enumerate(pieces):
                    at += len(p)
                    if at + LOOK > held:
                        break
                    if at in seams:
                        new, rest = pieces[: i + 1], seams[at]
                        break
            if new is not None:
                get, make = self.pieces.get, self.piece
                return lp[:a] + new + rp[rest:], lt[:a] + [get(p) or make(p) for p in new] + rt[rest:]
            w *= 2

    def tree(self, text: str) -> tuple[list, list]:
        nodes = [self.leaf(text[i : i + self.leaf_chars]) for i in range(0, len(text), self.leaf_chars)]
        while len(nodes) > 1:
            nodes = [self.join(nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else ([], [])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.tree(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree: leaves of ids, then the leaves' bytes."""
        get = self.tokens.__getitem__
        return b"".join(b"".join(map(get, ids[i : i + 4096])) for i in range(0, len(ids), 4096))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) for each row; null and empty texts give no ids, repeated rows repeat."""
    path, pattern = path or vocabulary_path(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(only(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, data (binary) for each row of doc_id, ids; null ids give no bytes."""
    path, pattern = path or vocabulary_path(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes, decodes what was encoded, and keeps only counts and digests of both."""
    path, pattern = path or vocabulary_path(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = c.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(only(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
