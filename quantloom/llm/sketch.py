"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A text's paragraphs are its lines, cut further at content-defined words so that an edit stays local. Each
paragraph's digest goes to three cells of a table; a cell holds a count and the sums (exclusive or) of digests
and of their checks. Tables of two versions subtract cell by cell, and peeling cells that hold one digest
recovers the differing paragraphs of either side. A pair that does not peel is tried again at twice the size. A
published table is full (64-bit digests and checks) and so large that it peels alone; it folds to smaller sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.text import documents, map_arrow, mix, only, ranges_for, raw, word_hashes

#: Words of a paragraph, on average: a word whose hash is divisible by this ends one.
PARAGRAPH_WORDS = 8
#: Cells of a published fingerprint at least, and of the first attempt at a difference.
CELLS = 24
HASHES = 3
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit paragraph digests of each text, and each text's first (length texts + 1).

    A paragraph that occurs again is told apart by its rank, so the digests stand for a multiset. A text
    without words has none; white space does not count."""
    data, offsets = raw(pa.array(texts, pa.large_string()))
    words, first = word_hashes(data, offsets, lower=False)
    n = len(words)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    ends = mix(words) % np.uint64(PARAGRAPH_WORDS) == 0
    ends[first[1:][np.diff(first) > 0] - 1] = True
    group = np.concatenate([[0], np.cumsum(ends)[:-1]]) if n else np.zeros(0, int)
    begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if n else np.zeros(0, int)
    place = (np.arange(n) - begin[group]).astype(np.uint64) if n else np.zeros(0, np.uint64)
    body = mix(words + place * np.uint64(0x9E3779B97F4A7C15))
    value = mix(np.add.reduceat(body, begin)) if n else np.zeros(0, np.uint64)
    owner = row[begin] if n else np.zeros(0, int)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    rank = np.arange(len(value)) - np.maximum.accumulate(np.where(new, np.arange(len(value)), 0)) if len(value) else np.zeros(0, int)
    value = np.where(rank > 0, mix(value + rank.astype(np.uint64)), value)
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def _cells(value: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """A digest's cells, one in each third of a table of 3 * size cells."""
    return [(mix(value + np.uint64((j + 1) * 0x632BE59B)) % size.astype(np.uint64)).astype(np.int64) + j * size for j in range(HASHES)]


def _check(value: np.ndarray) -> np.ndarray:
    return mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A))


def tables(value: np.ndarray, owner: np.ndarray, sign: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, key sums and check sums of all owners' tables end to end, and where each begins.

    size: a third of an owner's cells. Digests of either sign meet in the same table, which subtracts them."""
    begin = np.concatenate([[0], np.cumsum(HASHES * size)])
    count, key, check = np.zeros(begin[-1], np.int64), np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], np.uint64)
    for cell in _cells(value, size[owner]):
        at = begin[owner] + cell
        np.add.at(count, at, sign)
        np.bitwise_xor.at(key, at, value)
        np.bitwise_xor.at(check, at, _check(value))
    return count, key, check, begin


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, digest and sign of all that comes out of the tables, and which owners' tables end empty."""
    owner_of = np.repeat(np.arange(len(size)), HASHES * size)
    out = []
    live = np.flatnonzero((np.abs(count) == 1) & (check == _check(key)))
    while len(live):
        # One digest may be alone in several of its cells; it is taken once.
        owner, value, sign = owner_of[live], key[live], count[live]
        order = np.lexsort((value, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (value[order][1:] != value[order][:-1])
        owner, value, sign = (x[order][fresh] for x in (owner, value, sign))
        out.append((owner, value, sign))
        touched = []
        for cell in _cells(value, size[owner]):
            at = begin[owner] + cell
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(key, at, value)
            np.bitwise_xor.at(check, at, _check(value))
            touched.append(at)
        live = np.unique(np.concatenate(touched))
        live = live[(np.abs(count[live]) == 1) & (check[live] == _check(key[live]))]
    left = np.zeros(len(size), bool)
    np.logical_or.at(left, owner_of, (count != 0) | (key != 0))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return parts[0], parts[1], parts[2], ~left


def _select(value: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the given rows end to end, and for each the place of its row among them."""
    n = (first[1:] - first[:-1])[rows]
    at = np.arange(n.sum()) + np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else first[:0], n)
    return value[at], np.repeat(np.arange(len(rows)), n)


class Tables:
    """Tables of rows end to end, each large enough that it peels alone, so a table says all of its row's digests.

    Sizes are doubled from a common one: a larger table folds to any smaller size."""

    def __init__(self, size: np.ndarray, count: np.ndarray, key: np.ndarray, check: np.ndarray, least: int) -> None:
        self.size, self.count, self.key, self.check, self.least = size, count, key, check, least
        self.begin = np.concatenate([[0], np.cumsum(HASHES * size)])
        owner, value, _, done = peel(count.copy(), key.copy(), check.copy(), self.begin, size)
        order = np.lexsort((value, owner))
        self.done, self.value, self.first = done, value[order], np.searchsorted(owner[order], np.arange(len(size) + 1))

    @staticmethod
    def of(value: np.ndarray, first: np.ndarray, cells: int = CELLS) -> Tables:
        """Each row's table, at twice the size as long as it does not peel."""
        least = max(1, cells // HASHES)
        n = np.diff(first)
        size = np.full(len(n), least)
        while (small := HASHES * size * 4 < n * 5).any():
            size[small] *= 2
        while True:
            count, key, check, _ = tables(value, np.repeat(np.arange(len(n)), n), np.ones(len(value), np.int64), size)
            out = Tables(size, count, key, check, least)
            if out.done.all():
                return out
            size = np.where(out.done, size, 2 * size)

    def folded(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows' tables at the given sizes, end to end."""
        at, owner = _select(np.arange(self.begin[-1]), self.begin, rows)
        part, place = np.divmod(at - self.begin[rows][owner], self.size[rows][owner])
        begin = np.concatenate([[0], np.cumsum(HASHES * size)])
        to = begin[owner] + part * size[owner] + place % size[owner]
        count, key, check = np.zeros(begin[-1], np.int64), np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], np.uint64)
        np.add.at(count, to, self.count[at])
        np.bitwise_xor.at(key, to, self.key[at])
        np.bitwise_xor.at(check, to, self.check[at])
        return count, key, check

    def apart(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many digests of left[i] are not in right[i], and of right[i] not in left[i].

        Tables are subtracted at the least size and at doubled ones up to the smaller table's; what does not peel
        until then is compared by what each table peels to alone."""
        only_left, only_right = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        most = np.minimum(self.size[left], self.size[right])
        todo, third = np.arange(len(left)), self.least
        while len(todo):
            size = np.full(len(todo), third)
            (c, k, x), (d, m, y) = self.folded(left[todo], size), self.folded(right[todo], size)
            owner, _, sign, done = peel(c - d, k ^ m, x ^ y, np.arange(len(todo) + 1) * HASHES * third, size)
            only_left[todo[done]] = np.bincount(owner, sign > 0, len(todo))[done]
            only_right[todo[done]] = np.bincount(owner, sign < 0, len(todo))[done]
            todo, third = todo[~done], third * 2
            last, todo = todo[most[todo] < third], todo[most[todo] >= third]
            (a, ao), (b, bo) = _select(self.value, self.first, left[last]), _select(self.value, self.first, right[last])
            value, owner = np.concatenate([a, b]), np.concatenate([ao, bo])
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            both = np.bincount(owner[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])], minlength=len(last)) if len(value) else 0
            only_left[last] = np.bincount(ao, minlength=len(last)) - both
            only_right[last] = np.bincount(bo, minlength=len(last)) - both
        return only_left, only_right

    def written(self) -> list[str]:
        """paragraphs:hex of each table (a cell: count 2 bytes, key 8, check 8)."""
        cell = np.empty(len(self.count), _CELL)
        cell["count"], cell["key"], cell["check"] = self.count & 0xFFFF, self.key, self.check
        body, at = cell.tobytes().hex(), 2 * _CELL.itemsize * self.begin
        return [f"{n}:{body[a:b]}" for n, a, b in zip(np.diff(self.first), at[:-1], at[1:], strict=True)]

    @staticmethod
    def read(prints: list[str], cells: int = CELLS) -> Tables:
        bodies = [bytes.fromhex(p.partition(":")[2]) for p in prints]
        cell = np.frombuffer(b"".join(bodies), _CELL)
        size = np.array([len(b) // _CELL.itemsize // HASHES for b in bodies])
        return Tables(size, cell["count"].astype(np.int64), cell["key"].astype(np.uint64), cell["check"].astype(np.uint64), max(1, cells // HASHES))

    def likeness(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n = np.diff(self.first)
        return likeness(n[left], n[right], *self.apart(left, right))


_CELL = np.dtype([("count", ">u2"), ("key", ">u8"), ("check", ">u8")])


def differing(value: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """How many paragraphs of left[i] are not in right[i], and of right[i] not in left[i], by their tables."""
    return Tables.of(value, first, cells).apart(left, right)


def compared(one: str, other: str, cells: int = CELLS) -> float:
    """Likeness of any two texts, from their published fingerprints."""
    return float(Tables.read([one, other], cells).likeness(np.array([0]), np.array([1]))[0])


def likeness(n_left: np.ndarray, n_right: np.ndarray, only_left: np.ndarray, only_right: np.ndarray) -> np.ndarray:
    """Shared paragraphs by all paragraphs; two texts without any are equal."""
    shared = n_left - only_left
    every = shared + only_left + only_right
    return np.where(every > 0, shared / np.maximum(every, 1), 1.0)


def edit(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def with_next(docs: DataFrame, n: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows in n ranges of descending doc_id, each range with a guest copy of the rows that follow its last.

    Only the ranges' bounds and first ids reach the driver. Nulls come last; equal doc_ids go by text."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ids = docs.select(key.alias("k"))
    # Quantiles of the ids, found by counting: as many numbers as there are ranges.
    cuts = sorted(set(ids.filter(F.col("k") > -(2**63)).approxQuantile("k", [i / n for i in range(1, n)], 0.5 / n)) if n > 1 else [])
    # Descending ranges: the range of a row is the number of cuts above its id.
    part = F.lit(0)
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else None
    if bounds is not None:
        part = F.size(F.filter(bounds, lambda c: c > F.col("k")))
    heads = {r["part"]: r["head"] for r in ids.withColumn("part", part).groupBy("part").agg(F.max("k").alias("head")).collect()}
    order = sorted(heads)
    guests = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # the first range's head follows the last of all
    rows = docs.withColumn("k", key).withColumn("part", part)
    link = spark.createDataFrame([(k, p) for k, p in guests.items()], "head long, guest int") if guests else None
    if link is None:
        return rows.withColumn("own", F.lit(True)), heads
    copies = rows.join(F.broadcast(link), rows["k"] == link["head"]).select("doc_id", "text", "k", F.col("guest").alias("part"), F.lit(False).alias("own"))
    return rows.select("doc_id", "text", "k", "part", F.lit(True).alias("own")).unionByName(copies), heads


def fingerprint(docs: DataFrame, partitions: int | None = None, cells: int = CELLS) -> DataFrame:
    """SCHEMA for each row of docs, compared with the next row in descending (doc_id, text); the last row's
    next is the first. Null texts are empty; a single row is its own next; rows with a null doc_id come last;
    an empty table gives an empty one. Likeness is 1 for equal paragraph multisets, 0 for disjoint ones."""
    base = only(docs)
    n = partitions or ranges_for(base)
    dealt, _ = with_next(base, n)
    sort = [F.asc("part"), F.desc("own"), F.desc("k"), F.desc("text")]
    dealt = dealt.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions(*sort)  # each range is a partition

    def block(rows: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
        """Rows with what follows them; the last one's next is after."""
        texts = [t for _, t in rows]
        following = [*texts[1:], after]
        edited = [edit(t, a) for t, a in zip(texts, following, strict=True)]
        value, first = digests(texts + [after] + edited)
        sketches = Tables.of(value, first, cells)
        k = len(texts)
        own, nxt, new = np.arange(k), np.arange(1, k + 1), np.arange(k + 1, 2 * k + 1)
        prints = sketches.written()
        near = []
        for other in (new, nxt):
            near.append(pa.array(sketches.likeness(own, other)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(prints[:k], pa.string()),
                pa.array(prints[k + 1 :], pa.string()),
                *near,
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        part, size, closed = None, 0, False
        for batch in batches:
            for d, t, p, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "own")), strict=True):
                if p != part:
                    part, closed = p, False
                if own:
                    if size > 500_000 or len(held) >= 128:  # tables are larger than their texts
                        yield block(held, t)
                        held, size = [], 0
                    held.append((d, t))
                    size += len(t)
                elif not closed:  # the first guest follows the range's last row; further ones share its doc_id
                    yield block(held, t)
                    held, size, closed = [], 0, True

    return map_arrow(dealt.select("doc_id", "text", "part", "own"), run, SCHEMA)


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
