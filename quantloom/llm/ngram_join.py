"""N-gram Jaccard join over count vectors.

A document's set is its distinct word shingles. Hashing shingles into groups turns the set into a point of
group counts, and the summed coordinate minima of two points bound the overlap of their sets. Points are
indexed in R-trees whose nodes hold coordinate maxima; a search descends where the bound allows a link, and
what it returns is verified on whole sets.

One tree over all points would have to be copied to every task, and its upper boxes would allow everything: the
maxima of a few unrelated points reach any other point's counts. So points are first dealt to a forest, a tree for
each shard, that loses no link: two sets of the asked similarity share one of their first shingles in any common
order. The order puts shingles that many documents hold last, so a passage of the whole corpus makes no large shard.
Equal sets are one point. Shards emit spanning stars, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quantloom.llm.graph import components, cut
from quantloom.llm.line_dedup import row_key
from quantloom.llm.text import chunks, documents, map_arrow, mix, only, raw, windows, word_hashes

SHINGLE = 5
PERCENT = 80
#: Groups of a small set's point. From twice as many shingles on, a point has as many groups as the greatest power
#: of two up to half its shingles, so that a group holds two to five and the bound stays sharp for long texts, too.
GROUPS = 128
#: Occurrences within one run of a task that report a shingle as frequent, and the most that an order holds.
#: Both only shape the order of shingles; any order gives the same links.
FREQUENT_IN_RUN = 6
FREQUENT_MOST = 200_000
RUN_SHINGLES = 2_000_000
#: Points of one tree, and shingles verified together; a larger shard is dealt to pairs of blocks.
BLOCK = 20_000
BLOCK_SHINGLES = 4_000_000
#: Bits of the filter that says whose sets are needed for verification (2 MB; it only saves shuffling).
FILTER_BITS = 24
#: Entries of a node of a tree, and coordinates by which points are put in order.
FANOUT = 16
PACK = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row and hash, and each row's first (length rows + 1)."""
    hashed, begin = windows(*word_hashes(data, offsets), k)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    return hashed[new], np.searchsorted(row[new], np.arange(len(begin)))


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of points of sets of n shingles: powers of two."""
    return np.maximum(GROUPS, 1 << np.maximum(np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 2, 0))


#: Greatest count that half a byte of a sent point holds; what is above is added up beside it.
NIBBLE = 15


def vectors(hashed: np.ndarray, first: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group counts of each row, cut at 255, and the sum of what was cut (the bound takes it into account)."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    group = (mix(hashed) & np.uint64(groups - 1)).astype(np.int64)
    return cut_counts(np.bincount(row * groups + group, minlength=rows * groups).reshape(rows, groups))


def cut_counts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(count, 255).astype(np.uint8), np.maximum(count.astype(np.int64) - 255, 0).sum(axis=-1)


def packed_points(hashed: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each row's overflow (4 bytes) and its point, in its own number of groups, two to a byte."""
    size = groups_of(np.diff(first))
    begin = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(size)), np.diff(first))
    count = np.bincount(begin[row] + (mix(hashed) & (size[row] - 1).astype(np.uint64)).astype(np.int64), minlength=begin[-1])
    over = np.diff(np.concatenate([[0], np.cumsum(np.maximum(count - NIBBLE, 0))])[begin]).astype("<i4")
    low = np.minimum(count, NIBBLE).astype(np.uint8)
    point = low[0::2] | low[1::2] << 4
    return [o.tobytes() + point[a // 2 : b // 2].tobytes() for o, a, b in zip(over, begin[:-1], begin[1:], strict=True)]


def unpacked_points(packed: list[bytes], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Points folded to the given number of groups, and their overflow; groups are taken by the hash's low bits,
    so folding adds up the parts of a longer point."""
    point, over = np.empty((len(packed), groups), np.uint8), np.empty(len(packed), np.int64)
    for i, x in enumerate(packed):
        pairs = np.frombuffer(x, np.uint8, offset=4)
        body = np.empty(2 * len(pairs), np.uint8)
        body[0::2], body[1::2] = pairs & NIBBLE, pairs >> 4
        point[i], more = (body, 0) if len(body) == groups else cut_counts(body.reshape(-1, groups).sum(axis=0, dtype=np.int64))
        over[i] = int.from_bytes(x[:4], "little") + more
    return point, over


def frequent_shingles(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold, counted over all documents: each run of a task
    reports what it holds often, so whatever is frequent anywhere is reported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= FREQUENT_IN_RUN
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for part in chunks(batch):
                hashed, _ = shingle_sets(*raw(part.column("text")), k)
                held.append(hashed)
                size += len(hashed)
                if size >= RUN_SHINGLES:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    found = map_arrow(only(docs).select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least overlap of a set of n shingles with any set that it links to."""
    return -(-n * percent // 100)


def sketches(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, n, set (64-bit id of the set), prefix and vector of each row."""
    frequent = frequent_shingles(docs, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashed, first = shingle_sets(*raw(part.column("text")), k)
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                sums = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[first])  # noqa: B023,E731
                of = mix(sums(mix(hashed)) + mix(sums(mix(hashed ^ np.uint64(0x5851F42D4C957F2D))) + n.astype(np.uint64)))
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, hashed), len(frequent) - 1)] == hashed
                    hashed_in_order = hashed[np.lexsort((hashed, late, row))]
                else:
                    hashed_in_order = hashed
                size = np.where(n > 0, n - needed(n, percent) + 1, 0)
                at = np.arange(size.sum()) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row_key"),
                        pa.array(n.astype(np.int64)),
                        pa.array(of.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(hashed_in_order[at].view(np.int64))),
                        pa.array(packed_points(hashed, first), pa.binary()),
                    ],
                    ["doc_id", "row_key", "n", "set", "prefix", "vector"],
                )

    base = only(docs).withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    return map_arrow(base, run, "doc_id long, row_key long, n long, set long, prefix array<long>, vector binary")


class Tree:
    """R-tree over boxes of count vectors. A box is its coordinate maxima, its most overflow and its least size;
    minima of the coordinates are not needed, since the bound grows with each coordinate."""

    def __init__(self, point: np.ndarray, over: np.ndarray, size: np.ndarray) -> None:
        self.levels = [(point, over, size)]
        while len(self.levels[-1][2]) > FANOUT:
            self.levels.append(boxes(*self.levels[-1], np.arange(0, len(self.levels[-1][2]), FANOUT)))

    def search(self, point: np.ndarray, over: int, size: int, percent: int, first: int = 0) -> np.ndarray:
        """Entries from the first on whose bound allows a link with anything in the given box."""
        at = np.arange(len(self.levels[-1][2]))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, o, s = self.levels[depth]
            at = at[at >= first // FANOUT**depth]
            at = at[may_link(p[at], o[at], s[at], point, over, size, percent)]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][2])]
        return at


def boxes(point: np.ndarray, over: np.ndarray, size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes of runs that begin at the given places."""
    return np.maximum.reduceat(point, begin), np.maximum.reduceat(over, begin), np.minimum.reduceat(size, begin)


def may_link(point: np.ndarray, over: np.ndarray, size: np.ndarray, other: np.ndarray, other_over, other_size, percent: int) -> np.ndarray:  # noqa: ANN001
    """Whether the summed minima reach the overlap that sets of (at least) these sizes need to link."""
    bound = np.minimum(point, other).sum(axis=-1, dtype=np.int64) + np.minimum(over, other_over)
    return (100 + percent) * bound >= percent * (size + other_size)


class Union:
    """Disjoint sets as an array of labels."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def merge(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)


def leaves(point: np.ndarray, over: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points that puts like ones side by side, and where its leaves begin: runs of at most FANOUT
    points of which each may link to the one before, so that a leaf's box is hardly wider than its points."""
    order = np.lexsort(point[:, min(PACK, point.shape[1]) - 1 :: -1].T)
    p, o, s = point[order], over[order], size[order]
    near = np.empty(len(order), bool)
    near[0] = False
    for a in range(1, len(order), 4096):  # some megabytes at a time
        b = min(a + 4096, len(order))
        near[a:b] = may_link(p[a - 1 : b - 1], o[a - 1 : b - 1], s[a - 1 : b - 1], p[a:b], o[a:b], s[a:b], percent)
    run = np.maximum.accumulate(np.where(near, 0, np.arange(len(order))))
    return order, np.flatnonzero((np.arange(len(order)) - run) % FANOUT == 0)


def bound_components(point: np.ndarray, over: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Labels of the components of the graph of all pairs that the bound allows; rows come by size.

    A tree is packed over leaves of like points. Each leaf's box is searched in it for leaves that come later; of
    those that the boxes allow and that are not connected already, the points decide."""
    n = len(size)
    if n == 2:
        return np.array([0, 0 if may_link(point[:1], over[:1], size[:1], point[1], over[1], size[1], percent)[0] else 1])
    order, begin = leaves(point, over, size, percent)
    point, over, size = point[order], over[order], size[order]
    end = np.append(begin[1:], n)
    box = boxes(point, over, size, begin)
    tree, label = Tree(*box), Union(len(begin))
    for a in range(len(begin) - 1):
        found = tree.search(box[0][a], box[1][a], box[2][a], percent, a + 1)
        found = found[(found > a) & (label.of[found] != label.of[a])]
        if not len(found):
            continue
        many = end[found] - begin[found]
        at = np.arange(many.sum()) + np.repeat(begin[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        leaf = np.repeat(found, many)
        single = end[a] - begin[a] == 1 and (many == 1).all()
        for i in range(begin[a], end[a]) if not single else ():
            hit = leaf[may_link(point[at], over[at], size[at], point[i], over[i], size[i], percent)]
            for other in np.unique(hit):
                label.merge(a, int(other))
            left = label.of[leaf] != label.of[a]
            at, leaf = at[left], leaf[left]
            if not len(at):
                break
        for other in found if single else ():  # boxes of one point are that point
            label.merge(a, int(other))
    # The label of a component is its first row by size.
    of = np.empty(n, np.int64)
    of[order] = np.repeat(label.of, end - begin)
    least = np.full(len(begin), n)
    np.minimum.at(least, of, np.arange(n))
    return least[of]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


class Overlaps:
    """Exact overlaps of one set with many. Shingles that only one set holds cannot overlap; the others are
    numbered, and each set is a row of bits. A matrix that would be too large gives way to searches by pair."""

    def __init__(self, sets: list[np.ndarray], most_bytes: int = 64 << 20) -> None:
        self.sets, self.bits = sets, None
        every = np.sort(np.concatenate(sets))
        again = every[1:] == every[:-1]
        shared = every[1:][again & ~np.append(False, again[:-1])]
        del every
        words = -(-len(shared) // 64)
        if len(sets) * words * 8 <= most_bytes:
            self.bits = np.zeros((len(sets), max(words, 1)), np.uint64)
            for i, x in enumerate(sets if len(shared) else ()):
                at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
                at = at[shared[at] == x]
                np.bitwise_or.at(self.bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        x = self.sets[i]
        return np.array([int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) for y in (self.sets[j] for j in others)])


def verified_components(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Labels of the components of all true links; sets come by size. Pairs inside a component are skipped."""
    n = len(sets)
    if n == 2:
        return np.array([0, 0 if linked(*sets, percent) else 1])
    size = np.array([len(s) for s in sets], np.int64)
    groups = int(groups_of(size[:1])[0])  # of the smallest set
    parts = [vectors(s, np.array([0, len(s)]), groups) for s in sets]
    point, over = np.concatenate([p for p, _ in parts]), np.concatenate([o for _, o in parts])
    union, overlaps = Union(n), Overlaps(sets)
    for i in range(1, n):
        from_ = int(np.searchsorted(size[:i], -(-percent * size[i] // 100)))
        other = np.flatnonzero(union.of[from_:i] != union.of[i]) + from_
        near = other[may_link(point[other], over[other], size[other], point[i], over[i], size[i], percent)]
        if len(near):
            both = overlaps.of(i, near)
            for j in near[(both > 0) & (100 * both >= percent * (size[near] + size[i] - both))]:
                union.merge(int(j), i)
    return union.of


def groups(batches: Iterator[pa.RecordBatch], key: list[str], most: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the groups' bounds; the last group waits for what follows it."""
    held: list[pa.RecordBatch] = []
    size = 0

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in key:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            b = bounds(table)
            if len(b) > 2:
                yield table.slice(0, b[-2]), b[:-1]
                # A copy, so that what was yielded can go.
                held = table.take(pa.array(np.arange(b[-2], table.num_rows))).to_batches()
            size = 0
            del table
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table)


def dealt(df: DataFrame, blocks: Column) -> DataFrame:
    """df with columns i and j: a group of one block stays whole; a larger one is cut into blocks by the hash of
    set, and each row goes to every pair of blocks that has its own, so all pairs of rows meet."""
    own = F.pmod(F.xxhash64("set", F.lit(7)), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    # In a group of several blocks the pair of a block with itself is in each of its other pairs.
    pairs = F.filter(pairs, lambda x: (blocks == 1) | (x["i"] != x["j"]))
    return df.withColumn("pair", F.explode(pairs)).select("*", "pair.i", "pair.j").drop("pair")


def _blocks(count: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / most)).cast("int")


STAR = "a long, b long"


def shard_rows(points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """shard, octave, set, n, members: each set of at least two in a shard of like sizes.

    A pair meets where its first common shingle is. What lies before that in either order is not common, so a set of
    n shingles with it at place i links to none of more than most = (100 + percent) / percent * (n - i) - n. A set
    stays in a shard if the sizes there leave it a partner: one not larger, that is large enough and of which one may
    link to so many, or the next larger one."""
    keyed = points.select("set", F.posexplode("prefix").alias("pos", "key"), "n").select("set", "key", (F.col("n") * F.lit(1 << 32) + F.col("pos")).alias("place"))
    n, pos = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    by_size = Window.partitionBy("key").orderBy("n", "set")
    placed = keyed.select("set", "key", n.alias("n"), F.floor((100 + percent) * (n - pos) / percent).cast("long").alias("most")).withColumn("most", F.col("most") - F.col("n"))
    smaller, larger = F.lag("n").over(by_size), F.lead("n").over(by_size)
    reach = F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    near = placed.select("set", "key", "n", "most", smaller.alias("smaller"), larger.alias("larger"), reach.alias("reach"))
    near = near.filter(((F.col("smaller") * 100 >= F.col("n") * percent) & (F.col("reach") >= F.col("n"))) | ((F.col("larger") * percent <= F.col("n") * 100) & (F.col("larger") <= F.col("most"))))
    shard = Window.partitionBy("key")
    # A shard is known by its members: shards with the same members are searched once.
    sized = near.select(
        "set", "n", F.count(F.lit(1)).over(shard).alias("members"), F.bit_xor(F.xxhash64("set")).over(shard).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).over(shard).alias("y")
    ).filter("members > 1")
    shards = sized.groupBy(F.xxhash64("x", "y", "members").alias("shard"), "set").agg(F.first("n").alias("n"))
    # Only sets of like size can link, and their points are folded to like length: a shard is cut into octaves of
    # the size, and a set goes to its own octave and to that of the smallest set that it could link to.
    octave = lambda c: F.length(F.bin(c)) - 1
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    shards = shards.withColumn("octave", F.explode(F.array_distinct(F.array(octave(F.col("n")), octave(least)))))
    alone = F.count(F.lit(1)).over(Window.partitionBy("shard", "octave"))
    return shards.select("shard", "octave", "set", "n", alone.alias("members")).filter("members > 1")


def search(rows: DataFrame, points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Spanning stars, within each shard of rows, of the pairs that the trees' bound allows."""
    rows = dealt(rows, _blocks(F.col("members"), BLOCK)).select(F.xxhash64("shard", "octave", "i", "j").alias("tree"), "n", "set").join(points.select("set", "vector"), "set")
    rows = rows.repartition("tree").sortWithinPartitions("tree", "n", "set").select("tree", "n", "set", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["tree"], 5_000):
            ids, size = (table.column(c).to_numpy() for c in ("set", "n"))
            packed = table.column("vector").to_pylist()
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s == 1:
                    continue
                point, over = unpacked_points(packed[s:e], int(groups_of(size[s : s + 1])[0]))  # of the smallest set
                of = bound_components(point, over, size[s:e], percent)
                other = of != np.arange(e - s)
                a.append(ids[s:e][of[other]])
                b.append(ids[s:e][other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return map_arrow(rows, run, STAR).distinct()


def candidate_edges(points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Spanning stars that connect every pair that a shard holds and the trees' bound allows.

    Members of a large group meet in shards by the dozen. Each set's largest shard is searched first; of the
    others, only those whose members that search did not connect need their points sent, too."""
    rows = cut(shard_rows(points, percent))
    largest = F.row_number().over(Window.partitionBy("set", "octave").orderBy(F.desc("members"), "shard"))
    first = rows.select("shard", "octave", largest.alias("place")).filter("place = 1").select("shard", "octave").distinct()
    early = cut(search(rows.join(first, ["shard", "octave"]), points, percent))
    known = components(early).withColumnRenamed("node", "set")
    named = rows.join(first, ["shard", "octave"], "left_anti").join(known, "set", "left").withColumn("component", F.coalesce("component", "set"))
    whole = Window.partitionBy("shard", "octave")
    mixed = named.withColumn("low", F.min("component").over(whole)).withColumn("high", F.max("component").over(whole)).filter("low <> high")
    return early.unionByName(search(mixed.select("shard", "octave", "set", "n", "members"), points, percent))


def verified_edges(docs: DataFrame, points: DataFrame, candidates: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Spanning stars of the true links within each component of the candidates."""
    of = candidates.join(points.select(F.col("set").alias("node"), "row_key", "n"), "node").select("row_key", "n", F.col("node").alias("set"), F.col("component").alias("shard"))
    of = cut(of)
    mask = (1 << FILTER_BITS) - 1
    place = F.col("row_key").bitwiseAND(F.lit(mask))
    words = of.groupBy((place / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int"))).alias("bits")).collect()
    wanted = np.zeros((mask + 1) // 32, np.uint32)  # a filter of fixed size
    for r in words:
        wanted[r["w"]] = r["bits"]
    base = only(docs).withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("row_key").to_numpy().view(np.uint64) & np.uint64(mask)
            hit = np.flatnonzero(wanted[(key >> np.uint64(5)).astype(np.int64)] >> (key & np.uint64(31)).astype(np.uint32) & np.uint32(1))
            for part in chunks(batch.take(pa.array(hit))) if len(hit) else ():
                hashed, first = shingle_sets(*raw(part.column("text")), k)
                yield pa.RecordBatch.from_arrays([part.column("row_key"), pa.array([hashed[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["row_key", "shingles"])

    sets = map_arrow(base.select("row_key", "text"), pick, "row_key long, shingles binary").dropDuplicates(["row_key"])
    weight = of.groupBy("shard").agg(F.greatest(_blocks(F.count(F.lit(1)), BLOCK), _blocks(F.sum("n"), BLOCK_SHINGLES)).alias("blocks"))
    rows = dealt(of.join(weight, "shard"), F.col("blocks")).join(sets, "row_key")
    rows = rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "n", "set").select("shard", "i", "j", "set", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, ["shard", "i", "j"], 1_000):
            ids, body = table.column("set").to_numpy(), table.column("shingles")
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s > 1:
                    labels = verified_components([np.frombuffer(x, np.uint64) for x in body.slice(s, e - s).to_pylist()], percent)
                    other = labels != np.arange(e - s)
                    a.append(ids[s:e][labels[other]])
                    b.append(ids[s:e][other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return map_arrow(rows, verify, STAR)


def similar_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id (the smallest doc_id reachable by links) and keeper (whether the
    row stands for its component; rows without shingles stand for themselves) for each row.

    Null and empty texts have no shingles, link with nothing and stand for themselves, as does a text whose
    set no other shares. Repeated rows link with each other through their equal sets; a null doc_id counts
    for links but never as a component's smallest. No rows give no rows."""
    seen = cut(sketches(docs, k, percent))
    points = cut(seen.filter("n > 0").dropDuplicates(["set"]).select("set", "n", "row_key", "prefix", "vector"))
    links = verified_edges(docs, points, components(candidate_edges(points, percent)), k, percent)
    of = components(links).withColumnRenamed("node", "set")
    mine = seen.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "set").join(of, "set", "left").withColumn("component", F.coalesce("component", "set"))
    smallest = mine.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least"))
    out = mine.join(smallest, "component", "left")
    some = F.col("n_shingles") > 0
    return out.select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.when(some, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~some | (F.col("row_key") == F.col("least.row_key"))).alias("keeper"),
    )


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of docs; rows without shingles
    all stay. Of fully repeated rows one stays, too."""
    keepers = similar_groups(docs, k, percent).filter("keeper").select(F.col("row_key").alias("ql_key"), (F.col("n_shingles") > 0).alias("ql_some")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("ql_row"), row_key(docs["doc_id"].cast("long"), text).alias("ql_key")).join(keepers, "ql_key")
    # Rows that differ only in other columns go by the text of those; maps and the like have no order of their own.
    first = F.row_number().over(Window.partitionBy("ql_key").orderBy(F.to_json(F.struct("ql_row"))))
    kept = held.withColumn("ql_nth", first).filter("ql_nth = 1 or not ql_some")
    return kept.select(*[F.col("ql_row").getField(c).alias(c) for c in docs.columns])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
