"""Quality classifier from weak labels.

Overlapping heuristic labellers, the sparse human labels among them, vote on every document. For each of two
targets (poor writing, toxic wording) expectation-maximisation over the counts of all vote patterns estimates
how often each labeller is right, without believing any of them. The posteriors then label the rows on which a
hashed linear scorer is trained, and the scorer alone decides about every document.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.quality_rules import _LETTER, Rows, duplicate_lines, exclaiming, many_symbols, mostly_digits, per_row, shouting, statistics
from quantloom.llm.text import _BYTE_KEYS, _LOWER, _POWERS, chunks, documents, give_back, map_arrow, mix, only, raw, word_hashes, word_spans
from quantloom.operators.checkpoints import cut

#: Labelled rows, by hash order, from which wordings are learnt and on which the scorers are trained.
TRAIN_ROWS = 12_000
#: Bytes of their texts at most: rows are taken in hash order as long as their texts fit.
TRAIN_BYTES = 64 << 20
#: Documents of the positive class that must hold a wording, and its lift over the other class.
MIN_SUPPORT = 6
MIN_LIFT = 30.0
CUT = 0.5
#: Bound on a labeller's rate of positive votes within the negative class: labellers that vote together (shouts
#: also repeat) would otherwise make up the positive class by themselves.
MAX_FALSE = 0.02
SCHEMA = "doc_id long, p_quality double, p_toxic double, kept boolean"
FEATURE_BITS = 30
#: Features, or buckets, that training handles at once.
PIECE = 1 << 18

_WORDY = _LETTER.copy()
_WORDY[128:] = True


def wordings(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all runs of letters, lower-cased in A-Z."""
    if not len(data):
        return
    inside = _WORDY[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    up, down = _POWERS.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_KEYS[_LOWER[data]] * up[:-1], dtype=np.uint64)])
    yield row, mix((sums[end] - sums[start]) * down[start]) >> np.uint64(64 - FEATURE_BITS)


def shapes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each word's shape: how it begins and ends, whether it is upper case, whether it repeats."""
    start, end = word_spans(data, offsets)
    if not len(start):
        return
    row = np.searchsorted(offsets, start, side="right") - 1
    hashes, _ = word_hashes(data, offsets, lower=False)
    kind = np.zeros(256, np.uint64)
    kind[_LETTER] = 1
    kind[97:123] = 2
    kind[48:58] = 3
    kind[128:] = 4
    for c in b"!#*$%&|<>.,":
        kind[c] = 5 + b"!#*$%&|<>.,".index(c)
    again = np.zeros(len(start), np.uint64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    length = np.minimum(end - start, 20).astype(np.uint64)
    a, z, y = kind[data[start]], kind[data[end - 1]], kind[data[np.maximum(end - 2, start)]]
    shift = np.uint64(64 - FEATURE_BITS)
    for j, code in enumerate((a * 32 + z, z * 32 + y, again, length)):
        yield row, mix(code * np.uint64(8) + np.uint64(j + 1)) >> shift


@dataclass
class Scorer:
    """Logistic model over hashed features; only buckets with a weight are held, sorted."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -10.0
    share: bool = False

    def _some(self) -> np.ndarray:
        seen = np.zeros(1 << 20, bool)
        seen[(self.buckets & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return seen

    def matched(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and weight numbers of the features that have a weight."""
        seen, rows, at = self._some(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, bucket in parts:
            near = seen[(bucket & np.uint64((1 << 20) - 1)).astype(np.int64)]
            row, bucket = row[near], bucket[near]
            i = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
            hit = self.buckets[i] == bucket if len(self.buckets) else np.zeros(len(i), bool)
            rows.append(row[hit])
            at.append(i[hit])
        return np.concatenate(rows), np.concatenate(at)

    def probability(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], n_words: np.ndarray) -> np.ndarray:
        rows, at = self.matched(parts)
        raw_score = np.bincount(rows, self.weights[at], len(n_words)) if len(rows) else np.zeros(len(n_words))
        if self.share:
            raw_score = raw_score / np.maximum(n_words, 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + raw_score, -30, 30)))

    def held(self, features: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, weight numbers and times of the features (a bucket above a row) that have a weight."""
        bits, found = np.uint64(64 - FEATURE_BITS), [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for a in range(0, len(features) if len(self.buckets) else 0, PIECE):
            piece = features[a : a + PIECE]
            at = np.minimum(np.searchsorted(self.buckets, piece >> bits), len(self.buckets) - 1)
            hit = np.flatnonzero(self.buckets[at] == piece >> bits)
            found.append(((piece[hit] & np.uint64((1 << int(bits)) - 1)).astype(np.int32), at[hit].astype(np.int32), times[a + hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def fit(self, features: np.ndarray, times: np.ndarray, target: np.ndarray, n_words: np.ndarray, lift: float, rounds: int = 1500, penalty: float = 1e-4) -> Scorer:
        """Proximal gradient descent with an L1 penalty on the features that pass the support and lift screen.

        features, times: each feature once for each row that has it, its bucket above the row's number. What is made
        of all of them is made a piece at a time."""
        n = len(target)
        row_bits, in_row = np.uint64(64 - FEATURE_BITS), np.uint64((1 << (64 - FEATURE_BITS)) - 1)
        # A bucket's rows are a run of the sorted features.
        pairs = np.sort(features)
        begin = np.flatnonzero(np.append(True, (pairs[1:] ^ pairs[:-1]) >> row_bits)) if len(pairs) else np.zeros(0, np.int64)
        held = pairs[begin] >> row_bits
        pairs &= in_row
        ends = np.append(begin, len(pairs))
        positive = np.zeros(len(begin))
        for a in range(0, len(begin), PIECE):
            own = ends[a : a + PIECE + 1]
            positive[a : a + PIECE] = np.add.reduceat(target[pairs[own[0] : own[-1]].view(np.int64)], begin[a : a + PIECE] - own[0])
        support = np.diff(ends).astype(float)
        del pairs, begin, ends
        total = target.sum()
        ratio = (positive / max(total, 1e-9)) / np.maximum((support - positive + 0.5) / max(n - total, 1e-9), 1e-12)
        good = (positive >= MIN_SUPPORT) & (ratio >= lift) if lift else support >= MIN_SUPPORT
        self.buckets = held[good]
        if not len(self.buckets) or not 0 < total < n:
            self.bias = float(np.log((total + 0.5) / (n - total + 0.5))) if n and lift == 0 else -10.0
            self.buckets, self.weights = self.buckets[:0], np.zeros(0)
            return self
        del held, support, positive, ratio, good
        rows, i, times = self.held(features, times)
        value = 10 * times / np.maximum(n_words, 1)[rows] if self.share else np.minimum(times, 3).astype(float)
        scale = np.bincount(i, value**2, len(self.buckets))
        step = 1 / (0.25 * (scale + np.sqrt(scale.sum() * scale)) / n + 1e-3)
        w, bias = np.zeros(len(self.buckets)), float(np.log(total / (n - total)))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, value * w[i], n), -30, 30)))
            d = p - target
            w = w - step * np.bincount(i, value * d[rows], len(w)) / n
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
            bias -= 0.5 * d.mean()
        used = w != 0
        self.buckets, self.weights, self.bias = self.buckets[used], w[used] * (10 if self.share else 1), bias
        return self


POOR = ("symbols", "shouting", "exclaiming", "digits", "duplicate lines", "repeated passages", "repeated words", "label")
TOXIC = ("a known word", "several known words", "density of known words", "label")


def poor_votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row's vote of each heuristic of POOR: 1 poor, 0 not."""
    known = statistics(data, offsets)
    x = Rows(data, offsets, known)
    hashes, first = word_hashes(data, offsets, lower=False)
    again = np.zeros(len(hashes) + 1, bool)
    again[1:-1] = hashes[1:] == hashes[:-1]
    again[first[:-1]] = False
    n_again = np.diff(np.concatenate([[0], np.cumsum(again[:-1])])[first]) if len(hashes) else np.zeros(len(offsets) - 1)
    return np.stack([many_symbols(x), shouting(x), exclaiming(x), mostly_digits(x), duplicate_lines(x), 100 * known["n_repeat_words"] > 30 * known["n_words"], 100 * n_again > 30 * known["n_words"]], axis=1).astype(np.int8)


def toxic_votes(known: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A row's vote of each heuristic of TOXIC: a known word, several of them, one in a hundred words."""
    return np.stack([known > 0, known > 2, 100 * known > n_words], axis=1).astype(np.int8)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of the positive class for each vote pattern (-1: no vote), each labeller's rate of positive
    votes within the negative and the positive class, and the share of the positive class."""
    voted, yes = votes >= 0, votes == 1
    q = np.where(yes.any(axis=1), 0.9, 0.02)
    weight = counts.astype(float)
    rate, share = np.zeros((2, votes.shape[1])), 0.0
    for _ in range(rounds):
        share = float(np.clip((weight * q).sum() / max(weight.sum(), 1), 1e-4, 1 - 1e-4))
        for c, part in enumerate((weight * (1 - q), weight * q)):
            rate[c] = (part @ yes + (0.01, 0.5)[c]) / (part @ voted + 1)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        rate[0] = np.minimum(rate[0], MAX_FALSE)
        score = np.log(share / (1 - share)) + np.where(voted, np.where(yes, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))), 0).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if len(q) and np.abs(new - q).max() < 1e-9:
            break
        q = new
    return q, rate, share


def _drawn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Up to most labelled texts of up to most_bytes together, by the hash of doc_id; a doc_id with several labels
    counts as toxic or poor if any says so."""
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = only(docs).join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).select("text", "quality", "toxic")


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> pa.Table:
    return _drawn(docs, labels, most, most_bytes).toArrow()  # at most so many rows and bytes


def _counted(parts: list[tuple[np.ndarray, np.ndarray]], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets above their rows (counted from first), and how often each bucket occurs in its row."""
    key, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(f << np.uint64(64 - FEATURE_BITS) | r.astype(np.uint64) for r, f in parts)]), return_counts=True)
    return key + np.uint64(first), times.astype(np.int32)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The parts as one; they are emptied."""
    out = []
    for kind in (np.uint64, np.int32):
        out.append(np.concatenate([np.zeros(0, kind), *(p[0] for p in parts)]))
        parts[:] = [p[1:] for p in parts]
    return tuple(out)


def _in_a_task(rows: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], Scorer]) -> Scorer:
    """What fit makes of all rows, in one task: the driver has neither their texts nor their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(batches))], pa.binary())], ["model"])

    found = map_arrow(rows.coalesce(1), run, "model binary").collect()  # one scorer
    return pickle.loads(found[0]["model"]) if found else fit(iter(()))


@dataclass
class _Rows:
    """Hashed features of one kind of all training rows, made a part at a time, and what labels and heuristics say;
    the texts are not needed beyond them."""

    features: np.ndarray
    times: np.ndarray
    n_words: np.ndarray
    poor_label: np.ndarray
    toxic_label: np.ndarray
    poor_votes: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], kind, votes: bool = False) -> _Rows:  # noqa: ANN001
        at, parts, n_words, poor, toxic, voted = 0, [], [np.zeros(0, np.int64)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros((0, len(POOR) - 1), np.int8)]
        for batch in batches:
            toxic.append(batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False).astype(int))
            poor.append(1 - batch.column("quality").fill_null(2).to_numpy(zero_copy_only=False).astype(int))  # 2: not known, whose vote is -1
            for part in chunks(batch):
                d, o = raw(part.column("text"))
                parts.append(_counted(list(kind(d, o)), at))
                n_words.append(np.diff(word_hashes(d, o)[1]))
                if votes:
                    voted.append(poor_votes(d, o))
                at += part.num_rows
                give_back()
        features, times = _joined(parts)
        give_back()
        return cls(features, times, *map(np.concatenate, (n_words, poor, toxic, voted)))


def _posteriors(own: np.ndarray, of: dict[tuple, float]) -> np.ndarray:
    return np.array([of.get(tuple(v), 0.0) for v in own.tolist()])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[Scorer, Scorer]:
    """Scorers of poor and of toxic texts. Each is fitted in a task over the labelled rows, one after the other."""
    rows = cut(_drawn(docs, labels, most))

    def known_words(batches: Iterator[pa.RecordBatch]) -> Scorer:
        x = _Rows.of(batches, wordings)
        return Scorer().fit(x.features, x.times, (x.toxic_label == 1).astype(float), x.n_words, MIN_LIFT)

    lexicon = _in_a_task(rows, known_words)
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Votes meet labels, both narrow; texts stay where they are.
    voted = map_arrow(only(docs), _voter(lexicon), "doc_id long, votes string")
    patterns = voted.join(one, "doc_id", "left").groupBy("votes", "quality", "toxic").count().collect()  # as many as there are patterns
    n_poor = len(POOR) - 1
    heuristics = np.array([[int(c) for c in r["votes"]] for r in patterns], int).reshape(len(patterns), n_poor + len(TOXIC) - 1)
    poor = np.column_stack([heuristics[:, :n_poor], [-1 if r["quality"] is None else 1 - r["quality"] for r in patterns]]) if patterns else np.zeros((0, len(POOR)), int)
    tox = np.column_stack([heuristics[:, n_poor:], [-1 if r["toxic"] is None else r["toxic"] for r in patterns]]) if patterns else np.zeros((0, len(TOXIC)), int)
    counts = np.array([r["count"] for r in patterns], float)
    of_poor, of_toxic = ({tuple(v): q for v, q in zip(votes.tolist(), expectation_maximisation(votes, counts)[0], strict=True)} for votes in (poor, tox))

    def poor_scorer(batches: Iterator[pa.RecordBatch]) -> Scorer:
        x = _Rows.of(batches, shapes, votes=True)
        return Scorer(share=True).fit(x.features, x.times, _posteriors(np.column_stack([x.poor_votes, x.poor_label]), of_poor), x.n_words, 0.0)

    def toxic_scorer(batches: Iterator[pa.RecordBatch]) -> Scorer:
        x = _Rows.of(batches, wordings)
        known, _, times = lexicon.held(x.features, x.times)
        votes = toxic_votes(np.bincount(known, times, len(x.n_words)), x.n_words)
        return Scorer().fit(x.features, x.times, _posteriors(np.column_stack([votes, x.toxic_label]), of_toxic), x.n_words, MIN_LIFT)

    return _in_a_task(rows, poor_scorer), _in_a_task(rows, toxic_scorer)


def _voter(lexicon: Scorer):  # noqa: ANN202
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                d, o = raw(part.column("text"))
                known = np.bincount(lexicon.matched(wordings(d, o))[0], minlength=part.num_rows)
                votes = np.concatenate([poor_votes(d, o), toxic_votes(known, np.diff(word_hashes(d, o)[1]))], axis=1).astype(np.uint8) + 48
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([v.tobytes().decode() for v in votes], pa.string())], ["doc_id", "votes"])

    return vote


def score_texts(texts: pa.Array, poor: Scorer, toxic: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of good and of toxic wording."""
    d, o = raw(texts)
    n_words = np.diff(word_hashes(d, o)[1])
    return 1 - poor.probability(shapes(d, o), n_words), toxic.probability(wordings(d, o), n_words)


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """SCHEMA for each row of docs, repeated rows included. Null text: empty, which no feature speaks against;
    a null doc_id stays null; without labels nothing is known to be toxic; no rows give no rows."""
    poor, toxic = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                q, t = score_texts(part.column("text"), poor, toxic)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(q), pa.array(t), pa.array((q > CUT) & (t < CUT))], ["doc_id", "p_quality", "p_toxic", "kept"])

    return map_arrow(only(docs), run, SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the scorers keep, with all their columns."""
    poor, toxic = train(docs, labels, most)

    @F.pandas_udf("boolean")
    def good(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        q, t = score_texts(pa.array([x or "" for x in texts], pa.large_string()), poor, toxic)
        return pd.Series((q > CUT) & (t < CUT))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return docs.filter(good(docs["text"].cast("string")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
