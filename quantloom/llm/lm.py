"""Language-model scoring: an add-one unigram score and a gated recurrent model's, for whole texts.

Word counts come from all training documents. The most frequent words, a set of bounded size, go to every
task; what a document holds beyond them meets its count in a shuffle, so the vocabulary may be of any size.
The recurrent model reads and predicts the most frequent words on their own and all others by the bucket of their
hash; both grow with the root of the number of distinct words. It is trained by truncated backpropagation on all training documents: each task trains on its
own part from a common start, and the tasks' weights are averaged in the proportion of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.graph import cut
from quantloom.llm.gru import END, TAIL, Gru, Trainer
from quantloom.llm.text import chunks, documents, map_arrow, only, raw, word_hashes

#: Most words whose counts go to every task (8 MB), the least words of the output layer, and the size of the state.
FREQUENT_MOST = 500_000
VOCABULARY = 1024
HIDDEN = 16
#: Words of the output layer, and buckets at most, for each root of the distinct words; tail words of a bucket at least.
PER_ROOT = 4
BUCKET_WORDS = 32
#: Bins of an octave by which the least count of a frequent word is found.
BINS = 8
#: Words that one run of a task counts, or scores, at once.
RUN_WORDS = 4_000_000
SCORE_WORDS = 2_000_000
#: Numbers of a model that are sent and added up together, and the tasks that add, each its pieces of all models.
PIECE = 8192
SLOTS = 16
END_KEY = 0x7F4A7C15F39CC060
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def with_fold(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out: the crc32 of doc_id as text leaves 2 modulo 7; a null doc_id counts as empty text."""
    return only(docs).withColumn("held_out", F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")), F.lit(7)) == 2)


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash) and c, with the end of each text as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def report() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(value.view(np.int64), END_KEY)), pa.array(np.append(count, texts).astype(np.int64))], ["word", "c"])

        for batch in batches:
            for part in chunks(batch):
                held.append(word_hashes(*raw(part.column("text")))[0])
                size += len(held[-1])
                texts += part.num_rows
                if size >= RUN_WORDS:
                    yield report()
                    held, size, texts = [], 0, 0
        if texts:
            yield report()

    return map_arrow(training.select("text"), run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Known:
    """Sorted hashes of the frequent words with their counts and their ids in the output vocabulary."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, vocabulary: int) -> None:
        order = np.argsort(words.view(np.uint64))
        self.words, self.counts = words.view(np.uint64)[order], counts[order]
        self.ids = np.full(len(words), TAIL, np.int32)
        # The most frequent words, by count and hash, make the vocabulary; the end of a text is no word of it.
        real = np.flatnonzero(self.words != np.uint64(END_KEY))
        top = real[np.lexsort((self.words[real], -self.counts[real]))[:vocabulary]]
        self.ids[top] = np.arange(2, len(top) + 2)
        self.top_counts, self.top_words = self.counts[top], self.words[top]
        self.buckets = 1
        # Most words share few first bits: a table of bit patterns narrows each search.
        self.first = np.searchsorted(self.words >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))

    def deal(self, buckets: int) -> None:
        """From now on the words outside the vocabulary have ids by bucket, after the vocabulary's; a power of two."""
        self.buckets = buckets
        tail = (self.ids < 2) | (self.ids >= 2 + len(self.top_counts))
        self.ids[tail] = self.tail_ids(self.words[tail])

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.buckets - 1)).astype(np.int64)

    def tail_ids(self, hashes: np.ndarray) -> np.ndarray:
        return 2 + len(self.top_counts) + self.bucket(hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each hash, and whether it is there."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        head = (hashes >> np.uint64(44)).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        out, left = at.copy(), np.flatnonzero(at < end)
        hit = np.zeros(len(hashes), bool)
        while len(left):
            same = self.words[at[left]] == hashes[left]
            hit[left[same]] = True
            out[left] = at[left]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return np.minimum(out, len(self.words) - 1), hit


def frequent_words(counts: DataFrame, vocabulary: int = VOCABULARY, most: int = FREQUENT_MOST) -> Known:
    """The words from the least count on that leaves at most that many of them."""
    bin_ = F.floor(F.log2("c") * BINS).cast("int")
    above, cut_at = 0, None
    for r in counts.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect():  # at most 64 * BINS rows
        if above + r["n"] > most:
            break
        above, cut_at = above + r["n"], r["bin"]
    if cut_at is None:
        return Known(np.zeros(0, np.int64), np.zeros(0, np.int64), vocabulary)
    held = counts.filter(bin_ >= cut_at).select("word", "c").toArrow()
    return Known(held.column("word").to_numpy(), held.column("c").to_numpy(), vocabulary)


def sizes(distinct: int, vocabulary: int | None) -> int:
    """Words of the output layer for so many distinct ones, unless given."""
    return max(VOCABULARY, PER_ROOT * math.isqrt(distinct)) if vocabulary is None else vocabulary


def tail_totals(counts: DataFrame, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and distinct words of each bucket, without the vocabulary and the ends."""
    n, v = np.zeros(known.buckets, np.int64), np.zeros(known.buckets, np.int64)
    bucket = F.col("word").bitwiseAND(F.lit(known.buckets - 1).cast("long")).alias("bucket")
    for r in counts.filter(F.col("word") != END_KEY).groupBy(bucket).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row for each bucket
        n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
    np.subtract.at(n, known.bucket(known.top_words), known.top_counts)
    np.subtract.at(v, known.bucket(known.top_words), 1)
    return n, v


def _ids(part: pa.RecordBatch, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, their place in known, whether they are there, their vocabulary ids, each row's first word."""
    hashes, first = word_hashes(*raw(part.column("text")))
    at, hit = known.find(hashes)
    ids = known.tail_ids(hashes)
    if len(known.words):
        ids = np.where(hit, known.ids[at], ids)
    return hashes, at, hit, ids, first


def train(training: DataFrame, known: Known, start: Gru) -> Gru:
    """Average of the models that the tasks train from start, each by its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(Gru({k: v.copy() for k, v in start.p.items()}))
        for batch in batches:
            for part in chunks(batch):
                *_, ids, first = _ids(part, known)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    trainer.add(np.append(ids[a:b], END))
        trainer.flush()
        if trainer.words:
            flat = trainer.model.flat().astype(np.float64) * trainer.words
            parts = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), trainer.words)), pa.array(parts, pa.binary())], ["piece", "words", "sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = {}, {}
        for batch in batches:
            for i, n, x in zip(*(batch.column(c).to_pylist() for c in ("piece", "words", "sum")), strict=True):
                words[i] = words.get(i, 0) + n
                total[i] = total.get(i, 0.0) + np.frombuffer(x)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(list(words.values())), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "words", "sum"])

    schema = "piece long, words long, sum binary"
    sums = map_arrow(map_arrow(training.select("text"), run, schema).repartition(SLOTS, "piece"), add, schema)
    parts = sorted((r["piece"], r["words"], bytes(r["sum"])) for r in sums.toLocalIterator())  # one model in all
    return start.filled(np.concatenate([np.frombuffer(x) / n for _, n, x in parts])) if parts else start


def score(docs: DataFrame, vocabulary: int | None = None, hidden: int = HIDDEN, frequent: int = FREQUENT_MOST) -> DataFrame:
    """SCHEMA for each row of docs, repeated rows included.

    Null text: empty, which is one token, the end. A null doc_id is in the training fold. Without training
    documents every token is unknown. Both scores are of whole texts, in log10; the second is the recurrent
    model's, in which a word outside its vocabulary costs its bucket's probability times the word's add-one share
    of the bucket. Repeated rows share a score: a row is known by two hashes of what it holds, so that a lost task
    deals nothing anew. No rows give no rows."""
    folded = with_fold(docs)
    training = folded.filter(~F.col("held_out"))
    counts = cut(word_counts(training))
    end = F.coalesce(F.sum(F.when(F.col("word") == END_KEY, F.col("c"))), F.lit(0))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), end.alias("ends")).first()
    n_all, v_all, ends = int(total["n"]), int(total["v"]), int(total["ends"])
    known = frequent_words(counts, sizes(v_all, vocabulary), frequent)
    v_tail = v_all - (1 if ends else 0) - len(known.top_counts)
    known.deal(1 << (max(1, min(sizes(v_all, None), v_tail // BUCKET_WORDS)).bit_length() - 1))
    n_bucket, v_bucket = tail_totals(counts, known)
    start = Gru.fresh(np.concatenate([[max(ends, 1), 0], known.top_counts, n_bucket + 1]).astype(float), hidden)
    model = train(training, known, start)
    base_cost, tail_costs = np.log10(n_all + v_all + 1), np.log10(n_bucket + v_bucket + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def report() -> Iterator[pa.RecordBatch]:
            texts, rows = [], []
            lost: list[tuple[np.ndarray, ...]] = []
            for part, (hashes, at, hit, ids, first) in held:
                logs = np.where(hit, np.log10(known.counts[at] + 1.0), 0.0) if len(known.words) else np.zeros(len(hashes))
                end = np.log10(ends + 1.0)
                sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[first])
                bucket = ids - 2 - len(known.top_counts)
                shares = np.where(bucket >= 0, logs - tail_costs[np.maximum(bucket, 0)], 0.0)
                tail_sums = np.diff(np.concatenate([[0.0], np.cumsum(shares)])[first])
                n = np.diff(first)
                n_known = np.diff(np.concatenate([[0], np.cumsum(hit)])[first]) + (ends > 0)
                base = sums + end - (n + 1) * base_cost
                rows.append((part, n + 1, n_known, base, tail_sums))
                texts += [np.append(ids[a:b], END) for a, b in zip(first[:-1], first[1:], strict=True)]
                missing = np.flatnonzero(~hit)
                row = np.searchsorted(first, missing, side="right") - 1
                pair = np.lexsort((hashes[missing], row))
                r, w = row[pair], hashes[missing][pair]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
                keys = [part.column(c).to_numpy()[r[new]] for c in ("k1", "k2")]
                lost.append((*keys, w[new], np.diff(np.append(np.flatnonzero(new), len(r)))))
            model_scores = model.score(texts) / np.log(10)
            at = 0
            for part, n, n_known, base, tail in rows:
                k = part.num_rows
                doc = pa.StructArray.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(n.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(model_scores[at : at + k] + tail)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "model"],
                )
                at += k
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("k1"), pa.array(np.zeros(k, np.int64)), doc], names)
            for k1, k2, w, times in lost:
                for a in range(0, len(w), 100_000):
                    b = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(k1[b]), pa.array(k2[b]), pa.array(w[b].view(np.int64)), pa.array(times[b].astype(np.int64)), pa.nulls(len(w[b]), doc_type)], names)

        for batch in batches:
            for part in chunks(batch):
                held.append((part, _ids(part, known)))
                size += len(held[-1][1][0])
                if size >= SCORE_WORDS:
                    yield from report()
                    held, size = [], 0
        if held:
            yield from report()

    doc_type = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])
    # One row for each text, and one for each of its words that no task knows; the latter meet their counts.
    names = ["k1", "k2", "word", "times", "doc"]
    what = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.col("text")]
    rows = map_arrow(
        folded.withColumns({"k1": F.xxhash64(*what), "k2": F.xxhash64(*what, F.lit("second"))}),
        run,
        "k1 long, k2 long, word long, times long, doc struct<doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double>",
    )
    lone = F.col("doc").isNull()
    sums = rows.join(counts, "word", "left").groupBy("k1", "k2").agg(
        F.max("doc").alias("doc"),
        F.count("doc").alias("rows"),
        F.sum(F.when(lone, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).otherwise(0.0)).alias("more"),
        F.sum(F.when(lone & F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
    )
    met = sums.select("doc", (F.col("more") / F.col("rows")).alias("more"), F.expr("found div rows").alias("found"), F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return met.select(
        "doc.doc_id",
        "doc.held_out",
        "doc.n_tokens",
        (F.col("doc.n_known") + F.col("found")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("doc.base") + F.col("more")).alias("base_score"),
        (F.col("doc.model") + F.col("more")).alias("score"),
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
