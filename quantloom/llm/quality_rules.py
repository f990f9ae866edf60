"""Quality rules as a short-circuit cascade.

Text statistics are computed for every document. The rules behind the verdict are tried in the order of
rejections per second, among what the rules before them leave, as estimated on a sample; a rule only sees what the
earlier ones left. The sample is drawn by hash and measured where it lies: what reaches the driver is how many rows
each set of rules rejects, and what each rule took. The verdict is the conjunction of all rules, so the order changes
the cost and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.text import _BYTE_KEYS, _POWERS, _SPACE, chunks, documents, map_arrow, mix, only, raw, windows, word_hashes

#: Rows, on average, whose costs and rejections set the order of the rules; the verdict does not depend on them.
SAMPLE_ROWS = 2000
#: Times that each rule is timed; the fastest counts.
REPEATS = 3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_BANG = _table(b"!")


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set within each row."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _again(row: np.ndarray, value: np.ndarray, every: bool) -> np.ndarray:
    """Which (row, value) pairs occur before; with every, which occur more than once."""
    order = np.lexsort((np.arange(len(row)), value, row))
    same = np.zeros(len(row) + 1, bool)
    same[1:-1] = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros(len(row), bool)
    out[order] = same[:-1] | same[1:] if every else same[:-1]
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    hashes, first = word_hashes(data, offsets, lower=False)
    n_words = np.diff(first)
    inside = ~_SPACE[data]
    # Lines: cut at each newline and at the rows' ends.
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    row = np.repeat(np.arange(rows), per_row(data == 10, offsets) + 1)
    up, down = _POWERS.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_KEYS[data] * up[:-1], dtype=np.uint64)])
    written = np.concatenate([[0], np.cumsum(inside)])
    wordy = written[ends] > written[starts]
    line_row, line = row[wordy], mix((sums[ends] - sums[starts]) * down[starts])[wordy]
    # Words in windows that occur more than once in their row.
    long = n_words >= WINDOW
    hashed, begin = windows(hashes, first, WINDOW)
    window_row = np.repeat(np.arange(rows), np.diff(begin))
    full = long[window_row]
    window_row, hashed = window_row[full], hashed[full]
    at = np.repeat(first[:-1][long], (n_words - WINDOW + 1)[long]) + np.arange(len(hashed)) - np.repeat(np.concatenate([[0], np.cumsum((n_words - WINDOW + 1)[long])])[:-1], (n_words - WINDOW + 1)[long])
    at = at[_again(window_row, hashed, every=True)]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return {
        "n_words": n_words,
        "word_chars": per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_row(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[_again(line_row, line, every=False)], minlength=rows),
        "n_lines": np.bincount(line_row, minlength=rows),
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])[first]),
    }


@dataclass(frozen=True)
class Rows:
    """The rows that a rule looks at: their bytes, and the statistics that all rules may use for free."""

    data: np.ndarray
    offsets: np.ndarray
    known: dict[str, np.ndarray]

    def of(self, keep: np.ndarray) -> Rows:
        size = np.diff(self.offsets)
        return Rows(self.data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]), {k: v[keep] for k, v in self.known.items()})


def many_symbols(x: Rows) -> np.ndarray:
    return 100 * x.known["n_symbols"] > 30 * x.known["n_words"]


def odd_word_length(x: Rows) -> np.ndarray:
    return (x.known["word_chars"] < 2 * x.known["n_words"]) | (x.known["word_chars"] > 14 * x.known["n_words"])


def duplicate_lines(x: Rows) -> np.ndarray:
    return 100 * x.known["n_dup_lines"] > 50 * x.known["n_lines"]


def shouting(x: Rows) -> np.ndarray:
    return 100 * per_row(_UPPER[x.data], x.offsets) > 50 * per_row(_LETTER[x.data], x.offsets)


def exclaiming(x: Rows) -> np.ndarray:
    return 100 * per_row(_BANG[x.data], x.offsets) > 30 * x.known["n_words"]


def mostly_digits(x: Rows) -> np.ndarray:
    return 100 * per_row(_DIGIT[x.data], x.offsets) > 40 * x.known["word_chars"]


RULES = {f.__name__: f for f in (shouting, exclaiming, mostly_digits, duplicate_lines, odd_word_length, many_symbols)}


def measure(base: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[int, int], list[float]]:
    """On a hashed sample of about so many rows: how many each set of rules rejects (bit i: the i-th rule), and the
    seconds that each rule took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = raw(part.column("text"))
                x = Rows(data, offsets, statistics(data, offsets))
                bits, took = np.zeros(part.num_rows, np.int64), []
                for i, rule in enumerate(RULES.values()):
                    times = []
                    for _ in range(REPEATS):
                        began = time.perf_counter()
                        rejected = rule(x)
                        times.append(time.perf_counter() - began)
                    took.append(min(times))
                    bits |= rejected.astype(np.int64) << i
                value, n = np.unique(bits, return_counts=True)
                seconds = [took] + [[0.0] * len(took)] * (len(value) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64)), *(pa.array(c) for c in zip(*seconds, strict=True))], ["bits", "n", *names])

    names = [f"s{i}" for i in range(len(RULES))]
    share = min(1.0, rows / max(base.count(), 1))
    drawn = base.filter(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1)) < F.lit(int(share * (1 << 53)))) if share < 1 else base
    sums = map_arrow(drawn, run, "bits long, n long, " + ", ".join(f"{c} double" for c in names)).groupBy("bits").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    found = sums.collect()  # a row for each set of rules
    return {r["bits"]: r["n"] for r in found}, [sum(r[c] for r in found) for c in names]


def order_rules(rejected: dict[int, int], seconds: list[float]) -> list[str]:
    """Rule names: each time the one that rejects most per second of the rows that those before it leave."""
    left, order = dict(rejected), []
    todo = list(range(len(RULES)))
    while todo:
        worth = {i: (sum(n for bits, n in left.items() if bits >> i & 1) + 0.5) / max(seconds[i], 1e-9) for i in todo}
        best = max(todo, key=lambda i: (worth[i], -i))
        order.append(list(RULES)[best])
        todo.remove(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """SCHEMA for each row of docs, repeated rows included. Null text: empty, which base_failed rejects for
    its few words; a null doc_id stays null; texts of any length are read in whole; no rows give no rows."""
    base = only(docs)
    order = order or order_rules(*measure(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = raw(part.column("text"))
                known = statistics(data, offsets)
                failed = (known["n_words"] < MIN_WORDS) | (100 * known["n_repeat_words"] > MAX_REPEAT_PERCENT * known["n_words"])
                alive = np.flatnonzero(~failed)
                rest = Rows(data, offsets, known).of(~failed)
                for name in order:
                    if not len(alive):
                        break
                    good = ~RULES[name](rest)
                    if not good.all():
                        alive, rest = alive[good], rest.of(good)
                kept = np.zeros(part.num_rows, bool)
                kept[alive] = True
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(known[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    return map_arrow(base, run, SCHEMA)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
grams AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, i + unnest(range(0, 8)) AS k FROM twice) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_bang, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 30 * n_words AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words
         AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_upper <= 50 * n_letters AND 100 * n_bang <= 30 * n_words
         AND 100 * n_digits <= 40 * word_chars AS kept
FROM b
"""
