"""run() against the contracts once more, one after the other; the fitted parts (classifier, judge of spans) are the
operators' own, whose verdicts on each text are taken as they are."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quantloom.llm import pii, quality_classifier
from tests.llm import brute
from tests.llm.test_operators import ROWS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ql_row int, ql_kept int, ql_key int, ql_lines int, extra map<string,int>"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    junk = [(100 + i, f"BUY NOW!!! $$$ ### CLICK {i} !!! " * 12) for i in range(12)]
    good = [(200 + i, " ".join(f"plain{(i * 31 + j * 7) % 97} words" for j in range(40)) + f". mail me at user{i}@example.com") for i in range(30)]
    rows = [(d, t, None, "s", None if t is None else len(t), 1, 2, 3, 4, {"k": 1}) for d, t in [*ROWS, *junk, *good]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(d, 0, 0) for d, _ in junk] + [(d, 1, 0) for d, _ in good] + [(None, 1, 1), (1, None, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{root}/labels.parquet")
    return str(root)


def expected(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality_classifier.accepted(docs, labels).select("doc_id", "text").collect()
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in kept} >= set(range(100, 112))
    rows = [(r["doc_id"], r["text"]) for r in kept]
    rows = [(d, None if t is None else x[2]) for (d, t), x in zip(rows, brute.deduplicated(rows), strict=True)]
    of, seen, left = brute.groups(rows), set(), []
    for (d, t), c in sorted(zip(rows, of, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")):
        if not brute.shingles(t):
            left.append((d, t))
        elif (d, c) not in seen and (d == c or c is None):
            seen.add((d, c))
            left.append((d, t))
    judge = pii.model()
    return [(d, t if t is None else pii.redacted(t, pii.find_all([t], judge)[0][1])) for d, t in left]


def test_run_is_the_stages_one_after_the_other(spark, folder):
    want = defaultdict(list)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in expected(spark, folder):
        want[d].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    got = corpus_pipeline.run(spark, folder).collect()
    tokens = Counter()
    for r in got:
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
        like = [x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in like}, r
    asked = Counter()
    for d, many in want.items():
        for x in many:
            asked[d, len(x)] += len(x)
    assert tokens == asked
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "personal_data", "sequences"]


def test_stages_keep_the_columns_and_leave_no_personal_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        wrong = out.filter(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text")))
        assert wrong.count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.filter(F.col("text").contains("@example.com")).count() == 0 and docs.filter("map_contains_key(extra, 'k')").count() == docs.count() > 0


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
