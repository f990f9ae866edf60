"""Line dedup: repeated long lines stay only in the largest document that holds them.

Built from DataFrame functions alone. Line hashes are dealt to hash ranges and sorted there by document
(largest first) and position; the first occurrence in each document streams out and is counted. Lines that
lose a place come back as compressed bitmaps per document, never as text. Hashes are written once and read for
the ranges, for the counts and for the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.text import documents, only
from quantloom.operators.checkpoints import cut

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines marked by one word of a bitmap.
WORD_BITS = 63
#: Ranges over which the documents of one line are dealt.
SALTS = 16
#: Lines that hold a thousandth of all hashed lines, of which there are a thousand at most, meet their verdict by
#: broadcast.
HOT_SHARE = 1000
_STRIP = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_STRIP)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column, seed: str = "") -> Column:
    """Repeated rows share a key and a verdict; one doc_id with two texts has two. Two seeds make 128 bits."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), text, *([F.lit(seed)] if seed else []))


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [row_key(doc_id, text).alias("ql_k1"), row_key(doc_id, text, "second").alias("ql_k2")]


def line_hits(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """ql_k1, ql_k2 (key of a row), drop: sparse bitmap (array of word, bits) of the lines that a document loses.

    A row with no such line is absent. Repeated rows count as one document; a null doc_id counts as the smallest.
    """
    base = only(docs)
    keys = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key"))),
        lambda x: F.char_length(x["key"]) >= min_chars,
    )
    hashed = F.transform(keys, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(x["key"], F.lit("second")).alias("h2"), x["pos"].alias("pos")))
    lines = base.select(*_keys(F.col("doc_id"), F.col("text")), "doc_id", F.explode(hashed).alias("x"))
    every = cut(lines.select("ql_k1", "ql_k2", "doc_id", "x.h1", "x.h2", "x.pos"))
    # A line of a third of all rows is dealt over SALTS ranges; one range holds the rest of it no longer than its sorted run.
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc_id"), "ql_k1", "ql_k2", "pos")
    ranged = every.withColumn("salt", F.pmod("ql_k1", F.lit(SALTS))).repartitionByRange("h1", "h2", "salt")
    me, before = F.struct("ql_k1", "ql_k2"), F.lag(F.struct("ql_k1", "ql_k2")).over(run)
    firsts = ranged.withColumn("before", before).filter(~F.col("before").eqNullSafe(me))
    counted = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    frequent = cut(counted.filter(F.col("n_docs") >= min_docs))
    is_hot = F.col("n_docs") * HOT_SHARE >= F.lit(every.count())
    line = ["h1", "h2"]
    hot = F.broadcast(frequent.filter(is_hot).select(*line, "keeper"))
    cold = frequent.filter(~is_hot).select(*line, "keeper")
    met = every.join(hot, line).unionByName(every.join(hot, line, "left_anti").join(cold, line))
    lost = met.filter(F.col("doc_id").isNull() & F.col("keeper").isNotNull() | (F.col("doc_id") < F.col("keeper")))
    words = lost.groupBy("ql_k1", "ql_k2", (F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("pos"), F.lit(WORD_BITS)))).alias("bits")
    )
    return words.groupBy("ql_k1", "ql_k2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drop"))


def _kept(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """ql_row (the row of docs), ql_lines and kept, the lines that stay."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("ql_row"), text.alias("ql_text"), *_keys(docs["doc_id"].cast("long"), text))
    marked = held.join(line_hits(docs, min_chars, min_docs), ["ql_k1", "ql_k2"], "left").select("ql_row", "ql_text", F.map_from_entries("drop").alias("drop"))
    lines = F.split("ql_text", "\n", -1)
    stays = F.filter(lines, lambda x, i: F.coalesce(F.getbit(F.try_element_at(F.col("drop"), (i / WORD_BITS).cast("int")), F.pmod(i, F.lit(WORD_BITS))), F.lit(0)) == 0)
    return marked.select("ql_row", F.size(lines).cast("long").alias("ql_lines"), F.when(F.col("drop").isNull(), lines).otherwise(stays).alias("kept"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with three more columns: ql_lines (lines before), ql_dropped and ql_kept (the text that stays).

    Null and empty texts are one empty line. Very long lines count in whole; repeated rows get equal results;
    an empty table gives an empty one. Columns of docs are carried along untouched, whatever their names, but for
    columns of the three names, which give way to the new ones."""
    out = _kept(docs, min_chars, min_docs)
    new = {"ql_lines": F.col("ql_lines"), "ql_dropped": F.col("ql_lines") - F.size("kept"), "ql_kept": F.array_join("kept", "\n")}
    return out.select(*[F.col("ql_row").getField(c).alias(c) for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def without_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text as the lines that stay (null texts stay null) and n_chars, if there, counted anew; all columns
    whatever their names."""
    out = _kept(docs, min_chars, min_docs)
    row = lambda c: F.col("ql_row").getField(c)
    text = F.when(row("text").isNotNull(), F.array_join("kept", "\n"))
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, row(c)).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("ql_lines").alias("n_lines"), F.col("ql_dropped").alias("n_dropped"), F.sha2(F.encode("ql_kept", "utf-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, pos, line, f.k IS NOT NULL AND doc_id < keeper AS lost
  FROM keyed LEFT JOIN frequent f ON keyed.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
