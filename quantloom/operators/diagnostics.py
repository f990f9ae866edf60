"""Data behind the descriptive tables and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.metrics import ic_stats, rank_correlation


def entities_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(F.countDistinct("permno").alias("n_entities"))


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int = 120) -> DataFrame:
    """Known values per bin of equal width; 0 is below low, bins + 1 from high on."""
    b = F.when(F.col(c) < low, 0).when(F.col(c) >= high, bins + 1).otherwise(F.floor((F.col(c) - low) / ((high - low) / bins)) + 1)
    return df.filter(F.col(c).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of unknown values of each column in each year, one row for each."""
    wide = df.groupBy(F.year("date").alias("year")).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot(["year"], columns, "feature", "missing_share")


#: Rank error of the first pass, and the rows up to which that pass only takes the extremes.
SKETCH, FEW = 10_000, 100_000


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v").filter("v is not null")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """feature and q: its quantiles, interpolated between ranks, of each column with a known value.

    A sketch brackets each quantile; a second pass counts what lies below the bracket and sorts only what lies in
    it, a few ten-thousandths of the rows, where an exact percentile would gather every distinct value."""
    long, margin = _long(df, columns), 3.0 / SKETCH
    around = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)]
    near = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", around, SKETCH).alias("near"))
    at = [F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.when(F.col("n") > FEW, F.col("near")[2 * i]).otherwise(F.col("low")).alias("a"), F.when(F.col("n") > FEW, F.col("near")[2 * i + 1]).otherwise(F.col("high")).alias("b")) for i, p in enumerate(probs)]
    each = long.join(F.broadcast(near.select("feature", "n", F.array(*at).alias("at"))), "feature").select("feature", "n", "v", F.explode("at").alias("x")).filter("v <= x.b")
    counted = each.groupBy("feature", "n", F.col("x.i").alias("i"), F.col("x.p").alias("p"), F.when(F.col("v") >= F.col("x.a"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("feature", "i").orderBy(F.col("v").asc_nulls_first()))
    place = F.col("p") * (F.col("n") - 1)
    ranked = counted.select("feature", "i", "v", upto.alias("upto"), place.alias("place"))
    edge = lambda f: F.min(F.when(F.col("upto") > f("place"), F.col("v")))
    one = ranked.groupBy("feature", "i", "place").agg(edge(F.floor).alias("a"), edge(F.ceil).alias("b")).select("feature", "i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("q"))
    return one.groupBy("feature").agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("q"))) for i in range(len(probs))]).alias("q"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each column, one row for each."""
    plain = _long(df, columns).groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = named.join(plain, "feature", "left").join(exact_quantiles(df, columns, [0.25, 0.5, 0.75]), "feature", "left")
    return out.select("feature", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "high")


def feature_ic(df: DataFrame, features: list[str], target: str, least: int = 10) -> DataFrame:
    """Mean and deviation of each feature's monthly rank correlation with the target, and its rank by size."""
    long = df.select("date", target, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["date", target], features, "feature", "value")
    stats = ic_stats(rank_correlation(long, ["feature", "date"], "value", target, least), "feature")
    return stats.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs("mean_ic")), "feature")))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over its complete rows, NULL where one is constant; one pass."""
    cells = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))).alias("r")))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.a", "c.b", "c.r")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:  # noqa: ANN001
    """The first k rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:  # noqa: ANN001
    """The first n rows of all in a total order; each task sorts out its own first n."""
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same in every run, partitioning and engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.orderBy(F.md5(F.encode(text, "utf-8")), *keys).limit(n)
