"""Forests by MLlib, boosted trees in numpy, permutation importance and the choice of a small feature set."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quantloom.operators.checkpoints import cut

TREES = 300
#: Fits that run side by side; a boosted one is a single task.
PARALLEL = 4
#: Rows of a block of permutation importance.
BLOCK = 20_000
#: Cuts of a feature are at most so many less one, as in MLlib.
BINS = 32
LEAST_LEAF = 1000
DEPTHS_FOREST, DEPTHS_BOOSTED, RATES = (2, 3, 4), (1, 2), (0.01,)
#: Characteristics that a small feature set may be chosen from.
ALLOWED = ("mom12m", "mom1m", "chmom", "indmom", "bm", "ep", "cfp", "roaq", "gp", "roe", "agr", "invest", "noa", "me", "ill", "idiovol", "beta", "retvol")


def forest(depth: int = 2, trees: int = TREES, least_leaf: int = LEAST_LEAF, seed: int = 42, target: str = "ret_exc") -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="ql_x", labelCol=target, predictionCol="pred_ret", numTrees=trees, maxDepth=depth, minInstancesPerNode=least_leaf, featureSubsetStrategy="0.3333", seed=seed)


#: A tree: feature and cut (-1, 0 where there is none) of the root and its children, and the values of four leaves.
Tree = tuple[list[int], list[int], list[float]]


@dataclass
class Boosted:
    """Boosted regression trees of depth 1 or 2, as MLlib's: squared error, the first tree whole, the others by the
    rate on twice what is left, each on a sample of the rows, leaves of least_leaf sampled rows.

    A tree needs the one before, so as jobs they take a few rounds of the scheduler each, whatever the rows. Here a
    fit is one task, which holds all training rows: about a byte for each row and feature and 40 for each row, and
    while they come 4 for each feature."""

    depth: int = 2
    rate: float = 0.01
    trees: int = TREES
    least_leaf: int = LEAST_LEAF
    share: float = 0.5
    seed: int = 42
    target: str = "ret_exc"

    def __post_init__(self) -> None:
        if self.depth not in (1, 2):
            raise ValueError(f"boosted trees have a depth of 1 or 2, not {self.depth}")

    def getMaxIter(self) -> int:  # noqa: N802
        return self.trees

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.depth

    def getMinInstancesPerNode(self) -> int:  # noqa: N802
        return self.least_leaf

    def fit(self, rows: DataFrame) -> BoostedModel:
        out = pa.schema({"cuts": pa.list_(pa.list_(pa.float64())), "feature": pa.list_(pa.int32()), "cut": pa.list_(pa.int32()), "value": pa.list_(pa.float64())})

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            xs, ys = [], []
            for b in batches:
                if b.num_rows:
                    xs.append(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                    ys.append(b.column(1).to_numpy(zero_copy_only=False))
            if xs:
                y = np.concatenate(ys)
                cuts, grown = self.grow(_joined_columns(xs), y)
                yield pa.RecordBatch.from_pylist([{"cuts": [c.tolist() for c in cuts] if k == 0 else None, "feature": f, "cut": c, "value": v} for k, (f, c, v) in enumerate(grown)], out)

        narrow = rows.select(vector_to_array("ql_x", "float32").alias("x"), F.col(self.target).cast("double").alias("y"))
        found = narrow.repartition(1).mapInArrow(one, "cuts array<array<double>>, feature array<int>, cut array<int>, value array<double>").collect()  # one row for each tree
        return BoostedModel([np.array(c, np.float32) for c in next((r["cuts"] for r in found if r["cuts"]), [])], [(r["feature"], r["cut"], r["value"]) for r in found])

    def grow(self, columns: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], list[Tree]]:
        """Cuts of each feature, and the trees. columns are emptied."""
        cuts, x = [], np.empty((len(columns), len(y)), np.uint8)
        for j in range(len(columns)):
            cuts.append(_cuts(columns[j]))
            x[j] = np.searchsorted(cuts[j], columns[j])
            columns[j] = None
        order = np.lexsort((y, *x))  # so that the sample does not depend on how rows came
        x, y = x[:, order], y[order]
        del order
        rng, left, grown = np.random.default_rng(self.seed), y.copy(), []
        for k in range(self.trees):
            drawn = np.flatnonzero(rng.random(len(y), np.float32) < self.share)
            tree = self._tree(x[:, drawn], left[drawn] * (2 if k else 1))
            value = np.array(tree[2]) * (self.rate if k else 1.0)
            left -= value[_leaves(x, tree)]
            grown.append((tree[0], tree[1], value.tolist()))
        return cuts, grown

    def _tree(self, x: np.ndarray, r: np.ndarray) -> Tree:
        feature, cut = [-1] * 3, [0] * 3
        value = [float(r.mean()) if len(r) else 0.0] * 4
        node = np.zeros(len(r), np.int64)
        for level in range(self.depth):
            nodes = 1 << level
            n, s = np.zeros((nodes, len(x), BINS)), np.zeros((nodes, len(x), BINS))
            for j in range(len(x)):
                at = x[j] if level == 0 else node + x[j]
                n[:, j] = np.bincount(at, minlength=nodes * BINS).reshape(nodes, BINS)
                s[:, j] = np.bincount(at, r, minlength=nodes * BINS).reshape(nodes, BINS)
            for i in range(nodes):
                if level and feature[0] < 0:
                    break
                best = self._best(n[i], s[i])
                if best:
                    feature[level + i], cut[level + i], low, high = best
                    if level == 0:
                        value = [low, low, high, high]
                    else:
                        value[2 * i : 2 * i + 2] = [low, high]
            if feature[0] < 0:
                break
            if level == 0:
                node = (x[feature[0]] > cut[0]).astype(np.int64) * BINS
        return feature, cut, value

    def _best(self, n: np.ndarray, s: np.ndarray) -> tuple[int, int, float, float] | None:
        """Feature, cut and means of both sides of the split that takes most squared error, the first among equals."""
        low_n, low_s = n.cumsum(axis=1)[:, :-1], s.cumsum(axis=1)[:, :-1]
        all_n, all_s = n.sum(axis=1, keepdims=True), s.sum(axis=1, keepdims=True)
        high_n, high_s = all_n - low_n, all_s - low_s
        fits = (low_n >= max(self.least_leaf, 1)) & (high_n >= max(self.least_leaf, 1))
        gain = np.where(fits, low_s**2 / np.maximum(low_n, 1) + high_s**2 / np.maximum(high_n, 1) - all_s**2 / np.maximum(all_n, 1), 0.0)
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return (int(j), int(b), float(low_s[j, b] / low_n[j, b]), float(high_s[j, b] / high_n[j, b])) if gain[j, b] > 0 else None


def _joined_columns(parts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate([p[:, j] for p in parts]) for j in range(parts[0].shape[1])]


def _cuts(column: np.ndarray) -> np.ndarray:
    """At most BINS - 1 values, after which the rows are cut into bins of like numbers of them."""
    known, n = np.unique(column, return_counts=True)
    if len(known) <= BINS:
        return known[:-1]
    upto = np.cumsum(n)
    return known[np.unique(np.minimum(np.searchsorted(upto, len(column) / BINS * np.arange(1, BINS)), len(known) - 2))]


def _leaves(x: np.ndarray, tree: Tree) -> np.ndarray:
    """Leaf of each row (columns of x hold its bins)."""
    feature, cut, _ = tree
    side = x[feature[0]] > cut[0] if feature[0] >= 0 else np.zeros(x.shape[1], bool)
    leaf = side.astype(np.int8) * 2
    for i in (0, 1):
        if feature[1 + i] >= 0:
            leaf += (side == bool(i)) & (x[feature[1 + i]] > cut[1 + i])
    return leaf


@dataclass
class BoostedModel:
    """Cuts of each feature, and trees over bins whose values hold the rate."""

    cuts: list[np.ndarray]
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)]) if self.cuts else np.zeros((0, len(x)))
        out = np.zeros(len(x))
        for tree in self.trees:
            out += np.array(tree[2])[_leaves(bins, tree)]
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def pred(x: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.stack(x.to_numpy()).astype(np.float32)) if len(x) else np.zeros(0))

        return rows.withColumn("pred_ret", pred(vector_to_array("ql_x", "float32")))


def boosted(depth: int = 2, rate: float = 0.01, trees: int = TREES, least_leaf: int = LEAST_LEAF, seed: int = 42, target: str = "ret_exc") -> Boosted:
    return Boosted(depth, rate, trees, least_leaf, seed=seed, target=target)


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """df with ql_x; unknown features are 0, the middle of a ranked one."""
    return VectorAssembler(inputCols=features, outputCol="ql_x").transform(df.fillna(0.0, subset=features))


def r2(scored: DataFrame, bench: float, target: str = "ret_exc") -> float:
    r = F.col(target)
    row = scored.agg(F.sum((r - F.col("pred_ret")) ** 2).alias("a"), F.sum((r - bench) ** 2).alias("b")).first()
    return 1 - row["a"] / row["b"] if row["b"] else float("nan")


def select(panel: DataFrame, features: list[str], make, grid: list[dict], hold_out_from: int, test_from: int, target: str = "ret_exc") -> tuple[dict, list[tuple[dict, float]]]:  # noqa: ANN001
    """The parameters with the best hold-out R2, the first among equals, and all scores."""
    year, rows = F.year("date"), vectors(panel.dropna(subset=[target]), features)
    train, hold = rows.filter(year < hold_out_from), rows.filter((year >= hold_out_from) & (year < test_from))
    bench = train.agg(F.avg(target)).first()[0]
    with ThreadPool(PARALLEL) as pool:
        scores = pool.map(lambda p: (p, r2(make(**p).fit(train).transform(hold), bench, target)), grid)
    return max(scores, key=lambda s: s[1])[0], scores


def expanding(panel: DataFrame, features: list[str], name: str, make, test_from: int, test_to: int, target: str = "ret_exc") -> DataFrame:  # noqa: ANN001
    """Predictions of a model that is fitted anew for each test year on all years before."""
    rows, years = vectors(panel.dropna(subset=[target]), features), range(test_from, test_to + 1)
    with ThreadPool(PARALLEL) as pool:
        models = pool.map(lambda y: make().fit(rows.filter(F.year("date") < y)), years)
    parts = [m.transform(rows.filter(F.year("date") == y)).select("permno", "date", F.lit(name).alias("model"), "pred_ret", target) for y, m in zip(years, models, strict=True)]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Parts:
    """A fitted model as a mean or sum of parts that read a few features each, in numpy: trees, or terms of a line.

    Trees only ask whether a value is over a cut, so a feature is kept as the number of the model's cuts below it."""

    cuts: list[np.ndarray] | None
    parts: list
    over: float = 1.0
    constant: float = 0.0

    @staticmethod
    def of(model) -> Parts:  # noqa: ANN001
        if isinstance(model, LinearRegressionModel):
            return Parts(None, list(enumerate(model.coefficients.toArray().tolist())), constant=model.intercept)
        if not isinstance(model, RandomForestRegressionModel):
            raise TypeError(f"no parts are known of a {type(model).__name__}")
        grown = [_nodes(t._java_obj.rootNode()) for t in model.trees]
        cuts = [np.unique([c for t in grown for f, c in _splits(t) if f == j]) for j in range(model.numFeatures)]
        return Parts(cuts, [_placed(t, cuts) for t in grown], float(len(grown)))

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(float) if self.cuts is None else np.min_scalar_type(max(map(len, self.cuts), default=0))

    def encode(self, columns: list[np.ndarray]) -> np.ndarray:
        """A row for each feature."""
        return np.array(columns if self.cuts is None else [np.searchsorted(c, x) for c, x in zip(self.cuts, columns, strict=True)], self.dtype)

    def reads(self, part) -> set[int]:  # noqa: ANN001
        return {part[0]} if self.cuts is None else {f for f, _ in _splits(part)}

    def value(self, part, x: list[np.ndarray]) -> np.ndarray | float:  # noqa: ANN001
        return part[1] * x[part[0]] if self.cuts is None else _grown_value(part, x)

    def predict(self, total: np.ndarray) -> np.ndarray:
        return total / self.over + self.constant


def _nodes(node) -> tuple | float:  # noqa: ANN001
    """A tree of MLlib: feature, cut, what is at most the cut and what is over it; or a leaf's value."""
    if not node.subtreeDepth():
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _nodes(node.leftChild()), _nodes(node.rightChild())


def _splits(tree: tuple | float) -> list[tuple[int, float]]:
    return [tree[:2], *_splits(tree[2]), *_splits(tree[3])] if isinstance(tree, tuple) else []


def _placed(tree: tuple | float, cuts: list[np.ndarray]) -> tuple | float:
    return (tree[0], int(np.searchsorted(cuts[tree[0]], tree[1])), _placed(tree[2], cuts), _placed(tree[3], cuts)) if isinstance(tree, tuple) else tree


def _grown_value(tree: tuple | float, x: list[np.ndarray]) -> np.ndarray | float:
    return np.where(x[tree[0]] <= tree[1], _grown_value(tree[2], x), _grown_value(tree[3], x)) if isinstance(tree, tuple) else tree


def permutation_importance(model, rows: DataFrame, features: list[str], bench: float, which: list[str] | None = None, seed: int = 42, target: str = "ret_exc") -> DataFrame:  # noqa: ANN001
    """Loss of R2 when one feature is dealt anew among all rows with a target, for each feature of which (all by default).

    Rows stand in a hashed order, and each feature moves on by a number of rows of its own. The order is cut into
    blocks, so a feature's values move to other blocks in a few pieces, and each block is scored in one task. Only
    the parts of the model that read a feature are worked out anew for it."""
    spark, names, form = rows.sparkSession, which or features, Parts.of(model)
    keyed = rows.filter(F.col(target).isNotNull()).select(F.xxhash64("permno", "date", F.lit(seed)).alias("h"), "permno", "date", F.col(target).cast("double").alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, f in enumerate(features)])
    m, dtype = len(features), form.dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.ascontiguousarray(form.encode([b.column(4 + j).to_numpy(zero_copy_only=False) for j in range(m)]).T)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * (m * dtype.itemsize)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(code)])], ["h", "permno", "date", "y", "code"])

    coded = cut(keyed.mapInArrow(encode, StructType([*keyed.schema.fields[:4], StructField("code", BinaryType())])))
    n = coded.count()
    blocks = max(-(-n // BLOCK), 1)
    block = F.shiftright((F.shiftright("h", 32) + F.lit(1 << 31)) * F.lit(blocks), 32).cast("int")  # follows the order
    coded = coded.withColumn("block", block)
    held = {r["block"]: r["count"] for r in coded.groupBy("block").count().collect()}  # one row for BLOCK rows
    firsts = np.cumsum([0, *[held.get(i, 0) for i in range(blocks)]])
    steps = dict(zip(map(features.index, names), np.random.default_rng(seed).integers(1, max(n, 2), len(names)).tolist(), strict=True))
    read = set().union(*map(form.reads, form.parts))
    steps = {j: k for j, k in steps.items() if j in read}  # without the others the model says the same

    def deal(table: pa.Table) -> pa.Table:
        at, own = np.argsort(table.column("at").to_numpy()), table.column("block")[0].as_py()
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype).reshape(len(at), m)[at].T
        out = [(own, -2, 0, table.column("y").to_numpy()[at].tobytes()), (own, -1, 0, code.tobytes())]
        for j, k in steps.items():
            done, to = 0, (int(firsts[own]) + k) % n
            while done < len(at):
                i = int(np.searchsorted(firsts, to, "right")) - 1
                some = min(len(at) - done, int(firsts[i + 1]) - to)
                out.append((i, j, to - int(firsts[i]), code[j, done : done + some].tobytes()))
                done, to = done + some, (to + some) % n
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "j", "at", "v"])

    def score(table: pa.Table) -> pa.Table:
        size = int(np.diff(firsts)[table.column("block")[0].as_py()])
        new = {j: np.empty(size, dtype) for j in steps}
        for j, at, v in zip(table.column("j").to_pylist(), table.column("at").to_pylist(), table.column("v"), strict=True):
            got = np.frombuffer(v.as_buffer(), float if j == -2 else dtype)
            if j == -2:
                y = got
            elif j == -1:
                x = list(got.reshape(m, size))
            else:
                new[j][at : at + len(got)] = got
        total, change = np.zeros(size), {j: np.zeros(size) for j in steps}
        for part in form.parts:
            old = form.value(part, x)
            total += old
            for j in form.reads(part) & steps.keys():
                change[j] += form.value(part, [*x[:j], new[j], *x[j + 1 :]]) - old
        loss = {-2: ((y - bench) ** 2).sum(), -1: ((y - form.predict(total)) ** 2).sum()} | {j: ((y - form.predict(total + c)) ** 2).sum() for j, c in change.items()}
        return pa.table([pa.array(list(loss), pa.int32()), pa.array(list(loss.values()), pa.float64())], ["j", "loss"])

    place = F.row_number().over(Window.partitionBy("block").orderBy("h", "permno", "date")) - 1
    moved = coded.select("block", place.alias("at"), "y", "code").groupBy("block").applyInArrow(deal, "block int, j int, at int, v binary")
    of = {r["j"]: r["loss"] for r in moved.groupBy("block").applyInArrow(score, "j int, loss double").groupBy("j").agg(F.sum("loss").alias("loss")).collect()}  # one row for each feature
    r2 = {j: 1 - loss / of[-2] for j, loss in of.items()} if of.get(-2) else None
    out = [(f, r2[-1] - r2.get(features.index(f), r2[-1]) if r2 else None) for f in names]
    return spark.createDataFrame(out, "feature string, importance double").withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("importance"), "feature")))


def small_set(ranked: list[str], allowed: tuple[str, ...] = ALLOWED, least: int = 15, most: int = 20, step: int = 5) -> list[str]:
    """Allowed features among the most important ones; the cut widens by steps until there are enough, and if there
    never are, the first allowed ones are taken. None at all is an error."""
    if not any(f in allowed for f in ranked):
        raise ValueError("none of the ranked features is allowed")
    for cut in range(least, len(ranked) + 1, step):
        chosen = [f for f in ranked[:cut] if f in allowed]
        if len(chosen) >= least:
            return chosen[:most]
    return [f for f in ranked if f in allowed][:least]
