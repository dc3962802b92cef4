"""Importances, partial dependence and individual curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.operators.aggregates import running_share
from riskgrid.operators.packed import Ensemble, Packed, Tree, as_array, matrix, pack
from riskgrid.operators.quantiles import exact_quantiles
from riskgrid.operators.split import numbered, permuted, sample_n
from riskgrid.operators.trees import node_table

Scorer = Callable[[DataFrame], DataFrame]  # adds the column `yhat` to a table with `features`


def impurity_importance(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """``name, importance, std``: gain of the splits on a feature as a share of its tree's, mean and sd over the trees."""
    if isinstance(model, Ensemble):
        per_tree = np.zeros((len(model), len(names)))
        for i, tree in enumerate(model.trees):
            inner = tree.left >= 0
            np.add.at(per_tree[i], tree.feature[inner], tree.gain[inner])
        per_tree /= np.maximum(per_tree.sum(axis=1, keepdims=True), 1e-300)
        total = per_tree.mean(axis=0)
        total = total / max(total.sum(), 1e-300)
    else:
        per_tree = np.array([tree.featureImportances.toArray() for tree in model.trees])
        total = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(n, float(total[i]), float(per_tree[:, i].std())) for i, n in enumerate(names)],
        "name STRING, importance DOUBLE, std DOUBLE")


def gain_importance(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """``name, importance, splits, cover``: average gain and cover over the splits that use a feature; 0 if unused."""
    labels = spark.createDataFrame(list(enumerate(names)), "feature INT, name STRING")
    gains = node_table(spark, model).where("NOT is_leaf").groupBy("feature").agg(
        F.avg("gain").alias("importance"), F.count(F.lit(1)).alias("splits"), F.avg("cover").alias("cover"))
    return labels.join(gains, "feature", "left").select(
        "name", F.coalesce("importance", F.lit(0.0)).alias("importance"),
        F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def order_importance(importance: DataFrame) -> DataFrame:
    """Largest first, ties by name."""
    return importance.orderBy(F.desc("importance"), "name")


def topk_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features."""
    return order_importance(importance).limit(k)


def cum_importance(importance: DataFrame, share: float = 0.95) -> DataFrame:
    """Running sum of the ordered importances and whether a feature is needed to reach the share."""
    order = F.struct(-F.col("importance"), F.col("name"))
    running = running_share(importance, "importance", order)
    before = F.col("cumulative") - F.col("importance")
    return running.withColumn("needed", before < share)


# -- permutation importance -----------------------------------------------------------------------

def permutation_importance(df: DataFrame, scorer: Scorer, label: str, keys: Sequence[str],
                           names: Sequence[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """Drop of R2 after shuffling one feature: ``name, repeat, drop``.

    Per repeat, one random permutation brings every row the feature vector of a partner row; each
    feature in turn is then taken from the partner. So a repeat costs one join however many features
    there are, and all sums come from one aggregation.
    """
    base = df.select(*keys, F.col(label).cast("double").alias("_y"), vector_to_array("features").alias("_x"))
    rows, n = numbered(base.drop(*keys))
    turns = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    givers = turns.select("repeat", permuted(F.col("_row"), n, F.col("repeat") + seed).alias("_row"),
                          F.col("_x").alias("_p"))
    paired = turns.join(givers.hint("shuffle_hash"), ["repeat", "_row"]).select("repeat", "_y", "_x", "_p")
    swapped = (paired.withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))))
               .where("_j >= 0 OR repeat = 0")
               .select("repeat", "_j", "_y", _scored_as(scorer, F.expr(
                   "transform(_x, (v, i) -> CASE WHEN i = _j THEN _p[i] ELSE v END)")).alias("features")))
    errors = scorer(swapped).groupBy("repeat", "_j").agg(
        F.sum((F.col("_y") - F.col("yhat")) * (F.col("_y") - F.col("yhat"))).alias("sse"),
        (F.var_pop("_y") * F.count(F.lit(1))).alias("sst")).collect()
    r2 = {(e["repeat"], e["_j"]): 1 - e["sse"] / e["sst"] for e in errors}
    rows = [(names[j], r, float(r2[(0, -1)] - v)) for (r, j), v in sorted(r2.items()) if j >= 0]
    return df.sparkSession.createDataFrame(rows, "name STRING, repeat INT, drop DOUBLE")


def permutation_summary(drops: DataFrame) -> DataFrame:
    """Mean and sd of the drops per feature."""
    return drops.groupBy("name").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


# -- partial dependence ---------------------------------------------------------------------------

def feature_grid(df: DataFrame, column: str, points: int = 100, ends: tuple[float, float] = (0.05, 0.95)
                 ) -> list[float]:
    """Values at which a feature is swept: its distinct values when there are fewer than ``points``,
    else evenly spaced between the two percentiles (by the estimate with parameters 0.4, 0.4)."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct().limit(points).collect()
    if len(distinct) < points:
        return sorted(float(r[0]) for r in distinct)
    n = df.where(F.col(column).isNotNull()).count()
    probs = [min(max((n * p + 0.4 + 0.2 * p - 1) / (n - 1), 0.0), 1.0) for p in ends]
    row = exact_quantiles(df, column, probs).first()
    return [float(v) for v in np.linspace(row["q0"], row["q1"], points)]


def _scored_as(scorer: Scorer | None, values: Column) -> Column:
    """Changed features in the form that the scorer takes: the library's own ensembles need no vectors."""
    return values if isinstance(getattr(scorer, "__self__", None), Ensemble) else array_to_vector(values)


def grid_rows(df: DataFrame, grids: dict[int, list[float]], scorer: Scorer | None = None) -> DataFrame:
    """Every row once per grid value, with that value in place of its own.

    The grid is an array literal of at most a few hundred numbers that each row unfolds by itself;
    no second table takes part.
    """
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.lit(float(v)).alias("v"))
                      for j, values in grids.items() for i, v in enumerate(values)]).cast(
        "array<struct<j: int, i: int, v: double>>")
    others = [c for c in df.columns if c != "features"]
    return (df.select(*others, vector_to_array("features").alias("_x"), F.explode(cells).alias("_c"))
            .select(*others, F.col("_c.j").alias("_j"), F.col("_c.i").alias("grid_index"),
                    F.col("_c.v").alias("grid_value"),
                    _scored_as(scorer, F.expr("transform(_x, (v, i) -> CASE WHEN i = _c.j THEN _c.v ELSE v END)"))
                    .alias("features")))


def _grids(df: DataFrame, names: Sequence[str], features: Sequence[str], points: int) -> dict[int, list[float]]:
    return {list(names).index(f): feature_grid(df, f, points) for f in features}


def partial_dependence(df: DataFrame, scorer: Scorer, names: Sequence[str], features: Sequence[str],
                       points: int = 100) -> DataFrame:
    """Mean prediction as one feature sweeps its grid: ``name, grid_index, grid_value, mean``.

    The table has the feature columns and their vector; rows are unfolded, scored and summed in one
    stage, and only one partial sum per grid value is shuffled. The library's own ensembles sweep a batch as a matrix.
    """
    grids = _grids(df, names, features, points)
    model = getattr(scorer, "__self__", None)
    if isinstance(model, Ensemble) and scorer == model.transform and model.fits_one_block() and any(grids.values()):
        return _swept_means(df, model, names, grids)
    swept = scorer(grid_rows(df.select("features"), grids, scorer))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_j") + 1)
    return (swept.groupBy(label.alias("name"), "grid_index", "grid_value")
            .agg(F.avg("yhat").alias("mean")))


def _swept_means(df: DataFrame, model: Ensemble, names: Sequence[str], grids: dict[int, list[float]]) -> DataFrame:
    """Every row is scored at every grid value inside its batch; a task gives one sum for a value."""
    cells = [(j, i, float(v)) for j, values in grids.items() for i, v in enumerate(values)]
    weight = model.rate / len(model) if model.mean and len(model) else model.rate
    shipped = df.sparkSession.sparkContext.broadcast(Packed(model.trees) if len(model) else None)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(cells)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("_x"))
            n += len(x)
            for at, (j, _, v) in enumerate(cells):
                swept = x.copy()
                swept[:, j] = v
                outputs = shipped.value.sums(swept) if shipped.value else np.zeros(len(x))
                sums[at] += (model.base + weight * outputs).sum()
        if n:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(cells), dtype=np.int32), "sum": sums,
                                              "n": np.full(len(cells), n, dtype=np.int64)})

    means = (df.select(as_array(df, "features").alias("_x")).mapInArrow(partial, "cell int, sum double, n bigint")
             .groupBy("cell").agg((F.sum("sum") / F.sum("n")).alias("mean")))
    labels = F.array(*[F.struct(F.lit(names[j]).alias("name"), F.lit(i).alias("i"), F.lit(v).alias("v")) for j, i, v in cells])
    own = F.get(labels, F.col("cell"))
    return means.select(own["name"].alias("name"), own["i"].alias("grid_index"), own["v"].alias("grid_value"), "mean")


def node_dependence(tree: Tree, feature: int, grid: np.ndarray) -> np.ndarray:
    """Output of a tree for every value of one feature, the others averaged by the rows of the nodes they lead to."""
    weight = np.zeros((len(tree), len(grid)))
    weight[0] = 1.0
    for node in np.flatnonzero(tree.left >= 0):  # children come after their parents
        a, b = tree.left[node], tree.right[node]
        if tree.feature[node] == feature:
            goes_left = (np.isin(grid, tree.categories[node]) if node in tree.categories else grid <= tree.threshold[node])
            share = goes_left.astype(float)
        else:
            share = tree.cover[a] / max(tree.cover[a] + tree.cover[b], 1e-300)
        weight[a], weight[b] = weight[node] * share, weight[node] * (1 - share)
    return tree.value[tree.leaves] @ weight[tree.leaves]


def dependence_by_nodes(df: DataFrame, model, names: Sequence[str], features: Sequence[str],
                        points: int = 100) -> DataFrame:
    """Mean prediction as one feature sweeps its grid, from the trees alone: ``name, grid_index, grid_value, mean``.

    A split on another feature is followed both ways by the cover of its children, so no row is scored: the work
    is nodes x grid values. It is the mean over the training rows as each tree's splits see them, which equals
    :func:`partial_dependence` on the training rows for trees whose splits on other features are independent of the
    feature (one split per tree, for instance) and is the usual approximation otherwise.
    """
    spark = df.sparkSession
    packed = pack(spark, model)
    scale = packed.rate / len(packed) if packed.mean else packed.rate
    rows = []
    for j, grid in _grids(df, names, features, points).items():
        mean = packed.base + scale * sum(node_dependence(t, j, np.asarray(grid)) for t in packed.trees)
        rows += [(names[j], i, float(v), float(m)) for i, (v, m) in enumerate(zip(grid, mean))]
    return spark.createDataFrame(rows, "name STRING, grid_index INT, grid_value DOUBLE, mean DOUBLE")


def ice_curves(df: DataFrame, scorer: Scorer, names: Sequence[str], features: Sequence[str],
               keys: Sequence[str], n: int = 100, points: int = 100, seed: int = 1) -> DataFrame:
    """One curve per sampled row: ``keys.., name, grid_index, grid_value, yhat``."""
    rows = sample_n(df, keys, n, seed).select(*keys, "features")
    swept = scorer(grid_rows(rows, _grids(df, names, features, points), scorer))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_j") + 1)
    return swept.select(*keys, label.alias("name"), "grid_index", "grid_value", "yhat")
