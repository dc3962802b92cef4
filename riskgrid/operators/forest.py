"""Random forests and gradient boosting, with their error curves."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import hash_uniform, poisson_counts
from riskgrid.operators.growing import LOCAL_ROWS, Growth, bin_edges, block_table, grow
from riskgrid.operators.packed import Ensemble, as_array
from riskgrid.operators.trees import prefix_sums, r2_of_sums
from riskgrid.sources.workdir import materialize

MAX_DEPTH = 30  # deepest tree MLlib grows
# Trees that are grown side by side, in the same passes over the rows.
AT_ONCE = 16

# Tuned parameters of the full runs.
FOREST_PARAMETERS = {"trees": 180, "min_leaf": 1, "subset": "sqrt", "depth": 40}
BOOST_PARAMETERS = {"rounds": 180, "depth": 4, "rate": 0.05, "subsample": 0.5, "min_leaf": 15}


def rf_estimator(label: str, trees: int = 180, depth: int = 30, min_leaf: int = 1, subset: str = "sqrt",
                 seed: int = 123, features: str = "features") -> RandomForestRegressor:
    """MLlib's forest, for the parameter search; it grows no deeper than 30."""
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is beyond the estimator's {MAX_DEPTH}; rf_fit grows any depth")
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, predictionCol="yhat", numTrees=trees,
        maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, seed=seed)


def share_of_features(subset: str | float, count: int) -> float:
    """The share of features tried at a node: ``all``, ``sqrt``, ``log2``, ``onethird`` or a number."""
    named = {"all": 1.0, "sqrt": math.sqrt(count) / count, "log2": max(math.log2(count), 1) / count, "onethird": 1 / 3}
    return named[subset] if isinstance(subset, str) else float(subset)


def bag_uniforms(keys: Sequence[str], trees: int, seed: int, first: int = 0) -> Column:
    """Array of the numbers that the row's weights are drawn from, hashes of its key: the same on every run."""
    return F.array(*[hash_uniform(keys, first + b + seed) for b in range(trees)])


def bag_weights(keys: Sequence[str], trees: int, seed: int, first: int = 0) -> Column:
    """Array of the row's weight in each tree."""
    return poisson_counts(bag_uniforms(keys, trees, seed, first))


def grow_bag(rows: DataFrame, label: str, trees: int, weights: Callable[[int, int], Column], growth: Growth,
             subset: str | float = "all", features: str = "features", local_rows: int = LOCAL_ROWS,
             uniform: bool = False) -> Ensemble:
    """Trees of least squares on weighted copies of the rows: ``weights(first, n)`` gives a row's copies in n trees, or,
    with ``uniform``, the numbers that Poisson(1) copies are drawn from.

    Some trees share their passes over the rows. Nodes of up to ``local_rows`` rows are finished on exact values.
    """
    table = rows.withColumn("_y", F.col(label).cast("double"))
    edges = bin_edges(table, features)
    growth = replace(growth, by_node=share_of_features(subset, len(edges)))
    grown = []
    for first in range(0, trees, AT_ONCE):
        n = min(AT_ONCE, trees - first)
        # Drawn once: the copies of a row are hashes for every tree, and each level reads them.
        part = block_table(table, edges, weights(first, n), uniform, features)
        grown += grow(part, edges, growth, n, first, local_rows, "_x")
    return Ensemble(tuple(grown), mean=True)


def rf_fit(train: DataFrame, label: str, trees: int = 180, depth: int = 40, min_leaf: int = 1,
           subset: str | float = "sqrt", seed: int = 123, features: str = "features", bootstrap: bool = True,
           local_rows: int = LOCAL_ROWS) -> Ensemble:
    """A forest of any depth. Rows are drawn with Poisson(1) copies by a hash of their number in the written table.

    Large nodes are split on histograms, a level of all trees at a time; nodes of at most ``local_rows`` rows are
    shuffled to tasks and finished there on exact values. A large node that no histogram cut improves is a leaf.
    """
    # Arrays, as every pass over vectors would unpack them again.
    rows = materialize(train.select(as_array(train, features).alias(features), label)
                       .withColumn("_id", F.monotonically_increasing_id()), "forest")

    def weights(first: int, n: int) -> Column:
        return bag_uniforms(["_id"], n, seed, first) if bootstrap else F.array_repeat(F.lit(1.0), n)

    return grow_bag(rows, label, trees, weights, Growth(depth, min_leaf, seed=seed), subset, features, local_rows,
                    uniform=bootstrap)


def gbt_estimator(label: str, rounds: int = 180, depth: int = 4, rate: float = 0.05, subsample: float = 0.5,
                  min_leaf: int = 15, subset: str = "all", seed: int = 123,
                  features: str = "features") -> GBTRegressor:
    return GBTRegressor(
        featuresCol=features, labelCol=label, predictionCol="yhat", maxIter=rounds, maxDepth=depth,
        stepSize=rate, subsamplingRate=subsample, minInstancesPerNode=min_leaf,
        featureSubsetStrategy=subset, seed=seed)


def gbt_fit(train: DataFrame, label: str, **parameters) -> GBTRegressionModel:
    """Boosted trees under squared loss."""
    return gbt_estimator(label, **parameters).fit(train)


def mse_by_trees(model: Ensemble, df: DataFrame, label: str, sizes: Sequence[int],
                 by: str = "split", features: str = "features") -> DataFrame:
    """MSE per split for the first s trees. Trees are independent, so the first s trees are a forest
    of size s, and nothing is fitted again."""
    return prefix_sums(model, df, label, sizes, by, features).select(
        by, "trees", (F.col("sse") / F.col("n")).alias("mse"))


def staged_deviance(model: GBTRegressionModel, df: DataFrame, label: str) -> DataFrame:
    """Squared loss after each boosting round: ``round, deviance``."""
    losses = model.evaluateEachIteration(df.withColumnRenamed(label, model.getLabelCol()), "squared")
    return df.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(losses)], "round INT, deviance DOUBLE")


def validation_curve(df: DataFrame, label: str, sizes: Sequence[int], folds: int = 3, fold: str = "fold",
                     **parameters) -> DataFrame:
    """R2 on the training and the held-out part over tree counts: mean and sd over the folds.

    One forest of the largest size per fold; the smaller ones are its prefixes.
    """
    parts = []
    for k in range(folds):
        side = F.when(F.col(fold) == k, F.lit("valid")).otherwise(F.lit("train"))
        tagged = df.withColumn("side", side)
        model = rf_fit(tagged.where("side = 'train'"), label, **{**parameters, "trees": max(sizes)})
        parts.append(prefix_sums(model, tagged, label, sizes, "side").select(
            F.lit(k).alias("fold"), "side", "trees", r2_of_sums().alias("r2")))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    return scores.groupBy("side", "trees").agg(F.avg("r2").alias("mean_r2"),
                                               F.stddev_pop("r2").alias("sd_r2"))
