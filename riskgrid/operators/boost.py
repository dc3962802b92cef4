"""Boosting with a loss given as column expressions.

Each round grows one second-order tree on the current gradient and hessian and adds its leaf values to the running
prediction; a quantile loss sets the leaf values by its own rule. The loss stays a pair of expressions, so it
runs inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions import hash_uniform
from riskgrid.operators.growing import Growth, bin_edges, bin_matrix, binned, grow, on_bins
from riskgrid.operators.packed import Ensemble, Packed, Tree, numbers
from riskgrid.operators.quantiles import numbered_quantiles
from riskgrid.sources.workdir import discard, materialize, shared_path

CHECKPOINT_EVERY = 10
RUNNING = "_f"

Expression = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Loss:
    """Gradient and hessian of (y, prediction, random sign); ``alpha`` marks a quantile leaf rule."""

    gradient: Expression
    hessian: Expression
    alpha: float | None = None


def squared_loss() -> Loss:
    return Loss(lambda y, f, sign: f - y, lambda y, f, sign: F.lit(1.0))


def quantile_loss(alpha: float) -> Loss:
    """Quantile loss; a leaf takes the quantile of its residuals."""
    return Loss(lambda y, f, sign: F.when(y > f, F.lit(-alpha)).otherwise(F.lit(1.0 - alpha)),
                lambda y, f, sign: F.lit(1.0), alpha=alpha)


def smooth_quantile_loss(alpha: float, delta: float = 1.0, threshold: float = 1.0, var: float = 1.0,
                         randomised: bool = True) -> Loss:
    """Quantile loss made quadratic between (alpha - 1) delta and alpha delta. Residuals of at least
    ``threshold`` get a random push of size ``var``; without it the plain piecewise loss is left."""
    low, high = (alpha - 1.0) * delta, alpha * delta

    def gradient(y: Column, f: Column, sign: Column) -> Column:
        x = y - f
        inner = (F.when(x < low, F.lit(1.0 - alpha)).when(x < high, -x / delta)
                 .when(x > high, F.lit(-alpha)).otherwise(F.lit(0.0)))
        return F.when(F.abs(x) < threshold, inner).otherwise(-sign * var) if randomised else inner

    def hessian(y: Column, f: Column, sign: Column) -> Column:
        x = y - f
        inner = F.when((x >= low) & (x < high), F.lit(1.0 / delta)).otherwise(F.lit(0.0))
        return F.when(F.abs(x) < threshold, inner).otherwise(F.lit(1.0)) if randomised else inner

    return Loss(gradient, hessian)


@dataclass(frozen=True)
class BoostSettings:
    """Settings of a run; those of a tree are explained at :class:`riskgrid.operators.growing.Growth`."""

    rounds: int = 100
    depth: int = 4
    rate: float = 0.1
    subsample: float = 1.0
    min_leaf: int = 1
    min_child: float = 0.0
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    max_step: float = 0.0
    by_tree: float = 1.0
    by_level: float = 1.0
    by_node: float = 1.0
    seed: int = 123

    def growth(self) -> Growth:
        return Growth(self.depth, self.min_leaf, self.min_child, self.min_gain, self.l1, self.l2, self.max_step,
                      self.by_tree, self.by_level, self.by_node, self.seed)


def boost_fit(df: DataFrame, label: str, loss: Loss, settings: BoostSettings, keys: Sequence[str],
              base: float | None = None, split: str | None = None, features: str = "features") -> Ensemble:
    """Fit on the rows with ``split = 'train'`` (all rows without a split column) and log the RMSE of
    every split after each round.

    Features are binned once. A round grows a tree on gradient and hessian with one aggregation per level, and adds
    its leaf values to the running prediction, in the pass that also takes the errors. The running prediction is
    cached per round and written to the shared folder every few rounds, so the plan does not grow with the
    rounds and a lost executor costs a few of them.
    """
    part = F.col(split) if split else F.lit("train")
    rows = materialize(
        df.select(*keys, features, F.col(label).cast("double").alias("_y"), part.alias("_split")), "boost")
    train = rows.where("_split = 'train'")
    edges = bin_edges(train, features)
    if base is None:
        base = _base_value(train, loss)
    current = binned(rows, edges, features).drop(features).withColumn(RUNNING, F.lit(float(base)))
    current, path = _written(current)
    growth = settings.growth()
    trees, log = [], []
    for number in range(settings.rounds):
        sign = F.when(hash_uniform(keys, settings.seed + 7919 * (number + 1)) < 0.5, -1.0).otherwise(1.0)
        y, f = F.col("_y"), F.col(RUNNING)
        seen = current.where("_split = 'train'")
        if settings.subsample < 1.0:
            seen = seen.where(hash_uniform(keys, settings.seed + number) < settings.subsample)
        sums = seen.select("_b", F.array(loss.gradient(y, f, sign)).alias("_g"),
                           F.array(loss.hessian(y, f, sign).cast("double")).alias("_h"), F.array(F.lit(1.0)).alias("_n"))
        tree = grow(sums, edges, growth, first_tree=number)[0]
        if loss.alpha is not None:
            tree = tree.with_values(_leaf_quantiles(seen, tree, edges, loss.alpha))
        updated = current.withColumn(RUNNING, F.col(RUNNING) + F.lit(settings.rate) * _step(current, tree, edges)("_b"))
        old = None
        if (number + 1) % CHECKPOINT_EVERY == 0:
            old = path
            updated, path = _written(updated)
        updated = updated.persist(StorageLevel.MEMORY_AND_DISK)
        errors = updated.groupBy("_split").agg(
            F.sqrt(F.avg((F.col("_y") - F.col(RUNNING)) * (F.col("_y") - F.col(RUNNING)))).alias("e")).collect()
        current.unpersist()
        current = updated
        if old:
            # Only the last written state is read from here on; hundreds of rounds would leave dozens behind.
            discard(df.sparkSession, old)
        trees.append(tree)
        log.extend((number + 1, e["_split"], e["e"]) for e in sorted(errors, key=lambda e: e["_split"]))
    current.unpersist()
    return Ensemble(tuple(trees), float(base), settings.rate, log=tuple(log))


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table read back from the shared folder, as :func:`materialize` does, and where it lies."""
    path = shared_path(df.sparkSession, "boost")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _base_value(train: DataFrame, loss: Loss) -> float:
    if loss.alpha is None:
        return train.agg(F.avg("_y")).first()[0]

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(batch.num_rows, dtype=np.int32), numbers(batch.column("_y"))

    return numbered_quantiles(train.select("_y"), read, [0], [loss.alpha])[0][0]


def _step(df: DataFrame, tree: Tree, edges: Sequence[np.ndarray]):
    """A column function of the bins: the value of the leaf a row falls into."""
    shipped = df.sparkSession.sparkContext.broadcast(Packed([on_bins(tree, edges)]))
    count = len(edges)

    @F.arrow_udf(T.DoubleType())
    def step(bins: pa.Array) -> pa.Array:
        packed = shipped.value
        for _, node in packed.walk(bin_matrix(bins, count)):
            return pa.array(packed.value[node[:, 0]])

    return step


def _leaf_quantiles(seen: DataFrame, tree: Tree, edges: Sequence[np.ndarray], alpha: float) -> list[float]:
    """The quantile of the residuals in each leaf."""
    shipped = seen.sparkSession.sparkContext.broadcast(Packed([on_bins(tree, edges)]))
    count, leaves = len(edges), range(len(tree.leaves))

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        packed = shipped.value
        leaf = np.concatenate([packed.leaf[node[:, 0]] for _, node in packed.walk(bin_matrix(batch.column("_b"), count))])
        return leaf, numbers(batch.column("_y")) - numbers(batch.column(RUNNING))

    found = numbered_quantiles(seen.select("_b", "_y", RUNNING), read, leaves, [alpha])
    return [float(found[i][0]) if i in found else 0.0 for i in leaves]


def quantile_boost_fit(df: DataFrame, label: str, alpha: float, settings: BoostSettings,
                       keys: Sequence[str], **options) -> Ensemble:
    """Boosted trees under quantile loss."""
    return boost_fit(df, label, quantile_loss(alpha), settings, keys, **options)


def newton_boost_fit(df: DataFrame, label: str, settings: BoostSettings, keys: Sequence[str],
                     base: float = 0.5, **options) -> Ensemble:
    """Second-order boosting under squared loss, starting from a constant."""
    return boost_fit(df, label, squared_loss(), settings, keys, base=base, **options)


def smooth_quantile_boost(df: DataFrame, label: str, alpha: float, settings: BoostSettings,
                          keys: Sequence[str], delta: float = 1.0, threshold: float = 1.0,
                          var: float = 1.0, base: float = 0.5, **options) -> Ensemble:
    """Second-order boosting under the smoothed quantile loss."""
    loss = smooth_quantile_loss(alpha, delta, threshold, var)
    return boost_fit(df, label, loss, settings, keys, base=base, **options)


def round_cv(df: DataFrame, label: str, rounds: Sequence[int], settings: BoostSettings,
             keys: Sequence[str], folds: int = 3, fold: str = "fold") -> DataFrame:
    """Held-out RMSE after 5, 10, .. rounds, mean over folds; one fit per fold at the largest count."""
    log = []
    for k in range(folds):
        side = F.when(F.col(fold) == k, F.lit("valid")).otherwise(F.lit("train"))
        model = newton_boost_fit(df.withColumn("_side", side), label, replace(settings, rounds=max(rounds)),
                                 keys, split="_side")
        log.extend((n, e) for n, part, e in model.log if part == "valid" and n in rounds)
    return (df.sparkSession.createDataFrame(log, "num_boosting_rounds INT, e DOUBLE")
            .groupBy("num_boosting_rounds").agg(F.avg("e").alias("rmse")))
