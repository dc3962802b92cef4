"""Parameter search by cross-validation and the final refit."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import hash_uniform
from riskgrid.operators.forest import bag_uniforms, grow_bag, share_of_features
from riskgrid.operators.growing import LOCAL_ROWS, Growth, bin_edges, block_table, doubles, gathered, grow
from riskgrid.operators.packed import Ensemble, Packed, Tree, as_array, tree_outputs
from riskgrid.sources.workdir import materialize


@dataclass(frozen=True)
class SearchResult:
    """All tried settings with their score, the best one, and the model refitted with all of it."""

    tried: tuple[tuple[dict, float], ...]
    best: dict
    model: Model | Ensemble

    def table(self, spark: SparkSession) -> DataFrame:
        """``candidate, parameter, value, score``."""
        return spark.createDataFrame(
            [(i, name, str(value), float(score)) for i, (setting, score) in enumerate(self.tried)
             for name, value in sorted(setting.items())],
            "candidate INT, parameter STRING, value STRING, score DOUBLE")

    def best_table(self, spark: SparkSession) -> DataFrame:
        """``Parameters, Value`` of the best setting."""
        return spark.createDataFrame([(k, str(v)) for k, v in sorted(self.best.items())],
                                     "Parameters STRING, Value STRING")


def parameter_grid(space: dict[str, Sequence]) -> list[dict]:
    """All combinations of the listed values."""
    grid: list[dict] = [{}]
    for name, values in space.items():
        grid = [{**setting, name: value} for setting in grid for value in values]
    return grid


def draw_settings(space: dict[str, Sequence], n: int, seed: int) -> list[dict]:
    """``n`` different combinations, drawn by position, so the full grid is never listed."""
    sizes = [len(v) for v in space.values()]
    total = 1
    for size in sizes:
        total *= size
    settings = []
    for number in random.Random(seed).sample(range(total), min(n, total)):
        setting = {}
        for (name, values), size in zip(space.items(), sizes):
            number, at = divmod(number, size)
            setting[name] = values[at]
        settings.append(setting)
    return settings


def search_cv(df: DataFrame, estimator: Estimator, settings: Sequence[dict], label: str, folds: int,
              fold: str = "fold", metric: str = "mse", parallelism: int = 2) -> SearchResult:
    """Score every setting by cross-validation on the given fold column and refit the best one."""
    maps = [{estimator.getParam(name): value for name, value in s.items()} for s in settings]
    validator = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, numFolds=folds, foldCol=fold, parallelism=parallelism,
        evaluator=RegressionEvaluator(labelCol=label, predictionCol=estimator.getPredictionCol(),
                                      metricName=metric))
    fitted = validator.fit(df)
    scores = [float(s) for s in fitted.avgMetrics]
    pick = max if metric == "r2" else min
    best = settings[scores.index(pick(scores))]
    return SearchResult(tuple(zip(settings, scores)), dict(best), fitted.bestModel)


def random_search_cv(df: DataFrame, estimator: Estimator, space: dict[str, Sequence], label: str,
                     draws: int = 10, folds: int = 4, seed: int = 42, **options) -> SearchResult:
    """Cross-validate a random draw of the parameter space."""
    return search_cv(df, estimator, draw_settings(space, draws, seed), label, folds, **options)


def grid_search_cv(df: DataFrame, estimator: Estimator, space: dict[str, Sequence], label: str,
                   folds: int = 9, **options) -> SearchResult:
    """Cross-validate the whole parameter space."""
    return search_cv(df, estimator, parameter_grid(space), label, folds, **options)


def refit_best(df: DataFrame, estimator: Estimator, best: dict) -> Model:
    """Fit once more on all rows with every chosen parameter."""
    return estimator.copy({estimator.getParam(k): v for k, v in best.items()}).fit(df)


# -- forests, all candidates and folds side by side ------------------------------------------------

def _held_out(rows: DataFrame, forests: dict[tuple, dict[int, list[Tree]]], sizes: dict[tuple, list[int]]
              ) -> dict[tuple, float]:
    """Mean over the folds of the held-out MSE for every (group, size), from one pass over the rows."""
    shipped = rows.sparkSession.sparkContext.broadcast(
        [(group, k, Packed(trees), np.array(sizes[group])) for group, by_fold in forests.items()
         for k, trees in by_fold.items()])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in gathered(batches):
            y, folds = (doubles(batch.column(c), 1).ravel() for c in ("_y", "_fold"))
            x = doubles(batch.column("_x"), len(y))
            for i, (_, k, packed, prefix) in enumerate(shipped.value):
                own = np.flatnonzero(folds == k)
                if len(own):
                    means = np.cumsum(tree_outputs(packed, x[own]), axis=1)[:, prefix - 1] / prefix
                    for j, sse in enumerate(((y[own, None] - means) ** 2).sum(axis=0)):
                        sums[i, j] = sums.get((i, j), 0) + np.array([sse, len(own)])
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([i for i, _ in sums], pa.int32()), "j": pa.array([j for _, j in sums], pa.int32()),
            "sse": pa.array([v[0] for v in sums.values()], pa.float64()),
            "n": pa.array([float(v[1]) for v in sums.values()], pa.float64())})

    found = rows.mapInArrow(partial, "i int, j int, sse double, n double").groupBy("i", "j").agg(
        (F.sum("sse") / F.sum("n")).alias("mse")).collect()
    scores: dict[tuple, list[float]] = {}
    for r in found:
        group, _, _, prefix = shipped.value[r["i"]]
        scores.setdefault((group, int(prefix[r["j"]])), []).append(r["mse"])
    return {key: float(np.mean(v)) for key, v in scores.items()}


def forest_search_cv(df: DataFrame, label: str, settings: Sequence[dict], folds: int, fold: str = "fold", seed: int = 123,
                     features: str = "features", at_once: int = 64, halving: bool = False,
                     local_rows: int = LOCAL_ROWS) -> SearchResult:
    """Cross-validate forests (settings with ``trees``, ``depth``, ``min_leaf``, ``subset``) by held-out MSE.

    Trees of all candidates and folds grow side by side, ``at_once`` in the same passes: a row counts in a tree as often
    as it was drawn, and not at all in the trees of the fold that holds it out. Candidates that differ in ``trees`` only
    are prefixes of one forest. All are scored in one pass. With ``halving`` forests grow to a quarter, half and
    all of their trees, and after each step the worse half of the candidates is left as it is.
    """
    base = {"trees": 180, "depth": 40, "min_leaf": 1, "subset": "sqrt"}
    full = [{**base, **s} for s in settings]
    group_of = [(s["depth"], s["min_leaf"], s["subset"]) for s in full]
    rows = materialize(df.select(as_array(df, features).alias(features), F.col(label).cast("double").alias("_y"),
                                 F.col(fold).cast("int").alias("_fold"))
                       .withColumn("_id", F.monotonically_increasing_id()), "search")
    edges = bin_edges(rows, features)
    scoring = None
    forests: dict[tuple, dict[int, list[Tree]]] = {g: {k: [] for k in range(folds)} for g in group_of}
    alive, scores = list(range(len(full))), [float("inf")] * len(full)
    for share in (0.25, 0.5, 1.0) if halving else (1.0,):
        sizes: dict[tuple, list[int]] = {}
        for i in alive:
            sizes.setdefault(group_of[i], []).append(max(1, round(full[i]["trees"] * share)))
        sizes = {g: sorted(set(v)) for g, v in sizes.items()}
        wanted = [(g, k, t) for g, v in sizes.items() for k in range(folds) for t in range(len(forests[g][k]), v[-1])]
        for at in range(0, len(wanted), at_once):
            part = wanted[at:at + at_once]
            # The number 0 draws no copy.
            draws = F.array(*[F.when(F.col("_fold") != k, hash_uniform(["_id"], t + seed)).otherwise(0.0)
                              for _, k, t in part])
            drawn = block_table(rows, edges, draws, True, features, ["_fold"])
            scoring = drawn.select("_rows", "_x", "_y", "_fold") if scoring is None else scoring
            limits = [Growth(g[0], g[1], by_node=share_of_features(g[2], len(edges)), seed=seed) for g, _, _ in part]
            grown = grow(drawn, edges, limits, len(part), 0, local_rows, "_x", numbers=[t for _, _, t in part])
            for (g, k, _), tree in zip(part, grown):
                forests[g][k].append(tree)
        found = _held_out(scoring, {g: forests[g] for g in sizes}, sizes)
        for i in alive:
            scores[i] = found[group_of[i], max(1, round(full[i]["trees"] * share))]
        if share < 1.0:
            alive = sorted(sorted(alive, key=lambda i: (scores[i], i))[: max(1, -(-len(alive) // 2))])
    best = min(alive, key=lambda i: (scores[i], i))
    chosen = full[best]
    model = grow_bag(rows, "_y", chosen["trees"], lambda first, n: bag_uniforms(["_id"], n, seed, first),
                     Growth(chosen["depth"], chosen["min_leaf"], seed=seed), chosen["subset"], features, local_rows,
                     uniform=True)
    return SearchResult(tuple(zip(settings, scores)), dict(settings[best]), model)
