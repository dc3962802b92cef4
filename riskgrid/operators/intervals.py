"""Prediction intervals. Every result names its level and keeps lower <= upper."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators.boost import (
    BoostSettings,
    boost_fit,
    quantile_boost_fit,
    smooth_quantile_boost,
    squared_loss,
)
from riskgrid.functions import poisson_of
from riskgrid.operators.forest import bag_uniforms, grow_bag
from riskgrid.operators.growing import Growth
from riskgrid.operators.packed import Ensemble, Packed, as_array, matrix, numbers, pack, structs, tree_leaves, tree_outputs
from riskgrid.operators.quantiles import numbered_quantiles
from riskgrid.operators.trees import LEAF, leaf_numbers
from riskgrid.sources.workdir import materialize


def ordered(df: DataFrame, level: float) -> DataFrame:
    """Swap crossing bounds and name the level."""
    return df.withColumns({"lower": F.least("lower", "upper"), "upper": F.greatest("lower", "upper"),
                           "level": F.lit(level)})


def forest_percentile_interval(model, df: DataFrame, level: float = 0.95, features: str = "features") -> DataFrame:
    """Percentiles over the predictions of the single trees, and their mean, in one scoring pass."""
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(Packed(pack(spark, model).trees))
    ends = [50 * (1 - level), 100 - 50 * (1 - level)]

    @F.arrow_udf("lower double, upper double, yhat double")
    def bounds(rows: pa.Array) -> pa.Array:
        outputs = tree_outputs(shipped.value, matrix(rows))
        low, high = np.percentile(outputs, ends, axis=1)
        return structs(lower=low, upper=high, yhat=outputs.mean(axis=1))

    scored = df.withColumn("_b", bounds(as_array(df, features)))
    return ordered(scored.withColumns({c: F.col(f"_b.{c}") for c in ("lower", "upper", "yhat")}), level).drop("_b")


def leaf_quantile_interval(model, train: DataFrame, df: DataFrame, label: str,
                           keys: Sequence[str], level: float = 0.95, bins: int = 200,
                           in_memory_cells: int = 5_000_000, exact_responses: int = 5_000_000) -> DataFrame:
    """Percentiles of the training responses pooled over the leaves a row falls into; every leaf weighs the same.

    Exact as long as training rows x trees are at most ``exact_responses``: the leaves' sorted responses are broadcast,
    and a bound is the least response at which the pooled weights reach its share.

    Beyond that responses are counted on ``bins`` quantile bins of the training label, so a leaf is a short
    vector of shares whatever its size, and a row averages the vectors of its leaves; the bounds are
    interpolated inside their bin, so they are off by less than the width of the bin that holds the exact bound (a
    bin holds about 1 / ``bins`` of the training responses). Leaf vectors are broadcast up to ``in_memory_cells``
    numbers and joined by (tree, leaf) beyond that.
    """
    spark = df.sparkSession
    model = pack(spark, model)
    if train.count() * len(model) <= exact_responses:
        return _exact_leaf_interval(model, train, df, label, level)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(batch.num_rows, dtype=np.int32), numbers(batch.column("_y")).astype(float)

    cuts = numbered_quantiles(train.select(F.col(label).cast("double").alias("_y")), read, [0],
                              [i / bins for i in range(bins + 1)])
    edges = np.unique(cuts[0])
    if len(edges) == 1:
        edges = np.array([edges[0], edges[0]])
    width = len(edges) - 1
    probs = [(1 - level) / 2, (1 + level) / 2]

    sizes = [len(tree.leaves) for tree in model.trees]
    leaves = sum(sizes)
    first_leaf = np.cumsum(sizes) - sizes
    walked = spark.sparkContext.broadcast(Packed(model.trees))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filled cells (tree, leaf, bin) of a task, emitted when they are many; no row is made for a row and tree."""
        cells, sums, waiting = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([cells, *waiting]), return_inverse=True)
            own = np.bincount(at[:len(cells)], sums, len(found)) + np.bincount(at[len(cells):], minlength=len(found))
            return found, own.astype(np.int64)

        def table() -> pa.RecordBatch:
            leaf, tree = cells // width, np.searchsorted(first_leaf, cells // width, side="right") - 1
            return pa.RecordBatch.from_pydict({
                "tree": tree.astype(np.int32), "leaf": (leaf - first_leaf[tree]).astype(np.int32),
                "bin": (cells % width).astype(np.int32), "count": sums})

        for batch in batches:
            if not batch.num_rows:
                continue
            values = numbers(batch.column("_y")).astype(float)
            bin_of = np.clip(np.searchsorted(edges, values, side="right") - 1, 0, width - 1)
            cell = (first_leaf + tree_leaves(walked.value, matrix(batch.column("_x")))) * width + bin_of[:, None]
            waiting.append(cell.ravel())
            if sum(len(w) for w in waiting) > 1_000_000:
                cells, sums = merged()
                waiting = []
                if len(cells) > 2_000_000:
                    yield table()
                    cells, sums = cells[:0], sums[:0]
        cells, sums = merged()
        yield table()

    counts = (train.select(F.col(label).cast("double").alias("_y"), vector_to_array("features").alias("_x"))
              .mapInArrow(count, "tree int, leaf int, bin int, count bigint")
              .groupBy("tree", "leaf", "bin").agg(F.sum("count").alias("count")))
    target = leaf_numbers(model, df)

    def bounds_of(shares: np.ndarray) -> np.ndarray:
        return np.column_stack([_inverse_of_shares(shares, edges, p) for p in probs])

    if leaves * width <= in_memory_cells:
        local = counts.toPandas()
        starts = np.cumsum(sizes) - sizes
        table = np.zeros((leaves, width))
        table[starts[local["tree"]] + local["leaf"], local["bin"]] = local["count"]
        table /= np.maximum(table.sum(axis=1, keepdims=True), 1)
        shipped = spark.sparkContext.broadcast((table, starts))

        @F.arrow_udf("lower double, upper double")
        def bounds(row_leaves: pa.Array) -> pa.Array:
            shares, start = shipped.value
            at = start + matrix(row_leaves).astype(np.int64)
            pooled = np.zeros((len(at), width))
            for tree in range(at.shape[1]):
                pooled += shares[at[:, tree]]
            found = bounds_of(pooled / at.shape[1])
            return structs(lower=found[:, 0], upper=found[:, 1])

        scored = target.withColumn("_b", bounds(LEAF))
        out = scored.withColumns({"lower": F.col("_b.lower"), "upper": F.col("_b.upper")}).drop("_b", LEAF)
        return ordered(out, level)

    vectors = counts.groupBy("tree", "leaf").agg(  # at most `bins` entries per leaf
        F.collect_list(F.struct("bin", "count")).alias("cells"), F.sum("count").alias("total"))
    exploded = target.select(*keys, F.posexplode(LEAF).alias("tree", "leaf")).withColumn(
        "leaf", F.col("leaf").cast("int"))
    cells = (exploded.join(vectors, ["tree", "leaf"])
             .select(*keys, F.explode("cells").alias("c"), "total")
             .groupBy(*keys, "c.bin").agg(F.sum(F.col("c.count") / F.col("total")).alias("share"))
             .groupBy(*keys).agg(F.collect_list(F.struct("bin", "share")).alias("cells")))
    trees = len(model.trees)

    @F.pandas_udf("lower double, upper double")
    def bounds_of_cells(rows: pd.Series) -> pd.DataFrame:
        shares = np.zeros((len(rows), width))
        for i, row in enumerate(rows):
            for cell in row:
                shares[i, cell["bin"]] = cell["share"] / trees
        found = bounds_of(shares)
        return pd.DataFrame({"lower": found[:, 0], "upper": found[:, 1]})

    bounds = cells.withColumn("_b", bounds_of_cells("cells")).select(*keys, "_b.lower", "_b.upper")
    return ordered(target.drop(LEAF).join(bounds, list(keys)), level)


def _exact_leaf_interval(model: Ensemble, train: DataFrame, df: DataFrame, label: str, level: float) -> DataFrame:
    """Pooled percentiles with the responses of all leaves at hand; their number was checked."""
    responses = (leaf_numbers(model, train).select(F.col(label).cast("double").alias("y"), F.posexplode(LEAF).alias("tree", "leaf"))
                 .orderBy("tree", "leaf", "y").toPandas())
    sizes = np.array([len(t.leaves) for t in model.trees])
    first = np.cumsum(sizes) - sizes
    own = np.bincount(first[responses["tree"].to_numpy()] + responses["leaf"].to_numpy(), minlength=sizes.sum())
    shipped = df.sparkSession.sparkContext.broadcast((responses["y"].to_numpy(), np.cumsum(own) - own, own, first))
    shares = np.array([(1 - level) / 2, (1 + level) / 2])

    @F.pandas_udf("lower double, upper double")
    def bounds(leaves: pd.Series) -> pd.DataFrame:
        y, start, size, first = shipped.value
        out = np.full((len(leaves), 2), np.nan)
        for i, row in enumerate(leaves):
            at = first + np.asarray(row)
            used = at[size[at] > 0]
            if len(used) == 0:
                continue
            pooled = np.concatenate([y[start[a]:start[a] + size[a]] for a in used])
            weight = np.repeat(1 / (size[used] * len(used)), size[used])
            order = np.argsort(pooled, kind="stable")
            reached = np.searchsorted(np.cumsum(weight[order]), shares - 1e-9)
            out[i] = pooled[order][np.minimum(reached, len(pooled) - 1)]
        return pd.DataFrame({"lower": out[:, 0], "upper": out[:, 1]})

    scored = leaf_numbers(model, df).withColumn("_b", bounds(LEAF))
    return ordered(scored.withColumns({"lower": F.col("_b.lower"), "upper": F.col("_b.upper")}).drop("_b", LEAF), level)


def _inverse_of_shares(shares: np.ndarray, edges: np.ndarray, p: float) -> np.ndarray:
    """Value below which a share p of each row's distribution lies."""
    cumulative = np.hstack([np.zeros((len(shares), 1)), np.cumsum(shares, axis=1)])
    at = np.clip((cumulative < p).sum(axis=1) - 1, 0, shares.shape[1] - 1)
    rows = np.arange(len(shares))
    own = shares[rows, at]
    inside = np.clip((p - cumulative[rows, at]) / np.where(own > 0, own, 1.0), 0.0, 1.0)
    return edges[at] + inside * (edges[at + 1] - edges[at])


# -- jackknife ------------------------------------------------------------------------------------

class Bag:
    """Trees fitted on Poisson(1) row weights, and the Gram matrix of those weights."""

    def __init__(self, model: Ensemble, gram: np.ndarray, n: int):
        self.model, self.gram, self.n = model, gram, n


def bag_fit(train: DataFrame, label: str, keys: Sequence[str], trees: int = 50, depth: int = 10,
            min_leaf: int = 1, seed: int = 123, features: str = "features") -> Bag:
    """Bagged trees with known in-bag counts, grown side by side."""
    rows = materialize(train.select(*keys, as_array(train, features).alias(features), label), "bagged")
    gram, n = in_bag_gram(rows.select(bag_uniforms(keys, trees, seed).alias("_n")), trees, uniform=True)
    model = grow_bag(rows, label, trees, lambda first, n: bag_uniforms(keys, n, seed, first),
                     Growth(depth, min_leaf, seed=seed), features=features, uniform=True)
    return Bag(model, gram, n)


def in_bag_gram(weighted: DataFrame, trees: int, uniform: bool = False) -> tuple[np.ndarray, int]:
    """Sum over rows of (N - 1)(N - 1)' / B^2: one B x B matrix per task, added up. With ``uniform`` the column holds the
    numbers that the weights N are drawn from."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((trees, trees)), 0
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column("_n"))
                centred = (poisson_of(own) if uniform else own) - 1.0
                total += centred.T @ centred
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"cell": np.arange(trees * trees + 1, dtype=np.int32),
                                          "v": np.append(total.ravel(), float(n))})

    cells = (weighted.select("_n").mapInArrow(partial, "cell INT, v DOUBLE")
             .groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect())
    values = np.array([c["v"] for c in cells])
    return values[:-1].reshape(trees, trees) / trees ** 2, int(values[-1])


def _estimates(bag: Bag, df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``_e``: the bagged mean, the variance estimate, and the estimates of two halves of the trees."""
    trees = len(bag.model)
    halves = [np.arange(0, trees, 2), np.arange(1, trees, 2)]
    shipped = df.sparkSession.sparkContext.broadcast((Packed(bag.model.trees), bag.gram))
    n = bag.n

    def variance(t: np.ndarray, gram: np.ndarray) -> np.ndarray:
        t = t - t.mean(axis=1, keepdims=True)
        return np.einsum("ib,ib->i", t @ gram, t) - n / t.shape[1] ** 2 * (t ** 2).sum(axis=1)

    @F.arrow_udf("yhat double, variance double, one double, two double")
    def estimate(rows: pa.Array) -> pa.Array:
        packed, gram = shipped.value
        t = tree_outputs(packed, matrix(rows))
        out = {"yhat": t.mean(axis=1), "variance": variance(t, gram)}
        for name, own in zip(("one", "two"), halves):
            if len(own) > 1:
                out[name] = variance(t[:, own], gram[np.ix_(own, own)] * (trees / len(own)) ** 2)
            else:
                out[name] = out["variance"]
        return structs(**out)

    return df.withColumn("_e", estimate(as_array(df, features)))


def fit_prior(centres: np.ndarray, counts: np.ndarray, noise: float, degree: int = 5, uniform: float = 0.1,
              steps: int = 200) -> np.ndarray:
    """Weights on the centres, none below 0, from which the counted values came after normal noise was added.

    The prior is the exponential of a polynomial, with a part spread evenly, fitted by maximum likelihood with Fisher's
    scoring; a small ridge keeps the polynomial where the data say nothing.
    """
    real = centres >= 0
    z = centres / max(centres.max(), 1e-300)
    basis = np.column_stack([z ** k for k in range(1, degree + 1)])
    basis = (basis - basis[real].mean(axis=0)) / np.maximum(basis[real].std(axis=0), 1e-300)
    spread = real / real.sum()
    kernel = np.exp(-0.5 * ((centres[:, None] - centres[None, :]) / noise) ** 2)
    kernel /= np.maximum(kernel.sum(axis=0, keepdims=True), 1e-300)
    share = counts / counts.sum()

    def state(beta):
        raw = np.where(real, np.exp(np.clip(basis @ beta, -500, 500)), 0.0)
        own = raw / raw.sum()
        seen = np.maximum(kernel @ ((1 - uniform) * own + uniform * spread), 1e-300)
        return own, seen, share @ np.log(seen) - 1e-6 * beta @ beta

    beta = np.zeros(degree)
    own, seen, value = state(beta)
    for _ in range(steps):
        slope = (1 - uniform) * kernel @ (own[:, None] * (basis - own @ basis)) / seen[:, None]
        gradient = share @ slope - 2e-6 * beta
        move = np.linalg.solve(slope.T @ (share[:, None] * slope) + 1e-6 * np.eye(degree), gradient)
        scale = 1.0
        while scale > 1e-6:
            new = state(beta + scale * move)
            if new[2] > value:
                break
            scale /= 2
        else:
            break
        gain = new[2] - value
        beta, (own, seen, value) = beta + scale * move, new
        if gain < 1e-12:
            break
    return (1 - uniform) * own + uniform * spread


def posterior_means(centres: np.ndarray, prior: np.ndarray, noise: float) -> np.ndarray:
    """Expected true value behind an observation at each centre."""
    logs = -0.5 * ((centres[:, None] - centres[None, :]) / noise) ** 2 + np.log(np.maximum(prior, 1e-300))[None, :]
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    return (weight @ centres) / weight.sum(axis=1)


def calibration(estimates: DataFrame, bins: int = 200) -> tuple[np.ndarray, np.ndarray] | None:
    """Observed variance -> expected variance on a grid, from columns ``variance``, ``one`` and ``two``.

    The noise of an estimate is taken from its two halves: their difference has four times its variance. The estimates
    are counted on ``bins`` values (two passes); the prior is fitted to the counts on the driver. None where
    there is no noise to take off.
    """
    low, high, sd, noise = estimates.agg(
        F.min("variance"), F.max("variance"), F.stddev_pop("variance"),
        F.sqrt(F.avg((F.col("one") - F.col("two")) * (F.col("one") - F.col("two")))) / 2).first()
    if not noise or not sd:
        return None
    first, last = min(low - 2 * sd, 0.0), max(high + 2 * sd, sd)
    width = (last - first) / (bins - 1)
    noise = max(noise, width)  # finer noise can't be seen on this grid
    place = F.least(F.greatest(F.round((F.col("variance") - first) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = np.zeros(bins)
    for r in estimates.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect():
        counts[r["b"]] = r["n"]
    centres = first + width * np.arange(bins)
    return centres, posterior_means(centres, fit_prior(centres, counts, noise), noise)


def jackknife_interval(bag: Bag, df: DataFrame, level: float = 0.95, calibrate: bool = False,
                       features: str = "features") -> DataFrame:
    """Bagged mean with a normal interval from the infinitesimal jackknife variance.

    V = t' G t with t the centred tree outputs, minus the published Monte Carlo correction
    n / B^2 sum(t^2) for Poisson(1) weights; a negative estimate counts as 0. With ``calibrate`` it is the empirical
    Bayes estimate: the variance expected behind V under a prior that all estimates of the table were fitted with, which
    pulls the noise of few trees out of it and is never negative. The table is then scored twice.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    scored = _estimates(bag, df, features)
    variance = F.greatest("_e.variance", F.lit(0.0))
    found = calibration(_estimates(bag, df, features).select("_e.*")) if calibrate else None
    if found is not None:
        centres, means = found

        @F.pandas_udf("double")
        def calibrated(values: pd.Series) -> pd.Series:
            return pd.Series(np.interp(values, centres, means))

        variance = calibrated("_e.variance")
    out = scored.withColumns({"yhat": F.col("_e.yhat"), "variance": variance})
    half = F.sqrt("variance") * z
    return ordered(out.withColumns({"lower": F.col("yhat") - half, "upper": F.col("yhat") + half}), level).drop("_e")


# -- boosting -------------------------------------------------------------------------------------

def model_interval(df: DataFrame, centre: Ensemble | None, low: Ensemble, high: Ensemble,
                   level: float) -> DataFrame:
    """Bounds from two quantile models, and the centre model's prediction when there is one."""
    out = low.transform(df, "lower")
    out = high.transform(out, "upper")
    if centre is not None:
        out = centre.transform(out, "yhat")
    return ordered(out, level)


def quantile_boost_interval(train: DataFrame, df: DataFrame, label: str, keys: Sequence[str],
                            settings: BoostSettings, centre: Ensemble, alpha: float = 0.95) -> DataFrame:
    """Upper and lower quantile models around a squared-loss model. Bounds at alpha and 1 - alpha
    hold a share of 2 alpha - 1, which is the level in the output."""
    high = quantile_boost_fit(train, label, alpha, settings, keys)
    low = quantile_boost_fit(train, label, 1 - alpha, settings, keys)
    return model_interval(df, centre, low, high, round(2 * alpha - 1, 10))


def smooth_quantile_interval(train: DataFrame, df: DataFrame, label: str, keys: Sequence[str],
                             settings: BoostSettings, alpha: float = 0.95,
                             low_loss: tuple[float, float, float] = (1.0, 5.0, 3.2),
                             high_loss: tuple[float, float, float] = (1.0, 6.0, 4.2)) -> DataFrame:
    """The same with the smoothed loss; losses are (delta, threshold, var), by default the fixed
    values of the published method."""
    low = smooth_quantile_boost(train, label, 1 - alpha, settings, keys, *low_loss)
    high = smooth_quantile_boost(train, label, alpha, settings, keys, *high_loss)
    return model_interval(df, None, low, high, round(2 * alpha - 1, 10))


def reseed_interval(train: DataFrame, df: DataFrame, label: str, keys: Sequence[str], settings: BoostSettings,
                    repeats: int = 20, level: float = 0.95) -> DataFrame:
    """Spread of predictions over refits with different seeds, under the row and column subsampling of the settings.

    All fits are scored in one pass.
    """
    models = [boost_fit(train, label, squared_loss(), replace(settings, seed=settings.seed + r), keys)
              for r in range(repeats)]
    shipped = df.sparkSession.sparkContext.broadcast([(m.base, m.rate, Packed(m.trees)) for m in models])
    ends = [50 * (1 - level), 50 * (1 + level)]

    @F.pandas_udf("lower double, upper double, yhat double")
    def bounds(rows: pd.Series) -> pd.DataFrame:
        x = matrix(rows)
        each = np.stack([base + rate * tree_outputs(packed, x).sum(axis=1) for base, rate, packed in shipped.value])
        low, high = np.percentile(each, ends, axis=0)
        return pd.DataFrame({"lower": low, "upper": high, "yhat": each.mean(axis=0)})

    scored = df.withColumn("_b", bounds(vector_to_array("features")))
    return ordered(scored.withColumns({c: F.col(f"_b.{c}") for c in ("lower", "upper", "yhat")}), level).drop("_b")
