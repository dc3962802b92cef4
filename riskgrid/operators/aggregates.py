"""Grouped sums, error measures, descriptive statistics, histograms and box statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.operators.quantiles import exact_quantiles
from riskgrid.operators.sizes import lookup_join


def group_freq(df: DataFrame, group: str = "grid_id") -> DataFrame:
    """Pixels per grid group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def country_sum(df: DataFrame, value: str = "cases", code: str = "code") -> DataFrame:
    """Total per country. Partial sums run before the shuffle, so a large country is no bottleneck."""
    return df.groupBy(code).agg(F.sum(value).alias(value))


def draw_mean(df: DataFrame, value: str = "cases", by: Sequence[str] = ("code",)) -> DataFrame:
    """Mean over posterior draws."""
    return df.groupBy(*by).agg(F.avg(value).alias(value))


def year_slice(df: DataFrame, year: int | None = None) -> DataFrame:
    """Rows of one year; the last year of the table by default."""
    if year is None:
        year = df.agg(F.max("year")).first()[0]
    return df.where(F.col("year") == F.lit(year))


def method_mean(df: DataFrame, value: str = "value") -> DataFrame:
    """Mean per country and method."""
    return df.groupBy("code", "method").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def row_total(df: DataFrame, keys: Sequence[str] = ("x", "y"), value: str = "cases") -> DataFrame:
    """Sum over the ages of each pixel, from the long table."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total"))


# -- errors ---------------------------------------------------------------------------------------

def squared_error(y: str, yhat: str) -> Column:
    return F.pow(F.col(y) - F.col(yhat), F.lit(2.0))


def mse(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error."""
    return df.groupBy(*by).agg(F.avg(squared_error(y, yhat)).alias("mse"))


def rmse(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(squared_error(y, yhat))).alias("rmse"))


def r_squared(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """1 - mse / population variance of y."""
    both = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    spread = F.var_pop(F.when(both, F.col(y)))
    return df.groupBy(*by).agg(
        (1 - F.avg(squared_error(y, yhat)) / F.nullif(spread, F.lit(0.0))).alias("r2"))


def pinball_cost(x: Column, alpha: float) -> Column:
    """Quantile cost of a residual: (alpha - 1) x below zero, alpha x otherwise."""
    return F.when(x < 0, (alpha - 1) * x).otherwise(alpha * x)


def pinball_score(df: DataFrame, alpha: float, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Sum of the quantile cost and its inverse, which grows with the quality of the fit."""
    cost = F.sum(pinball_cost(F.col(y) - F.col(yhat), alpha))
    return df.agg(cost.alias("cost")).withColumn("score", 1 / F.nullif(F.col("cost"), F.lit(0.0)))


# -- description ----------------------------------------------------------------------------------

def long_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell of the chosen columns: ``keep.., variable, value``."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.variable", "_c.value")


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample sd, minimum, exact quartiles and maximum per column."""
    cells = long_columns(df, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    moments = cells.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(cells, "value", (0.25, 0.5, 0.75), by=["variable"])
    return moments.join(quartiles, "variable").select(
        "variable", "count", "mean", "std", "min", F.col("q0").alias("q25"),
        F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair a < b as rows ``a, b, r``, over the rows that have both.
    A constant column has no correlation (NULL).

    Every task adds up its rows around the column means; what travels is a few p x p matrices per
    task, so the number of pairs does not matter.
    """
    names = sorted(columns)
    p = len(names)
    doubles = [F.col(c).cast("double").alias(c) for c in names]
    means = df.select(*doubles).agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c)
                                      for c in names]).first()
    centre = np.array([0.0 if means[c] is None else means[c] for c in names])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch[names].to_numpy(float) - centre
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
        yield pd.DataFrame({"cell": np.arange(4 * p * p), "v": total.ravel()})

    cells = (df.select(*doubles).mapInPandas(partial, "cell INT, v DOUBLE")
             .groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect())
    n, sx, sxx, sxy = np.array([c["v"] for c in cells] or np.zeros(4 * p * p)).reshape(4, p, p)
    rows = []
    for i, j in combinations(range(p), 2):
        r = None
        if n[i, j] > 1:
            vi = sxx[i, j] - sx[i, j] ** 2 / n[i, j]
            vj = sxx[j, i] - sx[j, i] ** 2 / n[i, j]
            if vi > 1e-12 * sxx[i, j] and vj > 1e-12 * sxx[j, i]:
                r = float((sxy[i, j] - sx[i, j] * sx[j, i] / n[i, j]) / math.sqrt(vi * vj))
        rows.append((names[i], names[j], r))
    return df.sparkSession.createDataFrame(rows, "a STRING, b STRING, r DOUBLE")


def histogram_auto(df: DataFrame, column: str) -> DataFrame:
    """Counts over equal-width bins; the width is the smaller of the Sturges and the
    Freedman-Diaconis width (the latter only when the quartiles differ). The last bin is closed."""
    stats = exact_quantiles(df, column, (0.0, 0.25, 0.75, 1.0)).first()
    if stats is None:
        return df.sparkSession.createDataFrame([], "bin INT, lower DOUBLE, upper DOUBLE, n BIGINT")
    n, low, q1, q3, high = stats["n"], stats["q0"], stats["q1"], stats["q2"], stats["q3"]
    bins, low, high = _auto_bins(n, low, q1, q3, high)
    width = (high - low) / bins
    value = F.col(column)
    number = F.least(F.lit(bins - 1), F.floor((value - F.lit(low)) / F.lit(width)).cast("int"))
    counted = (df.where(value.isNotNull() & ~F.isnan(value.cast("double")))
               .groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"))


def _auto_bins(n: int, low: float, q1: float, q3: float, high: float) -> tuple[int, float, float]:
    if high == low:
        return 1, low - 0.5, high + 0.5
    sturges = (high - low) / (math.log2(n) + 1)
    freedman = 2 * (q3 - q1) / n ** (1 / 3)
    width = min(sturges, freedman) if freedman > 0 else sturges
    return max(1, math.ceil((high - low) / width)), low, high


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR of the box) and outlier count per group."""
    box = exact_quantiles(df, value, (0.25, 0.5, 0.75), by=by)
    fences = box.select(*by, "q0", "q1", "q2",
                        (F.col("q0") - 1.5 * (F.col("q2") - F.col("q0"))).alias("_lo"),
                        (F.col("q2") + 1.5 * (F.col("q2") - F.col("q0"))).alias("_hi"))
    v = F.col(value)
    joined = lookup_join(df.where(v.isNotNull() & ~F.isnan(v.cast("double"))), fences, by, "inner")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("q0").alias("q25"), F.max("q1").alias("median"),
        F.max("q2").alias("q75"), F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def density_curve(df: DataFrame, value: str, by: Sequence[str], points: int = 64,
                  cut: float = 0.0) -> DataFrame:
    """Gaussian density estimate per group on ``points`` places between minimum and maximum.

    Values are split linearly between their two neighbouring places first, so the kernel runs over
    at most ``points`` weights per group. Bandwidth 0.9 min(sd, IQR / 1.34) n^(-1/5); ``cut`` widens
    the range by that many bandwidths.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, value)
    moments = rows.groupBy(*by).agg(F.stddev_samp(value).alias("_sd"), F.min(value).alias("_min"),
                                    F.max(value).alias("_max"))
    box = exact_quantiles(rows, value, (0.25, 0.75), by=by)
    iqr = (F.col("q1") - F.col("q0")) / 1.34
    spread = F.when(F.least("_sd", iqr) > 0, F.least("_sd", iqr)).when(F.col("_sd") > 0, F.col("_sd"))
    frame = (moments.join(box, by)
             .withColumn("bandwidth", 0.9 * F.coalesce(spread, F.lit(1.0)) * F.pow("n", F.lit(-0.2)))
             .withColumn("_a", F.col("_min") - cut * F.col("bandwidth"))
             .withColumn("_step", (F.col("_max") - F.col("_min") + 2 * cut * F.col("bandwidth"))
                         / (points - 1))
             .select(*by, "n", "bandwidth", "_a", "_step"))
    placed = lookup_join(rows, frame, by, "inner")
    position = F.coalesce((F.col(value) - F.col("_a")) / F.nullif(F.col("_step"), F.lit(0.0)), F.lit(0.0))
    left = F.least(F.floor(position).cast("int"), F.lit(points - 2))
    halves = F.array(F.struct(left.alias("place"), (1 - (position - left)).alias("w")),
                     F.struct((left + 1).alias("place"), (position - left).alias("w")))
    weights = (placed.select(*by, F.explode(halves).alias("_h"))
               .groupBy(*by, "_h.place").agg(F.sum("_h.w").alias("w")))
    packed = weights.groupBy(*by).agg(  # at most `points` entries per group
        F.collect_list(F.struct("place", "w")).alias("_ws"))
    at = frame.join(packed, by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    kernel = F.aggregate(
        "_ws", F.lit(0.0),
        lambda acc, s: acc + s["w"] * F.exp(
            -0.5 * F.pow((F.col("point") - s["place"]) * F.col("_step") / F.col("bandwidth"), F.lit(2.0))))
    scale = F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    return at.select(*by, "point", (F.col("_a") + F.col("point") * F.col("_step")).alias("at"),
                     (kernel / scale).alias("density"), "bandwidth")


def interval_summary(df: DataFrame, bins: int = 10, y_max: float = 0.5, y: str = "y",
                     lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Per bin of the actual value: rows, share inside the interval, mean width."""
    inside = F.col(y).between(F.col(lower), F.col(upper)).cast("int")
    number = F.least(F.lit(bins - 1), F.floor(F.col(y) / F.lit(y_max / bins)).cast("int"))
    return (df.where(F.col(y).isNotNull()).groupBy(number.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"),
                 F.avg(F.col(upper) - F.col(lower)).alias("mean_width")))


def sort_by_actual(df: DataFrame, y: str = "y", key: Sequence[str] = ("x", "y")) -> DataFrame:
    """Predictions in order of the actual value: a range-partitioned sort, meant as the last step."""
    return df.orderBy(y, *key)


def scatter_table(df: DataFrame, columns: Sequence[str], y: str, bins: int = 20) -> DataFrame:
    """Feature against label as bins: mean label and rows per bin of every feature.

    The table behind one scatter chart per feature; ranges of all features come from one pass.
    """
    ranges = df.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(c)
                      for c in columns]).first()
    cells = long_columns(df, columns, [y]).where(F.col("value").isNotNull() & F.col(y).isNotNull())
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for c in columns:
        low = F.when(F.col("variable") == c, F.lit(ranges[c][0])).otherwise(low)
        high = F.when(F.col("variable") == c, F.lit(ranges[c][1])).otherwise(high)
    position = (F.col("value") - low) / F.nullif(high - low, F.lit(0.0)) * bins
    number = F.least(F.lit(bins - 1), F.floor(F.coalesce(position, F.lit(0.0))).cast("int"))
    return cells.groupBy("variable", number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.avg(y).alias("mean_label"))


# -- ordered tables -------------------------------------------------------------------------------

def rank_bands(df: DataFrame, value: str, cuts: Sequence[int], labels: Sequence[str] | None = None,
               code: str = "code") -> DataFrame:
    """Rank countries by value and cut the ranks into bands; ``cuts`` are the last rank of each band.

    The input has one row per country, so the ordering window is over a few dozen rows.
    """
    labels = labels or [str(i + 1) for i in range(len(cuts))]
    ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(value, code)))
    band = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))[:-1]):
        band = F.when(F.col("rank") <= cut, F.lit(label)).otherwise(band)
    return ranked.withColumn("band", band)


def running_share(df: DataFrame, value: str, order: Column, name: str = "cumulative") -> DataFrame:
    """Running sum over a small ordered table (components or features)."""
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(window))


def split_gain_scan(df: DataFrame, feature_bins: Mapping[str, Column], gradient: Column,
                    hessian: Column, l2: float = 1.0) -> DataFrame:
    """Gain of cutting before each bin, from prefix sums of gradient and hessian.

    Rows are first summed to one line per (feature, bin); the window runs over those.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), number.cast("int").alias("bin"))
                      for name, number in feature_bins.items()])
    summed = (df.select(gradient.alias("g"), hessian.alias("h"), F.explode(cells).alias("_c"))
              .select("g", "h", "_c.feature", "_c.bin")
              .groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
    lower = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    gl, hl = F.coalesce(F.sum("g").over(lower), F.lit(0.0)), F.coalesce(F.sum("h").over(lower), F.lit(0.0))
    sums = summed.select("feature", "bin", gl.alias("gl"), hl.alias("hl"),
                         F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"))

    def score(g: Column, h: Column) -> Column:
        return g * g / (h + l2)

    gain = (score(F.col("gl"), F.col("hl")) + score(F.col("g") - F.col("gl"), F.col("h") - F.col("hl"))
            - score(F.col("g"), F.col("h")))
    return sums.select("feature", "bin", gain.alias("gain"))
