"""Principal components, principal-component regression, regularised linear regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.operators.features import Scaling, fit_scaling, standardize


@dataclass(frozen=True)
class Components:
    """Scaling, loadings (one row per component) and variance ratios."""

    scaling: Scaling
    loadings: np.ndarray
    ratio: np.ndarray


def pca_fit(train: DataFrame, columns: Sequence[str]) -> Components:
    """All components of the standardised columns. The sign of a component is free; it is set so
    that the largest loading is positive."""
    scaling = fit_scaling(train, columns)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(
        standardize(train.select(*columns), scaling))
    model = PCA(k=len(columns), inputCol="_v", outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray().T
    signs = np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])
    return Components(scaling, loadings * signs[:, None], model.explainedVariance.toArray())


def pca_project(df: DataFrame, components: Components, k: int) -> DataFrame:
    """Add the scores ``pc1 .. pck`` as column arithmetic."""
    names = components.scaling.columns
    z = {f"_z_{c}": (F.col(c) - F.lit(m)) / F.lit(s)
         for c, m, s in zip(names, components.scaling.means, components.scaling.sds)}
    scores = {f"pc{i + 1}": reduce(lambda a, b: a + b, [
        F.col(f"_z_{c}") * F.lit(float(w)) for c, w in zip(names, components.loadings[i])])
        for i in range(k)}
    return df.withColumns(z).withColumns(scores).drop(*z)


def variance_table(spark, components: Components) -> DataFrame:
    """``pc, ratio``: one row per component."""
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(components.ratio)],
                                 "pc INT, ratio DOUBLE")


def loading_table(spark, components: Components, k: int = 5) -> DataFrame:
    """Loadings of the first components: one row per variable and component."""
    return spark.createDataFrame(
        [(c, i + 1, float(components.loadings[i, j]))
         for j, c in enumerate(components.scaling.columns) for i in range(k)],
        "variable STRING, pc INT, loading DOUBLE")


def loading_norm_check(loadings: DataFrame) -> DataFrame:
    """Squared loadings of each component add up to 1."""
    return loadings.groupBy("pc").agg(F.sum(F.col("loading") * F.col("loading")).alias("norm"))


def topk_abs_loading(loadings: DataFrame, pc: int = 1, k: int = 10) -> DataFrame:
    """The k variables with the largest absolute loading on one component."""
    return (loadings.where(F.col("pc") == pc)
            .orderBy(F.abs("loading").desc(), "variable").limit(k).select("variable", "loading"))


@dataclass(frozen=True)
class ComponentRegression:
    """Least squares with intercept on the first k scores, with what its intervals need."""

    components: Components
    model: LinearRegressionModel
    k: int
    n: int
    score_variance: tuple[float, ...]
    residual_variance: float


def pcr_fit(train: DataFrame, columns: Sequence[str], label: str, k: int = 10) -> ComponentRegression:
    """Fit components and regression; residual variance on n - k - 1 degrees of freedom."""
    components = pca_fit(train, columns)
    k = min(k, len(columns))
    scores = [f"pc{i + 1}" for i in range(k)]
    scored = VectorAssembler(inputCols=scores, outputCol="_scores").transform(
        pca_project(train, components, k))
    model = LinearRegression(featuresCol="_scores", labelCol=label, predictionCol="yhat",
                             solver="normal", regParam=0.0).fit(scored)
    row = model.transform(scored).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col(label) - F.col("yhat"), F.lit(2.0))).alias("sse"),
        *[F.var_pop(s).alias(s) for s in scores]).first()
    return ComponentRegression(components, model, k, row["n"], tuple(row[s] for s in scores),
                               row["sse"] / (row["n"] - k - 1))


def pcr_predict(df: DataFrame, fit: ComponentRegression) -> DataFrame:
    """Add the scores and ``yhat``."""
    scored = pca_project(df, fit.components, fit.k)
    terms = [F.col(f"pc{i + 1}") * F.lit(float(b)) for i, b in enumerate(fit.model.coefficients)]
    return scored.withColumn("yhat", reduce(lambda a, b: a + b, terms, F.lit(float(fit.model.intercept))))


def student_quantile(p: float, df: int) -> float:
    """Student t quantile by the series around the normal quantile (error below 1e-6 from 30 df)."""
    z = NormalDist().inv_cdf(p)
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    return z + g1 / df + g2 / df ** 2 + g3 / df ** 3 + g4 / df ** 4


def pcr_mean_interval(df: DataFrame, fit: ComponentRegression, level: float = 0.95,
                      kind: str = "mean") -> DataFrame:
    """Interval of the mean response, or of a new value (``kind='prediction'``).

    Scores are orthogonal on the training rows, so the variance is a sum over components.
    """
    if kind not in ("mean", "prediction"):
        raise ValueError("kind is 'mean' or 'prediction'")
    predicted = pcr_predict(df, fit)
    leverage = F.lit(1.0 / fit.n)
    for i, variance in enumerate(fit.score_variance):
        leverage = leverage + F.col(f"pc{i + 1}") * F.col(f"pc{i + 1}") / F.lit(fit.n * variance)
    if kind == "prediction":
        leverage = leverage + 1.0
    quantile = student_quantile(0.5 + level / 2, fit.n - fit.k - 1)
    half = F.sqrt(leverage * fit.residual_variance) * quantile
    return predicted.withColumns({"lower": F.col("yhat") - half, "upper": F.col("yhat") + half,
                                  "interval": F.lit(f"{kind} {level:g}")})


def fold_moments(df: DataFrame, columns: Sequence[str], label: str, fold: str = "fold") -> dict[int, np.ndarray]:
    """Cross-product matrix of ``(1, columns.., label)`` per fold, from one pass.

    Every task adds up its own rows; what travels is one small matrix per task and fold.
    """
    names = [*columns, label]
    width = len(names) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            matrix = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(float)])
            folds = batch[fold].to_numpy()
            for f in np.unique(folds):
                part = matrix[folds == f]
                sums[int(f)] = sums.get(int(f), 0) + part.T @ part
        for f, total in sums.items():
            yield pd.DataFrame({"fold": f, "cell": np.arange(width * width), "v": total.ravel()})

    cells = (df.select(fold, *names).mapInPandas(partial, "fold INT, cell INT, v DOUBLE")
             .groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect())
    result: dict[int, np.ndarray] = {}
    for row in cells:
        result.setdefault(row["fold"], np.zeros(width * width))[row["cell"]] = row["v"]
    return {f: m.reshape(width, width) for f, m in sorted(result.items())}


def pcr_component_cv(df: DataFrame, components: Components, label: str, fold: str = "fold") -> DataFrame:
    """Cross-validated MSE for 0 .. p components: ``components, mse``.

    The table is read once; the regressions are solved from the fold matrices, p + 1 unknowns at most.
    """
    p = len(components.loadings)
    scores = [f"pc{i + 1}" for i in range(p)]
    moments = fold_moments(pca_project(df, components, p), scores, label, fold)
    total = sum(moments.values())
    rows = []
    for k in range(p + 1):
        used = np.arange(k + 1)
        errors = []
        for held_out in moments.values():
            train = total - held_out
            beta = np.linalg.solve(train[np.ix_(used, used)], train[used, -1])
            sse = (held_out[-1, -1] - 2 * beta @ held_out[used, -1]
                   + beta @ held_out[np.ix_(used, used)] @ beta)
            errors.append(sse / held_out[0, 0])
        rows.append((k, float(np.mean(errors))))
    return df.sparkSession.createDataFrame(rows, "components INT, mse DOUBLE")


def split_moments(df: DataFrame, label: str, split: str, features: str) -> dict[str, np.ndarray]:
    """Cross-product matrix of ``(1, features.., label)`` per split, from one pass; one small matrix per task travels."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            if batch.empty:
                continue
            matrix = np.column_stack([np.ones(len(batch)), np.stack(batch["_x"].to_numpy()), batch["_y"].to_numpy(float)])
            for key, at in batch.groupby("_s").indices.items():
                sums[key] = sums.get(key, 0) + matrix[at].T @ matrix[at]
        for key, total in sums.items():
            yield pd.DataFrame({"s": key, "cell": np.arange(total.size), "v": total.ravel()})

    rows = df.select(vector_to_array(features).alias("_x"), F.col(label).cast("double").alias("_y"),
                     F.col(split).alias("_s"))
    cells = rows.mapInPandas(partial, "s string, cell int, v double").groupBy("s", "cell").agg(
        F.sum("v").alias("v")).orderBy("s", "cell").toPandas()
    return {key: part["v"].to_numpy().reshape(int(len(part) ** 0.5), -1) for key, part in cells.groupby("s")}


@dataclass(frozen=True)
class LinearBoost:
    """Bias and weights after the last round, and the RMSE of every split after each."""

    bias: float
    weights: tuple[float, ...]
    log: tuple[tuple[int, str, float], ...]

    def transform(self, df: DataFrame, name: str = "yhat", features: str = "features") -> DataFrame:
        products = F.zip_with(vector_to_array(features), F.array(*[F.lit(float(w)) for w in self.weights]),
                              lambda x, w: x * w)
        return df.withColumn(name, F.aggregate(products, F.lit(float(self.bias)), lambda a, v: a + v))

    def eval_log(self, spark: SparkSession) -> DataFrame:
        """``round, split, rmse``."""
        return spark.createDataFrame(list(self.log), "round INT, split STRING, rmse DOUBLE")


def linear_boost_fit(train: DataFrame, label: str, rounds: int = 100, rate: float = 0.5, l2: float = 0.0,
                     l1: float = 0.0, base: float = 0.5, split: str | None = None, features: str = "features") -> LinearBoost:
    """Linear learner under squared loss by rounds: the bias, then every weight in turn takes a step of ``rate`` towards
    the minimum along its coordinate, with penalties per row.

    Gradient and curvature along a coordinate are linear in the cross products of the training rows, so the data is read
    once whatever the number of rounds, and the errors of each round are exact. Fitted on the rows with
    ``split = 'train'`` (all rows without a split column).
    """
    df = train if split else train.withColumn("_split", F.lit("train"))
    moments = split_moments(df, label, split or "_split", features)
    m = moments["train"]
    n = m[0, 0]
    beta = np.zeros(len(m) - 1)
    beta[0] = base
    state = np.append(beta, -1.0)  # prediction minus label, as a combination of the columns
    log = []
    for number in range(rounds):
        state[0] -= rate * (m[0] @ state) / n
        for j in range(1, len(m) - 1):
            w = state[j]
            g, h = m[j] @ state + l2 * n * w, m[j, j] + l2 * n
            if h <= 0:
                continue
            if w - g / h >= 0:
                step = max(-(g + l1 * n) / h, -w)
            else:
                step = min(-(g - l1 * n) / h, -w)
            state[j] += rate * step
        log += [(number + 1, key, float(np.sqrt(max(state @ own @ state, 0.0) / own[0, 0]))) for key, own in moments.items()]
    return LinearBoost(float(state[0]), tuple(float(v) for v in state[1:-1]), tuple(log))
