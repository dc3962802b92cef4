"""Study pixels -> split, features, fitted forest, report tables and predictions with bounds."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import inverse_link, link
from riskgrid.operators import aggregates, explain, features, forest, intervals, keys, quality, split
from riskgrid.operators.packed import Ensemble
from riskgrid.roles import STUDY, Roles
from riskgrid.sources.workdir import materialize

TARGET = "_target"


@dataclass(frozen=True)
class Prepared:
    """Complete pixels with split and feature vector, the fitted encoding, and the report on gaps."""

    table: DataFrame
    pipeline: PipelineModel
    names: tuple[str, ...]
    na: DataFrame


@dataclass(frozen=True)
class ForestRun:
    """What a forest run reports and predicts."""

    model: Ensemble
    errors: DataFrame
    importance: DataFrame
    top: DataFrame
    test: DataFrame
    endemic: DataFrame


def prepare(pixels: DataFrame, grid: DataFrame, roles: Roles = STUDY, kind: str = "full", min_rows: int = 100,
            seed: int = 5, res: float = 5.0) -> Prepared:
    """Check coordinates, split by grid group, drop incomplete pixels, build feature vectors.

    The table is written once, spread evenly by pixel, since fitting reads it many times.
    """
    if not keys.coord_match_check(pixels, grid, res).first()["matched"]:
        raise ValueError("coordinates of pixels and grid do not match")
    columns = roles.features(kind)
    grouped = split.group_split(grid, roles.group, min_rows, seed=seed)
    df = keys.attach_by_pixel(pixels, grouped, [roles.group, "split"], res)
    needed = [*columns, roles.label]
    na = quality.na_report(df, "split", needed)
    table = materialize(quality.drop_na_rows(df, needed), "prepared", spread=roles.key)
    category = [c for c in columns if c in roles.category]
    numeric = [c for c in columns if c not in roles.category]
    pipeline = features.feature_pipeline(table, numeric, category)
    return Prepared(pipeline.transform(table), pipeline, (*numeric, *[f"{c}_code" for c in category]), na)


def forest_run(prepared: Prepared, endemic: DataFrame, roles: Roles = STUDY, parameters: dict | None = None,
               level: float = 0.95, link_kind: str = "identity") -> ForestRun:
    """Fit on the train split, report errors and importances, predict test and endemic pixels.

    With a link the label is transformed before the fit and every output is transformed back.
    """
    kind = link_kind
    spark = prepared.table.sparkSession
    table = prepared.table.withColumn(TARGET, link(F.col(roles.label), kind))
    started = time.perf_counter()
    model = forest.rf_fit(table.where("split = 'train'"), TARGET, **(parameters or forest.FOREST_PARAMETERS))
    seconds = round(time.perf_counter() - started, 5)
    scored = model.transform(table).withColumn("yhat", inverse_link(F.col("yhat"), kind))
    error = aggregates.squared_error(roles.label, "yhat")
    errors = scored.agg(
        F.avg(F.when(F.col("split") == "train", error)).alias("mse_train"),
        F.avg(F.when(F.col("split") == "test", error)).alias("mse_test"),
        F.lit(seconds).alias("time_train"))
    importance = explain.order_importance(explain.impurity_importance(spark, model, prepared.names))
    complete = quality.drop_na_rows(endemic, [c for c in roles.features() if c in endemic.columns])
    return ForestRun(
        model, errors, importance, explain.topk_features(importance),
        _bounded(model, table.where("split = 'test'"), [*roles.key, roles.label], kind, level)
        .withColumnRenamed(roles.label, "actual"),
        _bounded(model, prepared.pipeline.transform(complete), list(roles.key), kind, level))


def _bounded(model: Ensemble, df: DataFrame, columns: list[str], kind: str,
             level: float) -> DataFrame:
    out = intervals.forest_percentile_interval(model, df, level)
    return out.select(*columns, inverse_link(F.col("yhat"), kind).alias("predict"),
                      inverse_link(F.col("lower"), kind).alias("lower"),
                      inverse_link(F.col("upper"), kind).alias("upper"))
