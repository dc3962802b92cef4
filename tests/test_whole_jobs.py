"""Queries on models run with the parameters of the published job, not with a part of its rounds or trees."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import boost, forest
from riskgrid.sources import workdir
from workload import models


@pytest.fixture()
def prepared(spark, monkeypatch):
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=3).tolist(), float(random.random()), ("train", "test", "validate")[i % 3])
            for i in range(90)]
    df = spark.createDataFrame(rows, "pixel_id bigint, inputs array<double>, label double, split string")
    monkeypatch.setattr(models, "prepared", lambda spark, sf_dir: df)
    return df


def test_rf_fit_grows_the_forest_of_the_full_runs(spark, prepared, monkeypatch):
    grown = []
    whole = forest.rf_fit

    def recorded(train, label, **parameters):
        grown.append({k: v for k, v in parameters.items() if k != "features"})
        return whole(train, label, **{**parameters, "trees": 2})

    monkeypatch.setattr(models.forest, "rf_fit", recorded)
    assert models.rf_fit(spark, "").count() == 3
    assert grown == [{"trees": 180, "min_leaf": 1, "subset": "sqrt", "depth": 40}]


def test_round_cv_goes_to_fifteen_rounds(spark, prepared, monkeypatch):
    asked = []
    monkeypatch.setattr(models.boost, "round_cv", lambda df, label, rounds, settings, keys: asked.append((rounds, settings.depth)))
    models.round_cv(spark, "")
    assert asked == [([5, 10, 15], 3)]


def test_smooth_quantile_interval_runs_all_rounds(spark, prepared, monkeypatch):
    asked = []

    def recorded(train, df, label, keys, settings):
        asked.append((settings.rounds, settings.depth, settings.rate))
        return df.withColumns({c: F.lit(0.0) for c in ("lower", "upper", "level")})

    monkeypatch.setattr(models.intervals, "smooth_quantile_interval", recorded)
    models.smooth_quantile_interval(spark, "")
    assert asked == [(400, 8, 0.01)]


def test_superseded_states_of_boosting_are_removed(spark, prepared, monkeypatch):
    settings = boost.BoostSettings(rounds=4, depth=2, rate=0.3)
    df = prepared.withColumnRenamed("inputs", "features")
    plain = boost.newton_boost_fit(df, "label", settings, ["pixel_id"], split="split")
    paths = []
    place = workdir.shared_path

    def recorded(spark, name):
        paths.append(place(spark, name))
        return paths[-1]

    monkeypatch.setattr(boost, "shared_path", recorded)
    monkeypatch.setattr(boost, "CHECKPOINT_EVERY", 1)
    often = boost.newton_boost_fit(df, "label", settings, ["pixel_id"], split="split")
    assert len(plain.log) == 12 and [r[:2] for r in often.log] == [r[:2] for r in plain.log]
    assert np.allclose([r[2] for r in often.log], [r[2] for r in plain.log], rtol=1e-12)
    assert [Path(p.removeprefix("file:")).exists() for p in paths] == [False] * 4 + [True]
