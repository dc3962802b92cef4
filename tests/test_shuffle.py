"""Row numbers and keyed permutations, keys on any lattice, linear boosting by rounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import features, keys, linear, split


def test_the_permutation_is_a_bijection():
    for n in range(1, 1001):
        assert np.array_equal(np.sort(split.feistel(np.arange(n), n, n % 7)), np.arange(n))
    assert len(split.feistel(np.arange(0), 1, 3)) == 0
    large = split.feistel(np.arange(200_000), 2 ** 40 + 17, 5)
    assert len(np.unique(large)) == 200_000 and large.max() < 2 ** 40 + 17 and large.min() >= 0


def test_the_permutation_is_spread():
    n = 4000
    one, two = (split.feistel(np.arange(n), n, s) for s in (1, 2))
    assert (one == np.arange(n)).sum() < 8 and (one == two).sum() < 8
    assert abs(np.corrcoef(np.arange(n), one)[0, 1]) < 0.08
    # Neighbours do not stay together.
    assert (np.abs(np.diff(one)) <= 2).mean() < 0.01


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(1003).repartition(7).where("id % 5 <> 0")
    rows, n = split.numbered(df)
    assert sorted(r["_row"] for r in rows.collect()) == list(range(n)) and n == df.count()
    empty, none = split.numbered(df.limit(0))
    assert none == 0 and empty.count() == 0


def test_permuted_column(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("x").alias("_keep")).repartition(5)
    out = split.permute_column(df, ["k"], "v")
    rows = out.collect()
    assert out.columns == df.columns and sorted(r["v"] for r in rows) == [2 * i for i in range(1003)]
    assert sorted(r["k"] for r in rows) == list(range(1003)) and sum(r["v"] == 2 * r["k"] for r in rows) < 20
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortAggregate", "") and "Window" not in plan
    assert split.permute_column(df.limit(0), ["k"], "v").count() == 0


@pytest.mark.parametrize("dx, dy", [(0.0, 0.0), (1.25, 2.5), (2.5, 2.5), (-2.5, 1e6 + 2.5)])
@pytest.mark.parametrize("noise", [1e-12, -1e-12])
def test_keys_on_any_lattice(spark, dx, dy, noise):
    """Centres at half or quarter cells, with noise both ways on either side."""
    points = [(dx + 5.0 * i, dy + 5.0 * j) for i in range(4) for j in range(3)]
    a = spark.createDataFrame([(x + (noise if i % 2 else 0.0), y) for i, (x, y) in enumerate(points)], "x DOUBLE, y DOUBLE")
    b = spark.createDataFrame([(x - (0.0 if i % 2 else noise / 2), y, i) for i, (x, y) in enumerate(points)],
                              "x DOUBLE, y DOUBLE, grid_id INT")
    assert keys.align_grid(a, b).count() == 12 and keys.align_grid(a, b).select("grid_id").distinct().count() == 12
    assert keys.coord_match_check(a, b).first()["matched"] and keys.coord_match_check(b, a).first()["matched"]
    check = keys.coord_tolerance_check(a, b).first()
    assert check["within"] and (check["n"], check["left_unmatched"], check["right_unmatched"]) == (12, 0, 0)
    lost = keys.coord_tolerance_check(a, b.where("grid_id > 1")).first()
    assert not lost["within"] and (lost["n"], lost["left_unmatched"]) == (10, 2)
    extra = keys.coord_tolerance_check(a.limit(11), b).first()
    assert not extra["within"] and extra["right_unmatched"] == 1


def test_origin_of_odd_tables(spark):
    schema = "x DOUBLE, y DOUBLE"
    assert keys.lattice_origin(spark.createDataFrame([], schema)) == (0.0, 0.0)
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (7.0, -1.0)], schema)
    assert keys.lattice_origin(odd) == (2.0, 4.0)
    check = keys.coord_tolerance_check(odd, odd).first()
    assert (check["n"], check["left_unmatched"], check["right_unmatched"], check["within"]) == (1, 2, 2, False)


@pytest.mark.parametrize("l1, l2", [(0.0, 0.0), (0.0, 0.05), (0.02, 0.01)])
def test_linear_rounds_equal_a_loop_over_rows(spark, l1, l2):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x[:, 3] = 0.0
    y = 0.3 + x @ np.array([0.5, -0.2, 0.01, 0.0]) + rng.normal(0, 0.05, 300)
    df = spark.createDataFrame([(*map(float, r), float(v), "train" if i < 200 else "valid")
                                for i, (r, v) in enumerate(zip(x, y))], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, y DOUBLE, split STRING")
    df = features.feature_pipeline(df, ["a", "b", "c", "d"]).transform(df)
    model = linear.linear_boost_fit(df, "y", rounds=100, l1=l1, l2=l2, split="split")
    xt, yt = x[:200], y[:200]
    bias, w, log = 0.5, np.zeros(4), []
    for _ in range(100):
        bias -= 0.5 * (bias + xt @ w - yt).mean()
        for j in range(4):
            g = xt[:, j] @ (bias + xt @ w - yt) + l2 * 200 * w[j]
            h = xt[:, j] @ xt[:, j] + l2 * 200
            if h > 0:
                new = w[j] - g / h
                new = max(new - l1 * 200 / h, 0.0) if new >= 0 else min(new + l1 * 200 / h, 0.0)
                w[j] += 0.5 * (new - w[j])
        log.append([np.sqrt(((bias + x[s] @ w - y[s]) ** 2).mean()) for s in (slice(0, 200), slice(200, None))])
    assert np.isclose(model.bias, bias) and np.allclose(model.weights, w)
    got = {(n, s): e for n, s, e in model.log}
    assert np.allclose([[got[i + 1, s] for s in ("train", "valid")] for i in range(100)], log)
    if l1 == l2 == 0:
        assert np.allclose(model.weights[:3], np.linalg.lstsq(np.column_stack([np.ones(200), xt[:, :3]]), yt, rcond=None)[0][1:])
    assert np.isclose(model.transform(df).where("split = 'valid'").select(
        F.sqrt(F.avg((F.col("yhat") - F.col("y")) ** 2))).first()[0], log[-1][1])
