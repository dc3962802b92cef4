"""Models, intervals and explanations against direct numpy computations."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskgrid.functions import hash_uniform, poisson_one
from riskgrid.operators import boost, explain, features, forest, intervals, linear, split, trees, tuning
from riskgrid.operators import aggregates as agg
from riskgrid.operators.growing import Growth
from riskgrid.operators.packed import Ensemble

COLUMNS = ["a", "b", "c"]
N = 900


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 1, (N, 3))
    x[:, 2] = 0.7 * x[:, 0] + 0.3 * x[:, 2]
    y = np.where(x[:, 0] > 0.5, 0.3, 0.1) + 0.1 * x[:, 1] + rng.normal(0, 0.02, N)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    df = spark.createDataFrame([(i, *map(float, r), float(v), "train" if i < 700 else "valid")
                                for i, (r, v) in enumerate(zip(x, y))],
                               "k INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE, split STRING").repartition(4)
    return features.feature_pipeline(df, COLUMNS).transform(df).persist()


def column(df, *names):
    return np.array([[r[n] for n in names] for r in df.orderBy("k").collect()]).squeeze()


def test_components_and_regression(spark, data, table):
    x, y = data
    components = linear.pca_fit(table, COLUMNS)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = values.argsort()[::-1]
    assert np.allclose(components.ratio, values[order] / values.sum())
    assert np.allclose(np.abs(components.loadings), np.abs(vectors[:, order].T))
    assert np.allclose(components.loadings @ components.loadings.T, np.eye(3))
    norms = linear.loading_norm_check(linear.loading_table(spark, components, 3)).collect()
    assert all(math.isclose(r["norm"], 1.0) for r in norms)
    scores = z @ components.loadings.T
    assert np.allclose(column(linear.pca_project(table, components, 3), "pc1", "pc2", "pc3"), scores)

    fit = linear.pcr_fit(table, COLUMNS, "y", k=2)
    design = np.column_stack([np.ones(N), scores[:, :2]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    yhat = design @ beta
    s2 = ((y - yhat) ** 2).sum() / (N - 3)
    for kind, extra in (("mean", 0.0), ("prediction", 1.0)):
        out = linear.pcr_mean_interval(table, fit, kind=kind)
        got = column(out, "yhat", "lower", "upper")
        half = 1.962612 * np.sqrt(s2 * (extra + np.einsum(
            "ij,jk,ik->i", design, np.linalg.inv(design.T @ design), design)))
        assert np.allclose(got[:, 0], yhat, atol=1e-8)
        assert np.allclose(got[:, 2] - got[:, 0], half, rtol=1e-4)


def test_student_quantile():
    # Table values of the 97.5% quantile.
    for df, want in ((30, 2.042272), (60, 2.000298), (120, 1.979930)):
        assert abs(linear.student_quantile(0.975, df) - want) < 5e-6


def test_component_cv_equals_refits(data, table):
    x, y = data
    folded = split.kfold_assign(table, ["k"], 5).persist()
    components = linear.pca_fit(table, COLUMNS)
    got = [r["mse"] for r in linear.pcr_component_cv(folded, components, "y").orderBy("components").collect()]
    fold = column(folded, "fold")
    scores = ((x - x.mean(0)) / x.std(0)) @ components.loadings.T
    for k in range(4):
        design = np.column_stack([np.ones(N), scores[:, :k]])
        errors = []
        for f in range(5):
            beta, *_ = np.linalg.lstsq(design[fold != f], y[fold != f], rcond=None)
            errors.append(((y[fold == f] - design[fold == f] @ beta) ** 2).mean())
        assert math.isclose(got[k], np.mean(errors), rel_tol=1e-8)


def test_category_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a")], "k INT, UR STRING")
    assert list(column(features.encode_category(df, ["UR"]), "UR_code")) == [1.0, 0.0, 2.0, 0.0]
    indexer = features.category_indexer(["UR"]).fit(df)
    new = spark.createDataFrame([(1, "zzz")], "k INT, UR STRING")
    assert indexer.transform(new).first()["UR_code"] == 3.0


def test_scaling_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    rows = features.standardize(df, features.fit_scaling(df, ["a", "b"])).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def grown(table):
    return forest.rf_fit(table.where("split = 'train'"), "y", trees=8, depth=5, subset="onethird")


def test_tree_outputs_average_to_the_forest(table, grown):
    out = trees.tree_predictions(grown, grown.transform(table))
    per_tree, yhat = column(out, "tree_predictions"), column(out, "yhat")
    assert per_tree.shape == (N, 8) and np.allclose(per_tree.mean(axis=1), yhat)
    bounds = column(intervals.forest_percentile_interval(grown, table), "lower", "upper")
    assert np.allclose(bounds.T, np.percentile(per_tree, [2.5, 97.5], axis=1))


def test_error_by_trees(data, table, grown):
    _, y = data
    per_tree = column(trees.tree_predictions(grown, table), "tree_predictions")
    got = {(r["split"], r["trees"]): r["mse"] for r in
           forest.mse_by_trees(grown, table, "y", [1, 3, 8]).collect()}
    for name, rows in (("train", slice(0, 700)), ("valid", slice(700, None))):
        for s in (1, 3, 8):
            want = ((y[rows] - per_tree[rows, :s].mean(axis=1)) ** 2).mean()
            assert math.isclose(got[(name, s)], want, rel_tol=1e-9)


def test_leaf_quantiles(data, table, grown):
    """Exact bounds equal numpy's weighted percentiles; the binned ways agree and lie within a bin of them."""
    _, y = data
    train = table.where("split = 'train'")
    exact = column(intervals.leaf_quantile_interval(grown, train, table, "y", ["k"]), "lower", "upper")
    one = column(intervals.leaf_quantile_interval(grown, train, table, "y", ["k"], bins=100, exact_responses=0),
                 "lower", "upper")
    two = column(intervals.leaf_quantile_interval(grown, train, table, "y", ["k"], bins=100, in_memory_cells=0,
                                                  exact_responses=0), "lower", "upper")
    assert np.allclose(one, two)
    edges = np.quantile(y[:700], np.linspace(0, 1, 101))
    leaves = column(trees.leaf_numbers(grown, table), "_leaf")
    for row in range(0, N, 9):
        same = leaves[:700] == leaves[row]
        weight = (same / np.maximum(same.sum(axis=0), 1)).sum(axis=1) / (same.sum(axis=0) > 0).sum()
        # A share that the weights reach exactly may be missed by a rounding, so both neighbours count.
        below, want = (np.percentile(y[:700][weight > 0], [2.5 + d, 97.5 + d], weights=weight[weight > 0],
                                     method="inverted_cdf") for d in (-1e-6, 1e-6))
        assert (np.isclose(exact[row], want) | np.isclose(exact[row], below)).all()
        at = np.clip(np.searchsorted(edges, want, side="left"), 1, 100)
        assert (one[row] >= edges[at - 1] - 1e-9).all() and (one[row] <= edges[np.minimum(at + 1, 100)] + 1e-9).all()


def test_poisson_weights(spark):
    counts = spark.range(20000).select(poisson_one(hash_uniform(["id"], 3)).alias("n"))
    row = counts.agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(row[0] - 1) < 0.03 and abs(row[1] - 1) < 0.05


def test_jackknife_equals_the_row_sum(data, table):
    train = table.where("split = 'train'")
    bag = intervals.bag_fit(train, "y", ["k"], trees=6, depth=3)
    weights = column(train.select("k", forest.bag_weights(["k"], 6, 123).alias("n")), "n") - 1
    assert bag.n == 700 and np.allclose(bag.gram, weights.T @ weights / 36)
    out = column(intervals.jackknife_interval(bag, table), "yhat", "variance", "lower", "upper")
    t = column(bag.model.outputs(table, "t"), "t")
    assert t.shape == (N, 6)
    centred = t - t.mean(axis=1, keepdims=True)
    covariance = centred @ weights.T / 6
    want = np.maximum((covariance ** 2).sum(axis=1) - 700 / 36 * (centred ** 2).sum(axis=1), 0)
    assert np.allclose(out[:, 0], t.mean(axis=1)) and np.allclose(out[:, 1], want)
    assert np.allclose(out[:, 3] - out[:, 0], 1.959964 * np.sqrt(want), atol=1e-6)


def test_deconvolution_finds_the_prior():
    """Estimates of known variances with known noise: closer to the truth than they were, and never negative."""
    rng = np.random.default_rng(8)
    truth = rng.gamma(4.0, 0.25, 20_000)
    seen = truth + rng.normal(0, 0.6, len(truth))
    centres = np.linspace(min(seen.min(), 0) - 1, seen.max() + 1, 200)
    width = centres[1] - centres[0]
    counts = np.bincount(np.round((seen - centres[0]) / width).astype(int), minlength=200).astype(float)
    prior = intervals.fit_prior(centres, counts, 0.6)
    assert math.isclose(prior.sum(), 1.0) and (prior[centres < 0] == 0).all()
    # Without the part that is spread evenly the prior has the mean and spread of the truth.
    plain = intervals.fit_prior(centres, counts, 0.6, uniform=0.0)
    assert abs(plain @ centres - truth.mean()) < 0.03
    assert abs(math.sqrt(plain @ centres ** 2 - (plain @ centres) ** 2) - truth.std()) < 0.05
    # The expected truth, worked out value by value.
    means = intervals.posterior_means(centres, prior, 0.6)
    for x in (-0.8, 0.3, 1.5, 3.0):
        i = int(np.abs(centres - x).argmin())
        weight = [p * math.exp(-0.5 * ((centres[i] - c) / 0.6) ** 2) for p, c in zip(prior, centres)]
        assert math.isclose(means[i], sum(w * c for w, c in zip(weight, centres)) / sum(weight), rel_tol=1e-9)
    got = np.interp(seen, centres, means)
    assert (got >= 0).all() and ((got - truth) ** 2).mean() < 0.6 * ((np.maximum(seen, 0) - truth) ** 2).mean()


def test_calibrated_jackknife(data, table):
    train = table.where("split = 'train'")
    bag = intervals.bag_fit(train, "y", ["k"], trees=12, depth=3)
    raw = column(intervals.jackknife_interval(bag, table), "yhat", "variance")
    out = column(intervals.jackknife_interval(bag, table, calibrate=True), "yhat", "variance", "lower", "upper")
    assert np.allclose(out[:, 0], raw[:, 0]) and (out[:, 1] > 0).all() and (raw[:, 1] == 0).any()
    assert np.allclose(out[:, 3] - out[:, 0], 1.959964 * np.sqrt(out[:, 1]), atol=1e-6)
    # The grid's values are recomputed from the rows' estimates.
    estimates = column(intervals._estimates(bag, table).select("k", "_e.*"), "variance", "one", "two")
    noise = np.sqrt(((estimates[:, 1] - estimates[:, 2]) ** 2).mean()) / 2
    sd = estimates[:, 0].std()
    centres = np.linspace(min(estimates[:, 0].min() - 2 * sd, 0), estimates[:, 0].max() + 2 * sd, 200)
    place = np.rint((estimates[:, 0] - centres[0]) / (centres[1] - centres[0])).astype(int)
    noise = max(noise, centres[1] - centres[0])
    prior = intervals.fit_prior(centres, np.bincount(place, minlength=200).astype(float), noise)
    want = np.interp(estimates[:, 0], centres, intervals.posterior_means(centres, prior, noise))
    assert np.allclose(out[:, 1], want, rtol=1e-3)


def test_boosting_learns_and_reloads(spark, data, table, tmp_path):
    _, y = data
    settings = boost.BoostSettings(rounds=11, depth=3, rate=0.4, l2=1.0)
    model = boost.newton_boost_fit(table, "y", settings, ["k"], split="split")
    log = [e for _, part, e in model.log if part == "valid"]
    assert len(log) == 11 and log[-1] < 0.03 < y[700:].std()
    predicted = column(model.transform(table), "yhat")
    assert math.isclose(log[-1], math.sqrt(((y[700:] - predicted[700:]) ** 2).mean()), rel_tol=1e-9)
    again = boost.newton_boost_fit(table, "y", replace(settings, rounds=2), ["k"], split="split")
    assert np.allclose(column(again.transform(table), "yhat"), column(model.transform(table, rounds=2), "yhat"))
    model.save(spark, str(tmp_path / "m"))
    loaded = Ensemble.load(spark, str(tmp_path / "m"))
    assert np.allclose(column(loaded.transform(table), "yhat"), predicted) and loaded.log == model.log
    assert np.allclose(column(model.transform(table, rounds=0), "yhat"), 0.5)


def test_quantile_boosting_meets_its_share(data, table):
    settings = boost.BoostSettings(rounds=6, depth=3, rate=0.5)
    train = table.where("split = 'train'")
    high = boost.quantile_boost_fit(train, "y", 0.9, settings, ["k"])
    low = boost.quantile_boost_fit(train, "y", 0.1, settings, ["k"])
    out = column(intervals.model_interval(train, None, low, high, 0.8), "y", "lower", "upper")
    assert (out[:, 1] <= out[:, 2]).all()
    assert 0.85 < (out[:, 0] <= out[:, 2]).mean() < 0.95
    assert 0.05 < (out[:, 0] <= out[:, 1]).mean() < 0.15


def test_smooth_loss_equals_the_published_formula(spark):
    alpha, delta, threshold, var = 0.95, 1.0, 5.0, 3.2
    x = np.array([-7.0, -5.0, -0.5, -0.05, -0.04, 0.0, 0.5, 0.95, 0.96, 3.0, 5.0, 9.0])
    df = spark.createDataFrame([(i, float(v), 0.0, 1.0 if i % 2 else -1.0) for i, v in enumerate(x)],
                               "k INT, y DOUBLE, f DOUBLE, s DOUBLE")
    loss = boost.smooth_quantile_loss(alpha, delta, threshold, var)
    args = (F.col("y"), F.col("f"), F.col("s"))
    got = column(df.select("k", loss.gradient(*args).alias("g"), loss.hessian(*args).alias("h")), "g", "h")
    sign = np.where(np.arange(len(x)) % 2, 1.0, -1.0)
    low, high = (alpha - 1) * delta, alpha * delta
    band = ((x >= low) & (x < high)).astype(float)
    grad = (x < low) * (1 - alpha) - band * x / delta - alpha * (x > high)
    near = np.abs(x) < threshold
    assert np.allclose(got[:, 0], np.where(near, grad, -sign * var))
    assert np.allclose(got[:, 1], np.where(near, band / delta, 1.0))


def test_leaf_weight_penalties():
    assert Growth().weight(-6.0, 2.0) == 3.0
    assert Growth(l1=2.0, l2=2.0).weight(-6.0, 2.0) == 1.0
    assert Growth(l1=2.0).weight(1.0, 2.0) == 0.0 and Growth().weight(1.0, 0.0) == 0.0
    assert Growth(max_step=0.5).weight(-6.0, 2.0) == 0.5


def test_search_refit_and_curves(spark, table):
    folded = split.kfold_assign(table, ["k"], 3)
    found = tuning.grid_search_cv(folded, forest.rf_estimator("y", trees=4), {"maxDepth": [1, 5]}, "y", folds=3)
    assert found.best == {"maxDepth": 5} and found.model.getOrDefault("maxDepth") == 5
    assert tuning.refit_best(table, forest.rf_estimator("y", trees=4), found.best).getNumTrees == 4
    drawn = tuning.draw_settings({"p": [1, 2, 3], "q": [4, 5]}, 4, seed=42)
    assert len({tuple(s.items()) for s in drawn}) == 4
    assert len(tuning.draw_settings({"p": [1, 2]}, 10, seed=1)) == 2
    assert len(tuning.parameter_grid({"p": [1, 2, 3], "q": [4, 5]})) == 6
    model = forest.gbt_fit(table.where("split = 'train'"), "y", rounds=5, depth=2, rate=0.5, subsample=1.0, min_leaf=1)
    losses = [r["deviance"] for r in forest.staged_deviance(model, table, "y").orderBy("round").collect()]
    assert len(losses) == 5 and losses[-1] < losses[0]
    curve = forest.validation_curve(folded, "y", [1, 6], 3, depth=4, subset="all")
    scores = {(r["side"], r["trees"]): r["mean_r2"] for r in curve.collect()}
    assert scores[("valid", 6)] >= scores[("valid", 1)] - 0.02 and scores[("train", 6)] > 0.9


def test_forest_search_equals_single_fits(spark, table, data):
    """All candidates and folds side by side give the scores of forests fitted one by one on the same draws."""
    from riskgrid.operators.forest import bag_weights, grow_bag
    folded = split.kfold_assign(table, ["k"], 3).persist()
    space = [{"trees": 3, "depth": 3, "subset": "all"}, {"trees": 6, "depth": 3, "subset": "all"},
             {"trees": 4, "depth": 8, "min_leaf": 3, "subset": "onethird"}, {"trees": 4, "depth": 0}]
    found = tuning.forest_search_cv(folded, "y", space, 3, at_once=10)
    rows = folded.select("features", "y", "fold").withColumn("_id", F.monotonically_increasing_id()).persist()
    for setting, score in found.tried[:3]:
        errors = []
        for k in range(3):
            model = grow_bag(rows.where(F.col("fold") != k), "y", setting["trees"],
                             lambda first, n: bag_weights(["_id"], n, 123, first),
                             Growth(setting["depth"], setting.get("min_leaf", 1), seed=123), setting["subset"])
            held = model.transform(rows.where(F.col("fold") == k))
            errors.append(agg.mse(held, "y", "yhat").first()[0])
        assert math.isclose(score, np.mean(errors), rel_tol=1e-9)
    _, y = data
    assert 0.9 * y.var() < found.tried[3][1] < 1.1 * y.var()
    assert found.best == min(found.tried, key=lambda t: t[1])[0] and len(found.model) == found.best["trees"]
    halved = tuning.forest_search_cv(folded, "y", [{"trees": 8, "depth": d, "subset": "all"} for d in (0, 1, 2, 6)], 3,
                                     halving=True, at_once=50)
    assert halved.best["depth"] in (2, 6) and halved.tried[0][1] > halved.tried[3][1]


def test_importances(spark, table, grown):
    impurity = {r["name"]: r for r in explain.impurity_importance(spark, grown, COLUMNS).collect()}
    assert math.isclose(sum(r["importance"] for r in impurity.values()), 1.0)
    gains = {r["name"]: r["splits"] for r in explain.gain_importance(spark, grown, COLUMNS).collect()}
    assert sum(gains.values()) == sum((len(t) - 1) // 2 for t in grown.trees)
    drops = explain.permutation_importance(table, grown.transform, "y", ["k"], COLUMNS, repeats=3)
    summary = {r["name"]: r["importance"] for r in explain.permutation_summary(drops).collect()}
    assert drops.count() == 9 and max(summary, key=summary.get) == "a" and summary["a"] > 0.2
    cumulative = explain.cum_importance(explain.impurity_importance(spark, grown, COLUMNS)).orderBy("cumulative").collect()
    assert math.isclose(cumulative[-1]["cumulative"], 1.0) and cumulative[0]["needed"]


def test_partial_dependence_equals_refeeding(data, table, grown):
    x, _ = data
    pd_rows = explain.partial_dependence(table, grown.transform, COLUMNS, ["a"], points=7).orderBy("grid_index").collect()
    assert len(pd_rows) == 7
    at = pd_rows[3]["grid_value"]
    from pyspark.ml.feature import VectorAssembler
    moved = table.drop("features").withColumn("a", F.lit(at))
    direct = grown.transform(VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(moved))
    assert math.isclose(pd_rows[3]["mean"], direct.agg(F.avg("yhat")).first()[0], rel_tol=1e-9)
    plotting = np.sort(x[:, 0])
    n, p = N, 0.05
    m = 0.4 + 0.2 * p
    k = int(n * p + m)
    edge = plotting[k - 1] + (n * p + m - k) * (plotting[k] - plotting[k - 1])
    assert math.isclose(pd_rows[0]["grid_value"], edge, rel_tol=1e-9)
    curves = explain.ice_curves(table, grown.transform, COLUMNS, ["a"], ["k"], n=10, points=7)
    assert curves.count() == 70
    coded = table.select("k", "y", vector_to_array("features")[0].alias("a")).withColumn("a", F.round("a", 0))
    assert explain.feature_grid(coded, "a") == [0.0, 1.0]


@pytest.mark.parametrize("local_rows", [50, 10 ** 6])
def test_deep_forest_reproduces_distinct_rows(table, data, local_rows):
    """Depth 40 and leaves of one row, without drawing: the hybrid way ends where the exact one does."""
    _, y = data
    model = forest.rf_fit(table, "y", trees=2, depth=40, bootstrap=False, local_rows=local_rows)
    assert np.allclose(column(model.transform(table), "yhat"), y)
    assert max(t.depth() for t in model.trees) > 8 and all(t.n[0] == N for t in model.trees)


def test_forest_beyond_thirty_levels(spark):
    """A label that grows this fast needs a chain of cuts, one row at a time."""
    df = spark.createDataFrame([(i, float(i), 2.5 ** i) for i in range(40)], "k INT, a DOUBLE, y DOUBLE")
    df = features.feature_pipeline(df, ["a"]).transform(df)
    model = forest.rf_fit(df, "y", trees=1, depth=40, bootstrap=False, subset="all")
    assert model.trees[0].depth() > 30 and np.allclose(column(model.transform(df), "yhat"), 2.5 ** np.arange(40))
    with pytest.raises(ValueError, match="beyond"):
        forest.rf_estimator("y", depth=40)


def test_forest_learns_with_drawn_rows(table, data):
    _, y = data
    model = forest.rf_fit(table.where("split = 'train'"), "y", trees=20, depth=8, subset="onethird")
    assert ((column(model.transform(table), "yhat")[700:] - y[700:]) ** 2).mean() < 0.15 * y[700:].var()
    assert len({int(t.n[0]) for t in model.trees}) > 5


def test_dependence_by_nodes(spark, data, table):
    """Trees of one split: equal to scoring every row, as covers are exact there."""
    settings = boost.BoostSettings(rounds=8, depth=1, rate=0.5)
    model = boost.newton_boost_fit(table, "y", settings, ["k"])
    by_nodes = explain.dependence_by_nodes(table, model, COLUMNS, ["a", "b"], points=9)
    by_rows = explain.partial_dependence(table, model.transform, COLUMNS, ["a", "b"], points=9)
    got = {(r["name"], r["grid_index"]): r["mean"] for r in by_nodes.collect()}
    want = {(r["name"], r["grid_index"]): r["mean"] for r in by_rows.collect()}
    assert len(got) == 18 and got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_dependence_follows_covers():
    from riskgrid.operators.packed import Tree
    tree = Tree(np.array([1, 0, -1, -1, -1]), np.array([0.5, 2.0, np.inf, np.inf, np.inf]), np.array([1, 3, -1, -1, -1]),
                np.array([2, 4, -1, -1, -1]), np.array([0, 0, 5.0, 1.0, 3.0]), np.zeros(5),
                np.array([10.0, 4, 6, 1, 3]), np.ones(5, dtype=int))
    assert np.allclose(explain.node_dependence(tree, 1, np.array([0.0, 1.0])), [1.0 / 4 + 3.0 * 3 / 4, 5.0])
    assert np.allclose(explain.node_dependence(tree, 0, np.array([2.0, 3.0])), [0.6 * 5 + 0.4 * 1, 0.6 * 5 + 0.4 * 3])


def test_reseeded_fits(table):
    settings = boost.BoostSettings(rounds=3, depth=2, rate=0.5, subsample=0.6, by_tree=0.7)
    out = intervals.reseed_interval(table, table, "y", ["k"], settings, repeats=4)
    rows = column(out, "lower", "yhat", "upper")
    assert (rows[:, 0] <= rows[:, 1]).all() and (rows[:, 1] <= rows[:, 2]).all() and (rows[:, 0] < rows[:, 2]).any()


def test_mse_family(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 2.5), (3.0, 3.0)], "y DOUBLE, yhat DOUBLE")
    assert math.isclose(agg.mse(df).first()[0], 0.5 / 3)
    assert math.isclose(agg.rmse(df).first()[0], math.sqrt(0.5 / 3))
    assert math.isclose(agg.r_squared(df).first()[0], 1 - (0.5 / 3) / (2 / 3))
    score = agg.pinball_score(df, 0.95).first()
    assert math.isclose(score["cost"], 0.95 * 0.5 + 0.05 * 0.5) and math.isclose(score["score"], 1 / score["cost"])


def test_model_run_end_to_end(spark, table, tmp_path):
    from riskgrid.plans import model_run
    from riskgrid.roles import Roles
    pixels = table.drop("features", "split").select(
        (F.col("k") % 30 * 5.0).alias("x"), (F.floor(F.col("k") / 30) * 5.0).alias("y0"), "a", "b", "c", "y",
        F.when(F.col("k") % 2 == 0, "u").otherwise("r").alias("ur")).persist()
    named = pixels.select("x", F.col("y0").alias("y"), "a", F.when(F.col("a") > 0.99, None).otherwise(F.col("b")).alias("b"),
                          "c", "ur", F.col("y").alias("FOI"))
    roles = Roles(climate=("a", "b"), other=("c", "ur"), category=("ur",))
    grid = named.select("x", "y", (F.floor(F.col("y") / 5)).alias("grid_id"))
    prepared = model_run.prepare(named, grid, roles, min_rows=10)
    na = {r["split"]: r["na_rows"] for r in prepared.na.collect()}
    assert sum(na.values()) == named.where("b IS NULL").count() > 0
    run = model_run.forest_run(prepared, named.drop("FOI"), roles, {"trees": 5, "depth": 4}, link_kind="logit")
    endemic = run.endemic.collect()
    assert len(endemic) == named.where("b IS NOT NULL").count()
    assert all(0 < r["lower"] <= r["upper"] < 1 for r in endemic)
    report = run.errors.first()
    assert 0 < report["mse_train"] < 0.01 and 0 < report["mse_test"] < 0.02 and report["time_train"] > 0
    assert run.top.first()["name"] == "a"
    with pytest.raises(ValueError):
        model_run.prepare(named, grid.where("x > 0"), roles)
