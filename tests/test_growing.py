"""The tree grower against a plain recursive one, packed scoring against a walk row by row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from riskgrid.operators import boost, features, growing
from riskgrid.operators.growing import Features, Growth
from riskgrid.operators.packed import Ensemble, Packed, Tree, pack, tree_outputs

COLUMNS = ["a", "b", "c"]


def plain(x, g, h, growth, depth=0):
    """(feature, gain, cover, n, left, right) or (value, cover, n): every cut between different values is tried."""
    def score(g, h):
        return max(abs(g) - growth.l1, 0.0) ** 2 / (h + growth.l2) if h + growth.l2 > 0 else 0.0

    best = None
    for f in range(x.shape[1]) if depth < growth.depth else ():
        for cut in np.unique(x[~np.isnan(x[:, f]), f]):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < max(growth.min_leaf, 1):
                continue
            if min(h[left].sum(), h[~left].sum()) < growth.min_child:
                continue
            parts = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum())
            gain = parts - score(g.sum(), h.sum())
            if gain > max(growth.min_gain, 1e-12 * parts) and (best is None or gain > best[0] * (1 + 1e-9)):
                best = gain, f, left
    if best is None:
        value = -np.sign(g.sum()) * max(abs(g.sum()) - growth.l1, 0.0) / (h.sum() + growth.l2)
        return np.clip(value, -growth.max_step, growth.max_step) if growth.max_step else value, h.sum(), len(g)
    gain, f, left = best
    return f, gain, h.sum(), len(g), plain(x[left], g[left], h[left], growth, depth + 1), plain(
        x[~left], g[~left], h[~left], growth, depth + 1)


def same(tree: Tree, node: int, want) -> None:
    if tree.left[node] < 0:
        assert len(want) == 3 and np.allclose([tree.value[node], tree.cover[node], tree.n[node]], want, atol=1e-10)
        return
    assert len(want) == 6 and tree.feature[node] == want[0]
    assert np.allclose([tree.gain[node], tree.cover[node], tree.n[node]], want[1:4])
    same(tree, tree.left[node], want[4])
    same(tree, tree.right[node], want[5])


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 60, (500, 3)).astype(float)
    x[rng.uniform(size=500) < 0.05, 1] = np.nan
    y = np.sin(x[:, 0] / 9) + np.where(np.nan_to_num(x[:, 1]) > 30, 0.7, 0.0) + rng.normal(0, 0.1, 500)
    return x, y, rng.uniform(0.2, 2.0, 500)


@pytest.fixture(scope="module")
def rows(spark, sample):
    x, y, h = sample
    df = spark.createDataFrame([(list(map(float, r)), float(-w * v), float(w)) for r, v, w in zip(x, y, h)],
                               "features array<double>, g double, h double").repartition(3)
    edges = growing.bin_edges(df)
    return growing.binned(df, edges).select("features", "_b", F.array("g").alias("_g"), F.array("h").alias("_h"),
                                            F.array(F.lit(1.0)).alias("_n")).persist(), edges


@pytest.mark.parametrize("growth", [
    Growth(depth=4, l2=1.0), Growth(depth=3, l1=5.0, l2=0.5, min_gain=2.0), Growth(depth=5, min_leaf=20, min_child=30.0),
    Growth(depth=2, l2=3.0, max_step=0.1), Growth(depth=0)])
@pytest.mark.parametrize("local", [0, 90, 10 ** 6])
def test_grower_equals_the_plain_one(sample, rows, growth, local):
    """Level-wise, finished in tasks, and both mixed."""
    x, y, h = sample
    df, edges = rows
    tree, = growing.grow(df, edges, growth, local_rows=local)
    same(tree, 0, plain(x, -h * y, h, growth))
    walked = tree_outputs(Packed([tree]), x)[:, 0]
    binned = growing.bin_matrix(df.select("_b").toPandas()["_b"], 3)
    on_bins = tree_outputs(Packed([growing.on_bins(tree, edges)]), binned)[:, 0]
    own = np.stack(df.select("features").toPandas()["features"].to_numpy())
    assert np.allclose(np.sort(walked), np.sort(tree_outputs(Packed([tree]), own)[:, 0]))
    if not local:
        assert np.allclose(on_bins, tree_outputs(Packed([tree]), own)[:, 0])


def test_passes_do_not_change_the_tree(rows, monkeypatch):
    df, edges = rows
    growth = Growth(depth=4, l2=1.0, by_node=0.67)
    want, = growing.grow(df, edges, growth)
    monkeypatch.setattr(growing, "CELLS", 1)
    got, = growing.grow(df, edges, growth)
    assert np.array_equal(got.feature, want.feature) and np.allclose(got.value, want.value)


def test_several_trees_share_their_passes(spark, sample, rows):
    df, edges = rows
    weights = F.array(F.lit(1.0), F.pmod(F.xxhash64("features"), F.lit(3)).cast("double"))
    both = df.select("features", "_b", F.transform(weights, lambda w: w * F.col("_g")[0]).alias("_g"),
                     F.transform(weights, lambda w: w * F.col("_h")[0]).alias("_h"), weights.alias("_n"))
    one, two = growing.grow(both, edges, Growth(depth=3, l2=1.0), trees=2)
    alone, = growing.grow(df, edges, Growth(depth=3, l2=1.0))
    assert np.array_equal(one.feature, alone.feature) and not np.allclose(one.cover[0], two.cover[0])
    assert two.n[0] == both.select(F.sum(F.col("_n")[1])).first()[0]


def test_column_shares():
    growth = Growth(by_tree=0.5, by_level=0.5, by_node=0.5, seed=3)
    choice = Features(growth, 16, 2)
    masks = [choice.mask(1, p) for p in range(4)]
    assert all(m.sum() == 2 for m in masks) and len({m.tobytes() for m in masks}) > 1
    level = set(np.flatnonzero(np.any(masks, axis=0)))
    assert len(level) <= 4 and level <= set(choice.own) and len(choice.own) == 8
    assert np.array_equal(Features(growth, 16, 2).mask(1, 3), masks[3])


def test_quantile_edges(spark):
    df = spark.range(5000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    wide, constant = growing.bin_edges(df)
    assert len(constant) == 0 and 240 <= len(wide) <= growing.MAX_EDGES and np.abs(np.diff(wide) - 5000 / 254).max() < 15


def test_grower_learns_on_many_values(spark):
    df = spark.range(3000).select(F.array(F.col("id") / 3000.0, F.rand(1)).alias("features"),
                                  F.when(F.col("id") < 1111, 1.0).otherwise(0.0).alias("y"))
    edges = growing.bin_edges(df)
    table = growing.binned(df, edges).select("features", "_b", F.array(-F.col("y")).alias("_g"),
                                             F.array(F.lit(1.0)).alias("_h"), F.array(F.lit(1.0)).alias("_n"))
    tree, = growing.grow(table, edges, Growth(depth=30), local_rows=2000)
    assert tree.depth() > 1 and set(np.round(tree.value[tree.leaves], 9)) == {0.0, 1.0}


# -- packed ensembles -----------------------------------------------------------------------------

def random_trees(n, seed, count=3, splits=1):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        size = 2 * splits + 1
        left, right = np.full(size, -1), np.full(size, -1)
        left[:splits], right[:splits] = 2 * np.arange(splits) + 1, 2 * np.arange(splits) + 2
        inner = left >= 0
        out.append(Tree(np.where(inner, rng.integers(0, count, size), -1), np.where(inner, rng.uniform(0, 1, size), np.inf),
                        left, right, np.where(inner, 0.0, rng.normal(size=size)), np.where(inner, 1.0, 0.0),
                        np.ones(size), np.ones(size, dtype=np.int64)))
    return tuple(out)


def by_hand(tree, row):
    node = 0
    while tree.left[node] >= 0:
        node = tree.left[node] if row[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
    return tree.value[node]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(400).select(F.col("id").alias("k"), *[F.rand(i).alias(c) for i, c in enumerate(COLUMNS)])
    df = spark.createDataFrame(df.collect(), df.schema)
    return features.feature_pipeline(df, COLUMNS).transform(df)


def column(df, name):
    return np.array([r[name] for r in df.orderBy("k").collect()])


def test_thousand_trees_are_one_node(spark, table, monkeypatch):
    model = Ensemble(random_trees(1000, 1, splits=7), base=0.25, rate=0.1)
    scored = model.transform(table)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    x = np.stack([column(table, c) for c in COLUMNS], axis=1)
    want = [0.25 + 0.1 * sum(by_hand(t, row) for t in model.trees) for row in x[:40]]
    got = column(scored, "yhat")
    assert np.allclose(got[:40], want)
    # Beyond the limit of a broadcast it is scored block by block, with the same values and no columns left behind.
    blocks = model.transform(table, limit=200_000)
    assert blocks.columns == scored.columns and np.allclose(column(blocks, "yhat"), got)
    assert np.allclose(column(model.transform(table, rounds=0), "yhat"), 0.25)
    assert np.allclose(column(model.outputs(table), "tree_predictions").sum(axis=1) * 0.1 + 0.25, got)
    leaves = column(model.leaf_numbers(table, "leaf"), "leaf")
    assert np.allclose(model.trees[3].value[model.trees[3].leaves][leaves[:, 3]], column(model.outputs(table), "tree_predictions")[:, 3])


def test_save_and_load_as_one_table(spark, table, tmp_path):
    model = Ensemble((*random_trees(30, 2, splits=3),), 0.5, 0.3, log=((1, "train", 0.2),))
    model.save(spark, str(tmp_path / "m"))
    again = Ensemble.load(spark, str(tmp_path / "m"))
    assert again.log == model.log and np.allclose(column(again.transform(table), "yhat"), column(model.transform(table), "yhat"))
    assert spark.read.parquet(str(tmp_path / "m" / "nodes")).count() == 30 * 7


@pytest.mark.parametrize("kind, options", [
    (DecisionTreeRegressor, {"maxDepth": 4}), (RandomForestRegressor, {"numTrees": 5, "maxDepth": 4, "seed": 1}),
    (GBTRegressor, {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "seed": 1})])
def test_mllib_models_are_packed(spark, table, kind, options):
    kinds = table.drop("features").withColumn("u", F.concat(F.lit("v"), (F.col("k") % 7).cast("string"))).withColumn(
        "y", F.col("a") + (F.col("k") % 7 == 3).cast("double"))
    df = features.feature_pipeline(kinds, COLUMNS, ["u"]).transform(kinds)
    model = kind(labelCol="y", **options).fit(df)
    packed = pack(spark, model)
    assert any(t.categories for t in packed.trees)
    assert np.allclose(column(packed.transform(df), "yhat"), column(model.transform(df), "prediction"))


def test_boosting_equals_plain_rounds(spark, table):
    """Squared loss with penalties: every round's tree equals the plain one on the running residuals."""
    df = table.withColumns({c: F.round(c, 1) for c in COLUMNS}).drop("features").withColumn(
        "y", F.round(F.col("a") * 2 + F.sin(F.col("b") * 6), 3))
    df = features.feature_pipeline(df, COLUMNS).transform(df)
    settings = boost.BoostSettings(rounds=5, depth=3, rate=0.5, l1=0.3, l2=2.0, min_gain=0.1)
    model = boost.newton_boost_fit(df, "y", settings, ["k"])
    x, y = np.stack([column(df, c) for c in COLUMNS], axis=1), column(df, "y")
    running = np.full(len(y), 0.5)
    for tree in model.trees:
        same(tree, 0, plain(x, running - y, np.ones(len(y)), settings.growth()))
        running = running + 0.5 * tree_outputs(Packed([tree]), x)[:, 0]
    assert np.allclose(column(model.transform(df), "yhat"), running)
    assert np.isclose(model.log[-1][2], np.sqrt(((y - running) ** 2).mean()))
