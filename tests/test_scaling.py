"""What keeps the work per row small: Arrow batches as matrices, exact quantiles without a shuffle, open folders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from riskgrid import sources
from riskgrid.functions import hash_uniform, poisson_counts, poisson_one, whole
from riskgrid.operators import explain, features, forest, growing, keys
from riskgrid.operators.growing import Growth
from riskgrid.operators.packed import Ensemble, arrays, matrix, numbers
from riskgrid.operators.quantiles import numbered_quantiles

PROBS = [0.0, 0.05, 0.5, 0.95, 1.0]


def read(batch):
    return numbers(batch.column("g")), numbers(batch.column("v"))


@pytest.mark.parametrize("chunk, picks", [(10 ** 6, 512), (500, 8), (50, 2)])
def test_numbered_quantiles_equal_numpy(spark, chunk, picks):
    """Spread values, two far apart with one between, a heavy value among others, one value alone, nothing but NaN."""
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=3000), 1: np.r_[np.zeros(1500), 0.5, np.ones(1500)], 3: np.array([7.0]),
              2: np.r_[np.full(2000, 0.3), rng.uniform(size=1000)], 4: np.array([np.nan, np.nan])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    found = numbered_quantiles(df, read, [0, 1, 2, 3, 4, 5], PROBS, chunk, picks)
    assert set(found) == {0, 1, 2, 3}
    for g in found:
        assert np.allclose(found[g], np.quantile(groups[g], PROBS), rtol=0, atol=1e-12)


def test_labels_alone_grow_the_tree_of_their_gradients(spark):
    """Least squares needs one number of a row, not two arrays over the trees."""
    df = spark.range(900).select(F.array(F.rand(1), F.rand(2)).alias("features"), (F.col("id") % 3).cast("double").alias("w"),
                                 F.rand(3).alias("_y")).persist()
    edges = growing.bin_edges(df)
    rows = growing.binned(df, edges).select("features", "_b", "_y", F.array(F.lit(1.0), F.col("w")).alias("_n")).persist()
    spelled = rows.select("features", "_b", F.transform("_n", lambda n: -n * F.col("_y")).alias("_g"),
                          F.col("_n").alias("_h"), "_n")
    for local in (0, 200):
        for got, want in zip(growing.grow(rows, edges, Growth(depth=4), 2, local_rows=local),
                             growing.grow(spelled, edges, Growth(depth=4), 2, local_rows=local)):
            assert np.array_equal(got.feature, want.feature) and np.allclose(got.value, want.value)


def test_arrow_columns_are_matrices():
    table = np.arange(12.0).reshape(4, 3)
    assert np.array_equal(matrix(arrays(table).slice(1, 2)), table[1:3])
    assert np.array_equal(growing.bin_matrix(pa.array([b"ab", b"cd", b"ef"]).slice(1), 2), [[99, 100], [101, 102]])
    with pytest.raises(ValueError):
        matrix(pa.array([[1.0, 2.0], None]))


def test_whole_rounds_as_round_does(spark):
    """Halves away from zero, numbers next to a half, large ones, and what is no number."""
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 12.499999999999998, 0.0, -0.2, 4503599627370497.5, 1e300,
              -7.0, None, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(whole(F.col("v")), F.round("v")).collect()
    for got, want in rows:
        assert got == want or got is want or (got != got and want != want)


def test_a_known_lattice_computes_no_row(spark, monkeypatch):
    """One row of a join or aggregation costs all of it."""
    def refuse(*_):
        raise AssertionError("the table is computed for its lattice")

    df = spark.createDataFrame([(2.0, 4.0, 1), (7.0, 4.0, 2)], "x double, y double, v int")
    want = sorted(keys.attach_by_pixel(df.drop("v"), df, ["v"]).collect())
    monkeypatch.setattr(keys, "lattice_origin", refuse)
    assert sorted(keys.attach_by_pixel(df.drop("v"), df, ["v"], origin=(2.0, 4.0)).collect()) == want and len(want) == 2


def test_rows_as_bytes_grow_the_tree_of_their_arrays(spark):
    df = spark.range(900).select(F.array(F.rand(1), F.rand(2)).alias("features"), F.rand(3).alias("_y"),
                                 poisson_counts(F.array(hash_uniform(["id"], 1), hash_uniform(["id"], 2))).alias("_n"),
                                 F.array(*[poisson_one(hash_uniform(["id"], s)) for s in (1, 2)]).alias("m")).persist()
    assert df.where("_n <> m").count() == 0
    edges = growing.bin_edges(df)
    rows = growing.binned(df, edges).persist()
    short = rows.select("_b", "_y", growing.as_bytes("_n").alias("_n"), growing.as_bytes("features").alias("_x"))
    for local in (0, 200, 10 ** 6):
        for got, want in zip(growing.grow(short, edges, Growth(depth=4), 2, local_rows=local, features="_x"),
                             growing.grow(rows, edges, Growth(depth=4), 2, local_rows=local)):
            assert np.array_equal(got.feature, want.feature) and np.allclose(got.value, want.value)
            assert np.array_equal(got.threshold, want.threshold)


def test_an_ensemble_sweeps_its_batches(spark, monkeypatch):
    """Rows are not unfolded for the grid values, and the means are those of unfolded rows."""
    from pyspark.ml.functions import array_to_vector

    df = spark.range(300).select(F.rand(1).alias("a"), (F.col("id") % 4).cast("double").alias("b"), F.rand(3).alias("_y"),
                                 F.array(F.lit(1.0)).alias("_n"))
    df = df.withColumn("features", array_to_vector(F.array("a", "b"))).persist()
    edges = growing.bin_edges(df)
    model = Ensemble(tuple(growing.grow(growing.binned(df, edges), edges, Growth(depth=4))), base=0.5, rate=0.3)
    want = explain.partial_dependence(df, lambda rows: model.transform(rows), ["a", "b"], ["a", "b"], points=6).collect()
    monkeypatch.setattr(explain, "grid_rows", None)
    got = explain.partial_dependence(df, model.transform, ["a", "b"], ["a", "b"], points=6).collect()
    assert len(got) == 10 and [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)]
    assert np.allclose([r["mean"] for r in sorted(got)], [r["mean"] for r in sorted(want)], rtol=1e-12)


def test_ages_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Every folder has its own writer, as many as there are ages; the setting is put back."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(name), []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: (seen.append(int(spark.conf.get(name))), write(*a, **k)))
    pixels = spark.range(300).select(F.col("id").cast("double").alias("x"), F.lit(5.0).alias("y"))
    ages = pixels.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(60)))).withColumn("cases", F.col("x") * F.col("age"))
    sources.write_cases_by_age(ages, pixels.withColumn("cases", F.lit(1.0)), str(tmp_path / "cases"))
    assert seen[0] >= 61 and spark.conf.get(name) == before
    got = spark.read.parquet(str(tmp_path / "cases")).groupBy("part").agg(F.count("*").alias("n"), F.sum("cases").alias("s"))
    want = {f"Age_{a:02d}": (300, a * 44850.0) for a in range(61)} | {"Total": (300, 300.0)}
    assert {r["part"]: (r["n"], r["s"]) for r in got.collect()} == want


def test_levels_read_blocks_and_grow_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, n = rng.uniform(0, 1, (3000, 3)), 3000
    x[::50, 1] = np.nan
    df = spark.createDataFrame([(i, list(map(float, r)), float(r[0] > 0.4) + float(v)) for i, (r, v) in
                                enumerate(zip(x, rng.normal(0, 0.1, n)))], "id bigint, features array<double>, y double").repartition(2).persist()
    tables = []

    def watched(rows, *rest):
        tables.append(rows.count())
        return growing.grow(rows, *rest)

    monkeypatch.setattr(forest, "grow", watched)

    def bag(drawn, uniform, **limits):
        return forest.grow_bag(df, "y", 3, lambda first, m: drawn(["id"], m, 5, first), Growth(depth=6, seed=5), uniform=uniform, **limits)

    for limits in ({"local_rows": 0}, {"local_rows": 400}):
        blocks, copies = bag(forest.bag_uniforms, True, **limits), bag(forest.bag_weights, False, **limits)
        edges = growing.bin_edges(df.withColumn("_y", F.col("y")))
        plain = growing.grow(growing.binned(df.withColumn("_y", F.col("y")), edges).withColumn("_n", forest.bag_weights(["id"], 3, 5)),
                             edges, Growth(depth=6, seed=5), 3, **limits)
        for other in (copies.trees, plain):
            for a, b in zip(blocks.trees, other):
                assert len(a) == len(b) > 10
                assert np.array_equal(a.feature, b.feature) and np.array_equal(a.n, b.n) and np.allclose(a.value, b.value)
                assert np.allclose(a.threshold, b.threshold)
    # A pass costs Spark a row for some hundred pixels, not one for each.
    assert max(tables) <= n // growing.BLOCK_ROWS + 4


def test_blocks_hold_the_rows_in_order():
    table = np.arange(7 * 3, dtype=float).reshape(7, 3)
    blocks = growing.block_bytes(table, 2)
    assert [len(v) // 24 for v in blocks.to_pylist()] == [2, 2, 2, 1] == np.diff(growing.block_ends(7, 2)).tolist()
    assert np.array_equal(growing.doubles(blocks, 7), table) and np.array_equal(growing.doubles(blocks[1:3], 4), table[2:6])
    assert len(growing.block_bytes(np.zeros((0, 3)))) == 0


def test_inputs_are_the_assembled_vector_and_missing_ones_an_error(spark):
    df = spark.createDataFrame([(1.0, 2, "b"), (3.0, 4, "a")], "a double, b int, c string")
    out = features.feature_pipeline(df, ["a", "b"], ["c"]).transform(df).withColumn("inputs", features.input_array(["a", "b", "c_code"]))
    assert all(r["inputs"] == list(r["features"]) for r in out.collect())
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="a missing value in a, b"):
            spark.createDataFrame([(bad, 1)], "a double, b int").select(features.input_array(["a", "b"])).collect()


def test_prepared_pixels_are_joined_without_sorting_them_and_not_spread_again(spark, tmp_path, monkeypatch):
    from workload import models

    orders = [(k, k % 3, f"{k % 2}-P", 10.0 * k) for k in range(1, 41)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, float(q), 5.0 * q, 0.02, 0.05) for k, *_ in orders for q in (1, 2)],
                          "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k, 1.5 * k) for k in range(3)], "c_custkey bigint, c_nationkey int, c_acctbal double").write.parquet(
        f"{tmp_path}/customer.parquet")
    plans, write = [], models.sources.materialize

    def watched(df, name, spread=()):
        plans.append((df._jdf.queryExecution().toString(), spread))
        return write(df, name, spread)

    monkeypatch.setattr(models.sources, "materialize", watched)
    monkeypatch.setattr(models, "LARGE", 39)
    rows = models.prepared(spark, str(tmp_path)).collect()
    (plan, spread), = plans
    assert plan.count("ShuffledHashJoin") and "SortMergeJoin" not in plan and not spread
    assert sorted(r["pixel_id"] for r in rows) == list(range(1, 41)) and all(r["split"] == "train" for r in rows)
    assert all(r["inputs"] == list(r["features"]) == [1.5, 7.5, 0.05, 10.0 * r["pixel_id"], 1.5 * (r["pixel_id"] % 3),
                                                      float(r["pixel_id"] % 2)] for r in rows)
