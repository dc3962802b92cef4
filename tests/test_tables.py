"""Checks, joins, splits, quantiles and aggregates on small hand-made frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid import functions as fn
from riskgrid.operators import aggregates, burden, compare, keys, quality, ranking, reshape, sizes, split
from riskgrid.operators import quantiles
from riskgrid.operators.quantiles import exact_quantiles
from riskgrid.roles import STUDY
from riskgrid.sources import readers

NAN = float("nan")


def test_missing_cells_are_null_or_nan(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (2, None, "a"), (3, NAN, "a"), (4, 2.0, None), (5, NAN, None), (6, 0.0, "b")],
        "id INT, v DOUBLE, c STRING")
    assert [r["id"] for r in quality.drop_na_rows(df).orderBy("id").collect()] == [1, 6]
    report = quality.na_report(df, by=None).first()
    assert (report["na_rows"], report["total"], report["na_percent"]) == (4, 6, 66.67)


def test_study_roles():
    assert len(STUDY.features()) == 26 and len(STUDY.features("climate")) == 19
    assert set(STUDY.features()) - set(STUDY.features("climate")) == set(STUDY.other)
    with pytest.raises(ValueError):
        STUDY.features("other")
    schema = readers.feature_schema()
    assert schema["UR"].dataType.simpleString() == "string" and schema["FOI"].dataType.simpleString() == "double"


def test_group_split_threshold_and_shares(spark):
    rows = [(g, i) for g, n in [("a", 99), ("b", 100), ("c", 101)] for i in range(n)]
    rows += [(f"g{k}", i) for k in range(38) for i in range(100)]
    df = spark.createDataFrame(rows, "grid_id STRING, i INT")
    table = {r["grid_id"]: r["split"] for r in split.group_split_table(df).collect()}
    assert table["a"] == "train"
    counted = [s for g, s in table.items() if g != "a"]
    assert [counted.count(s) for s in ("train", "validate", "test")] == [28, 6, 6]
    per_row = split.group_split(df)
    assert per_row.count() == len(rows)
    assert per_row.groupBy("grid_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()


def test_coordinates_with_noise(spark):
    a = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (10.0, 5.0)], "x DOUBLE, y DOUBLE")
    b = spark.createDataFrame([(1e-12, 0.0), (5.0, 0.0), (10.0 - 1e-12, 5.0)], "x DOUBLE, y DOUBLE")
    assert keys.coord_match_check(a, b).first()["matched"]
    assert keys.coord_tolerance_check(a, b).first()["within"]
    far = b.union(spark.createDataFrame([(0.1, 0.0)], "x DOUBLE, y DOUBLE"))
    check = keys.coord_match_check(a, far).first()
    assert check["right_duplicate_keys"] == 1 and not check["matched"]
    assert not keys.coord_tolerance_check(a, far).first()["within"]
    assert keys.coord_match_check(a, a.where("x < 10")).first()["unmatched"] == 1


def test_raster_index_flags_off_grid(spark):
    df = spark.createDataFrame([(10.0, 20.0), (15.0, 20.0), (10.0, 10.0), (12.0, 15.0)], "x DOUBLE, y DOUBLE")
    rows = [(r["col"], r["row"], r["on_grid"]) for r in keys.raster_index(df).collect()]
    assert rows == [(0, 0, True), (1, 0, True), (0, 2, True), (0, 1, False)]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (3.7,)], "v DOUBLE")
    got = [r[0] for r in df.select(fn.half_even(F.col("v"))).collect()]
    assert got == [round(v) for v in (0.5, 1.5, 2.5, -0.5, 3.7)]


def test_link_round_trip(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.93,)], "v DOUBLE")
    back = fn.inverse_link(fn.link(F.col("v"), "logit"), "logit")
    assert all(abs(r[0] - r[1]) < 1e-12 for r in df.select("v", back).collect())


@pytest.mark.parametrize("in_memory_rows", [5, 10_000_000])
def test_exact_quantiles_both_ways(spark, in_memory_rows):
    rng = np.random.default_rng(3)
    data = {"hot": np.concatenate([rng.lognormal(0, 4, 3000), np.full(1500, 2.5)]),
            "spread": 2.0 ** rng.integers(-30, 30, 400).astype(float), "one": np.array([7.0]),
            "same": np.full(60, -1.25), "few": np.array([3.0, 1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None), ("hot", NAN)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    probs = (0.0, 0.025, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, ["g"], in_memory_rows).collect()}
    for g, vs in data.items():
        assert got[g]["n"] == len(vs)
        for i, p in enumerate(probs):
            assert math.isclose(got[g][f"q{i}"], float(np.quantile(vs, p)), rel_tol=1e-12), (g, p)
    whole = exact_quantiles(df, "v", [0.5], in_memory_rows=in_memory_rows).first()
    assert whole["q0"] == float(np.median(np.concatenate(list(data.values()))))


@pytest.mark.parametrize("spread", ["wide", "ties", "constant"])
def test_bracketed_quantiles_of_any_distribution(spark, spread):
    """Values over 260 powers of ten, few distinct ones, a single one: brackets hold few rows and the result is exact."""
    rng = np.random.default_rng(6)
    values = {"wide": np.exp(rng.uniform(-300, 300, 5000)), "ties": rng.integers(0, 4, 5000).astype(float),
              "constant": np.full(5000, 2.5)}[spread]
    group = rng.integers(0, 2, 5000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(group, values)], "g INT, _v DOUBLE").repartition(3)
    probs = [0.0, 0.003, 0.25, 0.5, 0.98, 1.0]
    targets, near = quantiles._near(df, ["g"], probs, 100)
    for r in targets.collect():
        own = values[group == r["g"]]
        assert r["below"] == (own < r["lo"]).sum()
        rank = probs[r["i"]] * (len(own) - 1)
        assert np.sort(own)[int(np.floor(rank))] >= r["lo"] and np.sort(own)[int(np.ceil(rank))] <= r["hi"]
    if spread == "wide":
        # Of each group at most 4 / accuracy of its rows, and the summary's error, for every quantile.
        assert near.agg(F.sum("c")).first()[0] < 6 * 2 * 0.065 * 2500
    for r in quantiles._by_brackets(df, ["g"], probs, 100).collect():
        assert np.allclose(r["q"], np.quantile(values[group == r["g"]], probs), rtol=1e-12) and r["n"] == (group == r["g"]).sum()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_with_a_hot_key(spark, how):
    fact = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 40}", i) for i in range(200)]
                                 + [(None, -1), ("none", -2)], "k STRING, i INT")
    lookup = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(30)], "k STRING, w DOUBLE")
    plain = sorted(map(str, fact.join(lookup, ["k"], how).collect()))
    assert plain == sorted(map(str, sizes.lookup_join(fact, lookup, ["k"], how).collect()))
    split_up = sizes.lookup_join(fact, lookup, ["k"], how, max_rows=10, heavy_rows=100)
    assert "Union" in split_up._jdf.queryExecution().optimizedPlan().toString()
    assert plain == sorted(map(str, split_up.collect()))


def test_checked_broadcast_respects_the_bound(spark):
    df = spark.range(50)
    assert sizes.checked_broadcast(df, 50)[1] and not sizes.checked_broadcast(df, 49)[1]


def test_hash_cutoffs_and_ranks(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    hashes = sorted(r[0] for r in df.select(fn.row_hash(["k"], 9)).collect())
    ranks = [0, 1, 17, 2500, 5000]
    cuts = ranking.hash_cutoffs(df, ["k"], 9, ranks, digits=1)
    assert cuts == ["", *[hashes[r - 1] for r in ranks[1:]]]
    assert df.where(fn.row_hash(["k"], 9) <= cuts[2]).count() == 17
    with pytest.raises(ValueError):
        ranking.hash_cutoffs(df, ["k"], 9, [5001])
    ranked = ranking.hash_rank(df.withColumn("p", F.col("k") % 3), fn.row_hash(["k"], 9), by=["p"])
    for part in range(3):
        own = [(r["_2"], r["rank"]) for r in ranked.where(F.col("p") == part).select(
            fn.row_hash(["k"], 9).alias("_2"), "rank").collect()]
        assert [r for _, r in sorted(own)] == list(range(1, len(own) + 1))


def test_samples_and_folds(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    assert split.sample_fraction(df, ["k"], 0.1).count() == 100
    assert split.sample_n(df, ["k"], 5000).count() == 1003
    folds = sorted(r["count"] for r in split.kfold_assign(df, ["k"], 10).groupBy("fold").count().collect())
    assert folds == [100] * 7 + [101] * 3
    shuffled = split.permute_column(df.withColumn("v", F.col("k") * 2), ["k"], "v").collect()
    assert sorted(r["v"] for r in shuffled) == [2 * i for i in range(1003)]
    assert sum(r["v"] == 2 * r["k"] for r in shuffled) < 20


def test_box_and_correlation_edges(spark):
    df = spark.createDataFrame([("one", 3.0, 1.0)] + [("many", float(v), 1.0) for v in [1, 2, 3, 4, 100]],
                               "code STRING, v DOUBLE, c DOUBLE")
    box = {r["code"]: r for r in aggregates.box_stats(df, "v", ["code"]).collect()}
    assert (box["one"]["q25"], box["one"]["whisker_high"], box["one"]["outliers"]) == (3.0, 3.0, 0)
    assert (box["many"]["median"], box["many"]["whisker_high"], box["many"]["outliers"]) == (3.0, 4.0, 1)
    assert aggregates.corr_matrix(df, ["v", "c"]).first()["r"] is None


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=700)
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    want, edges = np.histogram(values, bins="auto")
    got = aggregates.histogram_auto(df, "v").orderBy("bin").collect()
    assert [r["n"] for r in got] == list(want)
    assert np.allclose([r["lower"] for r in got], edges[:-1])
    constant = aggregates.histogram_auto(spark.createDataFrame([(2.0,)] * 4, "v DOUBLE"), "v").collect()
    assert [(r["lower"], r["upper"], r["n"]) for r in constant] == [(1.5, 2.5, 4)]


def test_density_follows_the_kernel_sum(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(0.2, 0.05, 400)
    df = spark.createDataFrame([("a", float(v)) for v in values], "code STRING, value DOUBLE")
    got = aggregates.density_curve(df, "value", ["code"], points=256).orderBy("point").collect()
    iqr = np.subtract(*np.quantile(values, [0.75, 0.25]))
    h = 0.9 * min(values.std(ddof=1), iqr / 1.34) * len(values) ** -0.2
    assert math.isclose(got[0]["bandwidth"], h, rel_tol=1e-9)
    at = np.array([r["at"] for r in got])
    kernel = np.exp(-0.5 * ((at[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in got], kernel, rtol=0.02, atol=0.02)


def test_split_gain_equals_direct_sum(spark):
    rng = np.random.default_rng(4)
    g, h, b = rng.normal(size=200), rng.uniform(0.5, 1, 200), rng.integers(0, 8, 200)
    df = spark.createDataFrame([(float(x), float(y), int(z)) for x, y, z in zip(g, h, b)], "g DOUBLE, h DOUBLE, b INT")
    got = {r["bin"]: r["gain"] for r in aggregates.split_gain_scan(
        df, {"f": F.col("b")}, F.col("g"), F.col("h")).collect()}
    for cut in range(8):
        left = b < cut
        want = (g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
                - g.sum() ** 2 / (h.sum() + 1))
        assert math.isclose(got[cut], want, rel_tol=1e-9, abs_tol=1e-9)


def test_reshape_round_trip(spark):
    long = spark.createDataFrame([(1, a, float(a)) for a in range(12)], "k INT, age INT, cases DOUBLE")
    wide = reshape.ages_to_wide(long, ["k"], 12)
    assert wide.columns == ["k", *[f"Age_{a:02d}" for a in range(12)]]
    assert sorted(reshape.ages_to_long(wide, ["k"]).collect()) == sorted(long.collect())


def test_catalytic_cases_and_totals(spark):
    index = spark.createDataFrame([(1, "AAA"), (2, "BBB"), (3, "MAC"), (4, "Low"), (5, "High"), (6, "HKG")],
                                  "region_id INT, code STRING")
    rules = burden.country_rules(index, ["MAC"], {"Low": "NPL", "High": "NPL"}, {"HKG": "AAA"}, {"HKG": "AAA"})
    by_code = {r["code"]: r for r in rules.collect()}
    assert by_code["MAC"]["profile_code"] is None and by_code["Low"]["case_code"] == "NPL"
    assert by_code["HKG"]["case_code"] == "AAA" and by_code["HKG"]["foi_code"] == "HKG"
    ages = spark.createDataFrame([("AAA", a, float(a + 1)) for a in range(100)]
                                 + [("NPL", a, 1.0 + (a == 3)) for a in range(100)], "country STRING, age INT, pop DOUBLE")
    profile = burden.age_profile(burden.age_share(ages), rules).persist()
    shares = {}
    for r in profile.collect():
        shares.setdefault(r["profile_code"], {})[r["age"]] = r["share"]
    assert set(shares) == {"AAA", "BBB", "NPL"} and set(shares["BBB"].values()) == {0.01}
    assert all(math.isclose(sum(s.values()), 1.0) for s in shares.values())
    pixels = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 10.0, 1), (5.0, 0.0, 0.5, 10.0, 2), (10.0, 0.0, 0.1, 0.0, 4), (15.0, 0.0, 0.2, 7.0, 3),
         (20.0, 0.0, 0.3, 100.0, 6)], "x DOUBLE, y DOUBLE, foi DOUBLE, pop DOUBLE, region_id INT").join(rules, "region_id")
    long = burden.catalytic_cases(burden.pop_by_age(pixels, profile), 0.003)
    assert long.count() == 400  # the dropped region has no rows
    by_age = {(r["x"], r["age"]): r["cases"] for r in long.collect()}
    for a in (0, 99):
        want = (1 - math.exp(-0.3)) * math.exp(-0.3 * a) * 0.003 * 100 * shares["AAA"][a]
        assert math.isclose(by_age[(20.0, a)], want, rel_tol=1e-12)
    totals = {r["x"]: r["cases"] for r in burden.cases_total(pixels, profile, 0.003).collect()}
    summed = {r["x"]: r["total"] for r in aggregates.row_total(long).collect()}
    assert totals.keys() == summed.keys() and totals[0.0] == 0.0 and totals[10.0] == 0.0
    assert all(math.isclose(totals[x], summed[x], rel_tol=1e-9) for x in totals)
    regional = {r["code"]: r["cases"] for r in burden.cases_by_region(
        burden.cases_total(pixels, profile, 0.003), rules).collect()}
    assert regional["MAC"] == 0.0 and regional["High"] == 0.0 and regional["HKG"] > 0


def test_rank_bands_cuts(spark):
    df = spark.createDataFrame([(f"C{i:02d}", float(i)) for i in range(25)], "code STRING, cases DOUBLE")
    bands = [r["band"] for r in aggregates.rank_bands(df, "cases", compare.CASE_CUTS, compare.CASE_BANDS)
             .orderBy("rank").collect()]
    assert [bands.count(b) for b in compare.CASE_BANDS] == [6, 10, 7, 2]


def test_stateless_operators_run_on_a_stream(spark, tmp_path):
    schema = "pixel_id INT, x DOUBLE, y DOUBLE, foi DOUBLE, age INT, pop_age DOUBLE"
    spark.createDataFrame([(1, 5.0, 10.0, 0.2, 3, 50.0)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    cases = burden.catalytic_cases(keys.pixel_key(stream), 0.003)
    running = (cases.writeStream.format("memory").queryName("cases_stream").outputMode("append")
               .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    running.awaitTermination(120)
    row = spark.table("cases_stream").first()
    assert (row["kx"], row["ky"]) == (1, 2)
    assert math.isclose(row["cases"], (1 - math.exp(-0.2)) * math.exp(-0.6) * 0.003 * 50)
