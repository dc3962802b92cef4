"""Projections, filters, missing values and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid import functions as fn
from riskgrid.operators import aggregates, burden, compare, keys, quality, reshape, split
from riskgrid.plans import case_generation, comparison
from riskgrid.roles import Roles
from workload import tables as t
from workload.registry import query
from workload.scans import pooled, rounded

ROLES = Roles(label="foi", climate=("f1", "f2", "f3"), other=("f4", "f5", "ur"), category=("ur",))


@query("select_features", """
    SELECT round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3 FROM pixels""")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.select_features(t.pixels(spark, sf_dir), "climate", ROLES))


@query("drop_na_rows", """
    SELECT pixel_id, round(f1, 6) AS f1, round(foi, 6) AS foi, ur FROM pixels
    WHERE f1 IS NOT NULL AND foi IS NOT NULL AND ur IS NOT NULL""")
def drop_na_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "f1", "foi", "ur").select("pixel_id", "f1", "foi", "ur")
    return rounded(quality.drop_na_rows(df))


@query("na_report", """
    SELECT split, count(*) FILTER (f1 IS NULL OR f2 IS NULL OR f3 IS NULL OR foi IS NULL) AS na_rows,
           count(*) AS total,
           round_even(count(*) FILTER (f1 IS NULL OR f2 IS NULL OR f3 IS NULL OR foi IS NULL)
                      / count(*)::DOUBLE * 100, 2) AS na_percent
    FROM pixel_splits GROUP BY split""")
def na_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = keys.align_grid(t.pixels(spark, sf_dir, "f1", "f2", "f3", "foi"), t.grid(spark, sf_dir))
    return quality.na_report(split.group_split(df), "split")


@query("project_coords", "SELECT x, py AS y, round(yhat, 10) AS predict FROM predictions")
def project_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.predictions(spark, sf_dir).select("x", F.col("py").alias("y"), F.col("yhat").alias("predict"))
    return rounded(quality.project_coords(df, ["predict"]), 10, "predict")


@query("tail_filter", """
    SELECT pixel_id, round(foi, 6) AS foi, round(f1, 6) AS f1 FROM pixels WHERE foi > 0.25e0""")
def tail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "foi", "f1").select("pixel_id", "foi", "f1")
    return rounded(quality.tail_filter(df, "foi"))


@query("tail_share", "SELECT round(avg((foi > 0.25e0)::INTEGER), 8) AS share FROM pixels")
def tail_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.tail_share(t.pixels(spark, sf_dir, "foi"), "foi"), 8)


@query("year_slice", """
    SELECT code, draw, year, round(cases, 6) AS cases FROM modelled_cases
    WHERE year = (SELECT max(year) FROM modelled_cases)""")
def year_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.year_slice(t.modelled_cases(spark, sf_dir)), 6)


@query("row_select", """
    SELECT n_nationkey AS region_id, n_name AS code FROM nation
    WHERE n_nationkey IN (0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 14, 18, 19, 20, 21, 22, 23)""")
def row_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = [*range(0, 6), *range(10, 15), *range(18, 24)]
    return compare.row_select(t.country_index(spark, sf_dir), "region_id", chosen)


@query("relabel", """
    SELECT pixel_id AS "Pixel", round(f4, 2) AS "Cases",
           CASE ur WHEN '1-URGENT' THEN 'WHO-IG' WHEN '2-HIGH' THEN 'Mapping' ELSE ur END AS "Method"
    FROM pixels""")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "ur", "f4").select("pixel_id", "ur", F.round("f4", 2).alias("f4"))
    return quality.relabel(df, {"pixel_id": "Pixel", "ur": "Method", "f4": "Cases"}, "Method",
                           {"1-URGENT": "WHO-IG", "2-HIGH": "Mapping"})


@query("round_half_even", """
    SELECT o_orderkey AS pixel_id, round_even(o_totalprice / 1000, 0) AS cases,
           round_even((o_orderkey % 100) / 2e0, 0) AS half FROM orders""")
def round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pixel_id"),
        fn.half_even(F.col("o_totalprice") / 1000).alias("cases"),
        fn.half_even((F.col("o_orderkey") % 100) / 2).alias("half"))


@query("inverse_link", """
    SELECT pixel_id, round(1 / (1 + exp(-yhat)), 8) AS predict, round(1 / (1 + exp(-lower)), 8) AS lower,
           round(1 / (1 + exp(-upper)), 8) AS upper FROM predictions""")
def inverse_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.predictions(spark, sf_dir)
    return df.select("pixel_id", *[
        F.round(fn.inverse_link(F.col(c), "logit"), 8).alias(name)
        for c, name in (("yhat", "predict"), ("lower", "lower"), ("upper", "upper"))])


# -- joins ----------------------------------------------------------------------------------------

@query("coord_match_check", """
    SELECT count(*) AS left_rows, count(*) FILTER (g.x IS NULL) AS unmatched,
           count(*) - count(DISTINCT (p.x, p.y)) AS left_duplicate_keys,
           (SELECT count(*) - count(DISTINCT (x, y)) FROM grid) AS right_duplicate_keys,
           count(*) FILTER (g.x IS NULL) = 0 AS matched
    FROM pixels p LEFT JOIN grid g ON g.x = p.x AND g.y = p.y""")
def coord_match_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.coord_match_check(t.pixels(spark, sf_dir, "ur"), t.grid(spark, sf_dir))


@query("align_grid", """
    SELECT p.pixel_id, p.x, p.y, p.f4, g.grid_id FROM pixels p JOIN grid g ON g.x = p.x AND g.y = p.y""")
def align_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.align_grid(t.pixels(spark, sf_dir, "f4"), t.grid(spark, sf_dir))


@query("align_shifted_grid", """
    SELECT p.pixel_id, round(p.x + 2.5, 6) AS x, round(p.y + 1.25, 6) AS y, g.grid_id
    FROM pixels p JOIN grid g ON g.x = p.x AND g.y = p.y""")
def align_shifted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice whose points lie at half and quarter cells, with float noise on one side."""
    def moved(df: DataFrame, noise: float) -> DataFrame:
        return df.withColumns({"x": F.col("x") + (2.5 + noise), "y": F.col("y") + (1.25 - noise)})

    out = keys.align_grid(moved(t.pixels(spark, sf_dir, "ur"), -1e-12), moved(t.grid(spark, sf_dir), 1e-12))
    return out.select("pixel_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "grid_id")


@query("coord_tolerance_check", """
    SELECT count(*) AS n, 0::BIGINT AS left_unmatched, 0::BIGINT AS right_unmatched,
           max(abs(p.x - g.x)) AS max_dx, max(abs(p.y - g.y)) AS max_dy,
           max(abs(p.x - g.x)) < 1.9e-12 AND max(abs(p.y - g.y)) = 0 AS within
    FROM pixels p JOIN grid g ON g.pixel_id = p.pixel_id""")
def coord_tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.coord_tolerance_check(t.pixels(spark, sf_dir, "ur"), t.regions(spark, sf_dir))


@query("pixel_key", """
    SELECT pixel_id, round(x / 5)::BIGINT AS kx, round(y / 5)::BIGINT AS ky FROM pixels""")
def pixel_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pixel_key(t.pixels(spark, sf_dir, "ur")).select("pixel_id", "kx", "ky")


@query("split_membership", "SELECT x, y, grid_id FROM pixel_splits WHERE split = 'validate'")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = t.grid(spark, sf_dir)
    return split.split_membership(grid, split.group_split_table(grid), "validate").select(
        "x", "y", "grid_id")


@query("region_join", """
    SELECT x, y, region_id, code, profile_code, case_code, foi_code FROM located""")
def region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burden.region_join(t.foi_map(spark, sf_dir), t.regions(spark, sf_dir),
                              t.rules(spark, sf_dir)).drop("foi")


@query("age_profile_join", "SELECT profile_code, age, share FROM profile")
def age_profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_generation.profile(t.case_inputs(spark, sf_dir))


def mapped_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = t.case_inputs(spark, sf_dir)
    merged = reshape.merge_regions(
        case_generation.generate_cases(inputs).select("code", "cases"), inputs.rules, "case_code")
    return aggregates.country_sum(merged)


def modelled_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = aggregates.year_slice(t.modelled_cases(spark, sf_dir))
    return aggregates.draw_mean(compare.region_fold_draws(last, t.MODEL_PARENTS))


@query("source_compare_join", """
    SELECT coalesce(a.code, b.code) AS code, round(a.cases, 4) AS map, round(b.cases, 9) AS mod
    FROM (SELECT case_code AS code, sum(cases) AS cases FROM pixel_cases GROUP BY 1) a
    FULL JOIN (SELECT code, avg(cases) AS cases FROM draws_folded
               WHERE year = (SELECT max(year) FROM modelled_cases) GROUP BY code) b ON a.code = b.code""")
def source_compare_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compare.source_compare_join(mapped_cases(spark, sf_dir), modelled_means(spark, sf_dir), "full_outer")
    return rounded(rounded(df, 4, "map"), 9, "mod")


@query("external_compare", """
    SELECT r.code, round(r.reference, 6) AS reference, round(m.cases, 6) AS mapped
    FROM (SELECT code, sum(cases) AS reference FROM modelled_cases WHERE year = 1998 GROUP BY code) r
    JOIN (SELECT case_code AS code, sum(cases) AS cases FROM pixel_cases GROUP BY 1) m ON m.code = r.code""")
def external_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.external_compare(
        t.modelled_cases(spark, sf_dir), mapped_cases(spark, sf_dir), 1998), 6)


# -- comparison with the second source ------------------------------------------------------------

@query("region_fold_draws", "SELECT code, draw, year, round(cases, 6) AS cases FROM draws_folded")
def region_fold_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.region_fold_draws(t.modelled_cases(spark, sf_dir), t.MODEL_PARENTS), 6)


@query("draw_mean", """
    SELECT code, round(avg(cases), 9) AS cases FROM draws_folded
    WHERE year = (SELECT max(year) FROM modelled_cases) GROUP BY code""")
def draw_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modelled_means(spark, sf_dir), 9)


@query("pool_by_country", "SELECT code, round(value, 6) AS value FROM mapped_foi")
def pool_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooled(spark, sf_dir))


@query("posterior_pool", "SELECT code, round(value, 6) AS value FROM posterior")
def posterior_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.posterior_pool(t.modelled_foi(spark, sf_dir)))


TAGGED = """(SELECT code, value, 'Mapping' AS method FROM mapped_foi
             UNION ALL SELECT code, value, 'WHO-IG' FROM posterior)"""


@query("method_mean", f"""
    SELECT code, method, round(avg(value), 8) AS mean_value, count(*) AS n FROM {TAGGED} GROUP BY ALL""")
def method_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = compare.tag_sources(pooled(spark, sf_dir),
                                 compare.posterior_pool(t.modelled_foi(spark, sf_dir)))
    return rounded(aggregates.method_mean(tagged), 8, "mean_value")


@query("cases_mapping_vs_model", """
    SELECT code, rank, band, method, cases FROM (
        SELECT code, rank, CASE WHEN rank <= 6 THEN '1' WHEN rank <= 17 THEN '2' WHEN rank <= 23 THEN '3'
                                ELSE '4' END AS band, "WHO-IG", "Mapping"
        FROM (SELECT a.code, round_even(b.cases, 0) AS "WHO-IG", round_even(a.cases, 0) AS "Mapping",
                     row_number() OVER (ORDER BY round_even(b.cases, 0), a.code)::INTEGER AS rank
              FROM (SELECT case_code AS code, sum(cases) AS cases FROM pixel_cases GROUP BY 1) a
              JOIN (SELECT code, avg(cases) AS cases FROM draws_folded
                    WHERE year = (SELECT max(year) FROM modelled_cases) GROUP BY code) b
                ON a.code = b.code))
    UNPIVOT (cases FOR method IN ("WHO-IG", "Mapping"))""")
def cases_mapping_vs_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.compare_cases(t.case_inputs(spark, sf_dir), t.modelled_cases(spark, sf_dir),
                                    t.MODEL_PARENTS)


@query("cases_bands", """
    SELECT code, cases, rank,
           CASE WHEN rank <= 6 THEN '[1] Below 400 Cases' WHEN rank <= 16 THEN '[2] 400 - 2000 Cases'
                WHEN rank <= 23 THEN '[3] 2000 - 20000 Cases' ELSE '[4] Above 20000 Cases' END AS band
    FROM (SELECT code, cases, row_number() OVER (ORDER BY cases, code)::INTEGER AS rank
          FROM (SELECT case_code AS code, round_even(sum(cases), 0) AS cases FROM pixel_cases GROUP BY 1))""")
def cases_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = t.case_inputs(spark, sf_dir)
    return compare.cases_bands(case_generation.generate_cases(inputs), inputs.rules)


@query("foi_mapping_vs_posterior", """
    SELECT v.code, v.method, round(avg(v.value), 8) AS mean_value, count(*) AS n,
           round(any_value(b.q1), 8) AS q25, round(any_value(b.q2), 8) AS median,
           round(any_value(b.q3), 8) AS q75,
           round(min(v.value) FILTER (v.value >= b.q1 - 1.5e0 * (b.q3 - b.q1)), 8) AS whisker_low,
           round(max(v.value) FILTER (v.value <= b.q3 + 1.5e0 * (b.q3 - b.q1)), 8) AS whisker_high,
           count(*) FILTER (v.value < b.q1 - 1.5e0 * (b.q3 - b.q1)
                            OR v.value > b.q3 + 1.5e0 * (b.q3 - b.q1)) AS outliers
    FROM """ + TAGGED + """ v JOIN (
        SELECT code, method, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
               quantile_cont(value, 0.75) AS q3 FROM """ + TAGGED + """ GROUP BY ALL) b
      ON b.code = v.code AND b.method = v.method
    WHERE v.code IN (SELECT code FROM mapped_foi) GROUP BY v.code, v.method""")
def foi_mapping_vs_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = t.pixels(spark, sf_dir, "foi", "region_id").join(t.country_index(spark, sf_dir), "region_id")
    return rounded(comparison.compare_foi(located, t.rules(spark, sf_dir), t.modelled_foi(spark, sf_dir)), 8)
