"""Aggregations, ordered tables, reshaping, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid import functions as fn
from riskgrid.operators import aggregates, quality, reshape, split
from riskgrid.plans import case_generation
from workload import tables as t
from workload.registry import query
from workload.scans import pooled, rounded


@query("group_freq", "SELECT grid_id, n FROM group_sizes")
def group_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_freq(t.grid(spark, sf_dir))


@query("country_sum", "SELECT code, round(sum(cases), 6) AS cases FROM modelled_cases GROUP BY code")
def country_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.country_sum(t.modelled_cases(spark, sf_dir)), 6)


@query("row_total", "SELECT x, y, round(sum(cases), 6) AS total FROM age_cases GROUP BY x, y")
def row_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = case_generation.generate_cases_by_age(t.case_inputs(spark, sf_dir))
    return rounded(aggregates.row_total(ages), 6, "total")


@query("mse", "SELECT round(avg((y - yhat) ** 2), 8) AS mse FROM predictions")
def mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.mse(t.predictions(spark, sf_dir)), 8)


@query("rmse", "SELECT round(sqrt(avg((y - yhat) ** 2)), 8) AS rmse FROM predictions")
def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.rmse(t.predictions(spark, sf_dir)), 8)


@query("r_squared", "SELECT round(1 - avg((y - yhat) ** 2) / var_pop(y), 8) AS r2 FROM predictions")
def r_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.r_squared(t.predictions(spark, sf_dir)), 8)


@query("pinball_score", """
    SELECT round(sum(CASE WHEN y - yhat < 0 THEN (0.95e0 - 1) * (y - yhat) ELSE 0.95e0 * (y - yhat) END), 4)
           AS cost,
           round(1 / sum(CASE WHEN y - yhat < 0 THEN (0.95e0 - 1) * (y - yhat)
                              ELSE 0.95e0 * (y - yhat) END), 8) AS score FROM predictions""")
def pinball_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregates.pinball_score(t.predictions(spark, sf_dir), 0.95)
    return df.select(F.round("cost", 4).alias("cost"), F.round("score", 8).alias("score"))


FEATURES = ["f1", "f2", "f3", "f4", "f5"]


def _describe_sql(where: str) -> str:
    return " UNION ALL ".join(f"""
        SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean,
               round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
               round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
               round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max
        FROM pixels WHERE {where}""" for c in FEATURES)


@query("describe_columns", _describe_sql("TRUE"))
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.describe_columns(t.pixels(spark, sf_dir, *FEATURES), FEATURES), 6)


@query("describe_tail", _describe_sql("foi > 0.25e0"))
def describe_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.tail_filter(t.pixels(spark, sf_dir, *FEATURES, "foi"), "foi")
    return rounded(aggregates.describe_columns(df, FEATURES), 6)


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM pixels"
    for i, a in enumerate([*FEATURES, "foi"]) for b in [*FEATURES, "foi"][i + 1:]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*FEATURES, "foi"]
    return rounded(aggregates.corr_matrix(t.pixels(spark, sf_dir, *columns), columns), 8)


@query("histogram_auto", """
    SELECT b.bin::INTEGER AS bin, round(s.lo + b.bin * s.w, 8) AS lower,
           round(s.lo + (b.bin + 1) * s.w, 8) AS upper, count(p.foi) AS n
    FROM (SELECT lo, hi, bins, (hi - lo) / bins AS w FROM (
             SELECT lo, hi, ceil((hi - lo) / CASE WHEN q3 > q1 THEN least((hi - lo) / (log2(n) + 1),
                                     2 * (q3 - q1) / n ** (1 / 3e0)) ELSE (hi - lo) / (log2(n) + 1) END)
                    ::BIGINT AS bins
             FROM (SELECT count(foi)::DOUBLE AS n, min(foi) AS lo, max(foi) AS hi,
                          quantile_cont(foi, 0.25) AS q1, quantile_cont(foi, 0.75) AS q3 FROM pixels))) s
    CROSS JOIN LATERAL (SELECT unnest(range(s.bins)) AS bin) b
    LEFT JOIN (SELECT foi FROM pixels WHERE foi IS NOT NULL) p
           ON least(s.bins - 1, floor((p.foi - s.lo) / s.w)) = b.bin
    GROUP BY b.bin, s.lo, s.w""")
def histogram_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.histogram_auto(t.pixels(spark, sf_dir, "foi"), "foi"), 8)


@query("density_curve", """
    SELECT * FROM (WITH frame AS (
            SELECT code, n, lo, h, (hi - lo) / 63 AS step
            FROM (SELECT code, n, lo, hi, 0.9e0 * n ** (-0.2e0) * coalesce(
                         CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd END, 1) AS h
                  FROM (SELECT code, count(*)::DOUBLE AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd,
                               (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34e0 AS iqr
                        FROM mapped_foi WHERE value IS NOT NULL GROUP BY code))),
        placed AS (
            SELECT code, position, least(floor(position), 62)::INTEGER AS place
            FROM (SELECT code, coalesce((value - lo) / nullif(step, 0), 0) AS position
                  FROM mapped_foi JOIN frame USING (code) WHERE value IS NOT NULL)),
        weights AS (
            SELECT code, place, sum(w) AS w
            FROM (SELECT code, place, 1 - (position - place) AS w FROM placed
                  UNION ALL SELECT code, place + 1, position - place FROM placed) GROUP BY code, place)
        SELECT f.code, p.point::INTEGER AS point, round(f.lo + p.point * f.step, 6) AS at,
               round(sum(w.w * exp(-0.5e0 * ((p.point - w.place) * f.step / f.h) ** 2))
                     / (f.n * f.h * sqrt(2 * pi())), 6) AS density, round(f.h, 6) AS bandwidth
        FROM frame f CROSS JOIN (SELECT unnest(range(64)) AS point) p JOIN weights w ON w.code = f.code
        GROUP BY f.code, p.point, f.lo, f.step, f.n, f.h)""")
def density_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.density_curve(pooled(spark, sf_dir), "value", ["code"]))


@query("box_stats", """
    SELECT p.region_id, count(*) AS n, round(any_value(b.q1), 6) AS q25, round(any_value(b.q2), 6) AS median,
           round(any_value(b.q3), 6) AS q75,
           round(min(f4) FILTER (f4 >= b.q1 - 1.5e0 * (b.q3 - b.q1)), 6) AS whisker_low,
           round(max(f4) FILTER (f4 <= b.q3 + 1.5e0 * (b.q3 - b.q1)), 6) AS whisker_high,
           count(*) FILTER (f4 < b.q1 - 1.5e0 * (b.q3 - b.q1) OR f4 > b.q3 + 1.5e0 * (b.q3 - b.q1))
           AS outliers
    FROM pixels p JOIN (SELECT region_id, quantile_cont(f4, 0.25) AS q1, quantile_cont(f4, 0.5) AS q2,
                               quantile_cont(f4, 0.75) AS q3 FROM pixels GROUP BY region_id) b
      ON b.region_id = p.region_id GROUP BY p.region_id""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.box_stats(t.pixels(spark, sf_dir, "f4", "region_id"), "f4", ["region_id"]))


@query("interval_summary", """
    SELECT least(9, floor(y / 0.05e0))::INTEGER AS bin, count(*) AS n,
           round(avg((y BETWEEN lower AND upper)::INTEGER), 8) AS coverage,
           round(avg(upper - lower), 8) AS mean_width
    FROM predictions WHERE y IS NOT NULL GROUP BY 1""")
def interval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.interval_summary(t.predictions(spark, sf_dir)), 8)


@query("scatter_table", " UNION ALL ".join(f"""
    SELECT '{c}' AS variable, least(19, floor(({c} - lo) / (hi - lo) * 20))::INTEGER AS bin, count(*) AS n,
           round(avg({c}), 4) AS mean_value, round(avg(foi), 6) AS mean_label
    FROM pixels, (SELECT min({c}) AS lo, max({c}) AS hi FROM pixels)
    WHERE {c} IS NOT NULL AND foi IS NOT NULL GROUP BY 2""" for c in FEATURES))
def scatter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregates.scatter_table(t.pixels(spark, sf_dir, *FEATURES, "foi"), FEATURES, "foi")
    return rounded(rounded(df, 4, "mean_value"), 6, "mean_label")


# -- ordered tables -------------------------------------------------------------------------------

@query("rank_bands", """
    SELECT code, cases, rank, CASE WHEN rank <= 6 THEN '1' WHEN rank <= 17 THEN '2'
                                   WHEN rank <= 23 THEN '3' ELSE '4' END AS band
    FROM (SELECT code, cases, row_number() OVER (ORDER BY cases, code)::INTEGER AS rank
          FROM (SELECT code, round(sum(cases), 6) AS cases FROM modelled_cases GROUP BY code))""")
def rank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rounded(aggregates.country_sum(t.modelled_cases(spark, sf_dir)), 6)
    return aggregates.rank_bands(totals, "cases", (6, 17, 23, 25))


@query("split_gain_scan", """
    SELECT feature, bin, round(gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1), 4) AS gain
    FROM (SELECT feature, bin, coalesce(sum(g) OVER w, 0) AS gl, coalesce(sum(h) OVER w, 0) AS hl,
                 sum(g) OVER (PARTITION BY feature) AS g, sum(h) OVER (PARTITION BY feature) AS h
          FROM (SELECT feature, bin, sum(g) AS g, sum(h) AS h FROM (
                    SELECT 'f1' AS feature, floor(f1)::INTEGER AS bin, foi - 0.25e0 AS g, 1e0 AS h
                    FROM pixels WHERE foi IS NOT NULL
                    UNION ALL SELECT 'f3', floor(f3 * 1000)::INTEGER, foi - 0.25e0, 1e0
                    FROM pixels WHERE foi IS NOT NULL) GROUP BY feature, bin)
          WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def split_gain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "f1", "f3", "foi").where("foi IS NOT NULL")
    bins = {"f1": F.floor("f1"), "f3": F.floor(F.col("f3") * 1000)}
    return rounded(aggregates.split_gain_scan(df, bins, F.col("foi") - 0.25, F.lit(1.0)), 4)


@query("sort_by_actual", """
    SELECT pixel_id, round(y, 10) AS y, round(yhat, 10) AS yhat FROM predictions ORDER BY y, pixel_id""")
def sort_by_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.predictions(spark, sf_dir).select("pixel_id", "y", "yhat")
    return rounded(aggregates.sort_by_actual(df, "y", ["pixel_id"]), 10)


@query("head_rows", "SELECT pixel_id, x, y, f4 FROM pixels ORDER BY pixel_id LIMIT 5")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.head_rows(t.pixels(spark, sf_dir, "f4"), ["pixel_id"], 5)


# -- set operations and reshaping -----------------------------------------------------------------

@query("union_splits", "SELECT pixel_id, ur, split FROM pixel_splits")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "ur").join(t.grid(spark, sf_dir), ["x", "y"])
    marked = split.group_split(df).select("pixel_id", "ur", "split")
    return reshape.union_splits(*[marked.where(F.col("split") == s)
                                  for s in ("train", "validate", "test")])


@query("merge_regions", """
    SELECT r.case_code AS code, p.pixel_id FROM pixels p JOIN rules r ON r.region_id = p.region_id
    WHERE r.case_code IS NOT NULL""")
def merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "region_id").join(t.country_index(spark, sf_dir), "region_id")
    return reshape.merge_regions(df.select("code", "pixel_id"), t.rules(spark, sf_dir), "case_code")


@query("melt_methods", """
    SELECT pixel_id, 'WHO-IG' AS method, f4 AS cases FROM pixels
    UNION ALL SELECT pixel_id, 'Mapping', f5 FROM pixels""")
def melt_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "f4", "f5").select(
        "pixel_id", F.col("f4").alias("mod"), F.col("f5").alias("map"))
    return reshape.melt_methods(df, {"mod": "WHO-IG", "map": "Mapping"}, ["pixel_id"])


@query("ages_wide", """
    SELECT country, """ + ", ".join(
    f"round(coalesce(sum(pop) FILTER (age = {a}), 0), 2) AS \"Age_{a:02d}\"" for a in range(t.N_AGES)) + """
    FROM age_population GROUP BY country""")
def ages_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = reshape.ages_to_wide(t.age_population(spark, sf_dir), ["country"], t.N_AGES, "pop")
    return rounded(wide.na.fill(0.0), 2)


@query("ages_long", """
    SELECT country, age::INTEGER AS age, round(pop, 2) AS pop FROM age_population""")
def ages_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = reshape.ages_to_wide(t.age_population(spark, sf_dir), ["country"], t.N_AGES, "pop")
    return rounded(reshape.ages_to_long(wide, ["country"], "pop").where("pop IS NOT NULL"), 2)


@query("zip_columns", """
    SELECT pixel_id, round(y, 10) AS y, round(yhat, 10) AS yhat, round(lower, 10) AS lower,
           round(upper, 10) AS upper FROM predictions""")
def zip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reshape.zip_columns(t.predictions(spark, sf_dir)), 10)


@query("distinct_values", "SELECT DISTINCT country FROM age_population")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.distinct_values(t.age_population(spark, sf_dir), "country")


# -- sampling and splitting -----------------------------------------------------------------------

@query("group_split", "SELECT x, y, grid_id, split FROM pixel_splits")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_split(t.grid(spark, sf_dir))


@query("split_counts", "SELECT split, count(*) AS n_groups FROM group_splits GROUP BY split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(split.group_split_table(t.grid(spark, sf_dir)))


@query("sample_fraction", """
    SELECT pixel_id, f4 FROM (SELECT pixel_id, f4, row_number() OVER (ORDER BY md5(pixel_id || ':1')) AS r,
                                     count(*) OVER () AS c FROM pixels)
    WHERE r <= round_even(0.1e0 * c, 0)""")
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "f4").select("pixel_id", "f4")
    return split.sample_fraction(df, ["pixel_id"], 0.1, seed=1)


@query("sample_n", """
    SELECT pixel_id, f4 FROM pixels ORDER BY md5(pixel_id || ':7') LIMIT 100""")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample_n(t.pixels(spark, sf_dir, "f4").select("pixel_id", "f4"), ["pixel_id"], 100, seed=7)


@query("sample_n_large", """
    SELECT pixel_id FROM pixels ORDER BY md5(pixel_id || ':7') LIMIT 12000""")
def sample_n_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample_n(t.pixels(spark, sf_dir, "ur").select("pixel_id"), ["pixel_id"], 12_000, seed=7)


@query("kfold_assign", """
    SELECT pixel_id, (CASE WHEN r <= (c % 10) * (c // 10 + 1) THEN (r - 1) // (c // 10 + 1)
                           ELSE c % 10 + (r - 1 - (c % 10) * (c // 10 + 1)) // (c // 10) END)::INTEGER AS fold
    FROM (SELECT pixel_id, row_number() OVER (ORDER BY md5(pixel_id || ':2')) AS r, count(*) OVER () AS c
          FROM pixels)""")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.kfold_assign(t.pixels(spark, sf_dir, "ur").select("pixel_id"), ["pixel_id"], 10)


@query("permute_column", """
    SELECT a.pixel_id, a.f5, b.f4 FROM
      (SELECT pixel_id, f5, row_number() OVER (ORDER BY md5(pixel_id || ':42')) AS r FROM pixels) a
      JOIN (SELECT f4, row_number() OVER (ORDER BY md5(pixel_id || ':43')) AS r FROM pixels) b ON a.r = b.r""")
def permute_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "f4", "f5").select("pixel_id", "f5", "f4")
    return split.permute_column(df, ["pixel_id"], "f4", by_key=True)


@query("permute_column_index", """
    SELECT pixel_id, f5, NULL::DOUBLE AS f4, 1 AS n FROM pixels
    UNION ALL SELECT -1, NULL, f4, count(*) FROM pixels GROUP BY f4""")
def permute_column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as they were, and how often each value of the shuffled column is there."""
    df = t.pixels(spark, sf_dir, "f4", "f5").select("pixel_id", "f5", "f4")
    shuffled = split.permute_column(df, ["pixel_id"], "f4")
    kept = shuffled.select("pixel_id", "f5", F.lit(None).cast("double").alias("f4"), F.lit(1).cast("bigint").alias("n"))
    values = shuffled.groupBy("f4").agg(F.count("*").alias("n")).select(
        F.lit(-1).cast("bigint").alias("pixel_id"), F.lit(None).cast("double").alias("f5"), "f4", "n")
    return kept.unionByName(values)


# -- scalar functions -----------------------------------------------------------------------------

@query("scalar_math", """
    SELECT pixel_id, round(exp(-foi), 8) AS e, round(foi ** 2, 8) AS p, round(sqrt(foi), 8) AS s,
           round(abs(foi - 0.25e0), 8) AS a, foi IS NULL AS missing, round_even(f4 / 7, 2) AS r2,
           'Age_' || lpad((pixel_id % 100)::VARCHAR, 2, '0') AS age_label,
           substring(ur, 3, 3) AS part FROM pixels""")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t.pixels(spark, sf_dir, "foi", "f4", "ur")
    foi = F.col("foi")
    return df.select(
        "pixel_id", F.round(F.exp(-foi), 8).alias("e"), F.round(F.pow(foi, F.lit(2.0)), 8).alias("p"),
        F.round(F.sqrt(foi), 8).alias("s"), F.round(F.abs(foi - 0.25), 8).alias("a"),
        fn.is_missing(df, "foi").alias("missing"), fn.half_even(F.col("f4") / 7, 2).alias("r2"),
        fn.age_label(F.col("pixel_id") % 100).alias("age_label"), F.substring("ur", 3, 3).alias("part"))


@query("array_percentile", """
    SELECT vec_id, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id""")
def array_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array_sort(F.transform("embedding", lambda v: v.cast("double")))
    return t.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(fn.percentile_of_sorted(values, 0.025), 6).alias("lower"),
        F.round(fn.percentile_of_sorted(values, 0.975), 6).alias("upper"))
