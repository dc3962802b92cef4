"""Demographic burden."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.operators import burden, keys
from riskgrid.plans import case_generation
from workload import tables as t
from workload.registry import query
from workload.scans import rounded


@query("age_share", "SELECT country, age, pop, share FROM shares")
def age_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = burden.fold_age_regions(t.age_population(spark, sf_dir), t.PARENTS)
    return burden.age_share(folded)


@query("scale_to_control_total", """
    SELECT p.pixel_id, p.control_code, round(p.pop * coalesce(o.total / m.mapped, 1), 4) AS pop
    FROM (SELECT pixel_id, pop, CASE WHEN region_id = 14 THEN 'NATION_5' ELSE code END AS control_code
          FROM pixels JOIN country_index USING (region_id)) p
    JOIN (SELECT CASE WHEN region_id = 14 THEN 'NATION_5' ELSE code END AS control_code, sum(pop) AS mapped
          FROM pixels JOIN country_index USING (region_id) GROUP BY 1) m ON m.control_code = p.control_code
    LEFT JOIN (SELECT country, sum(pop) AS total FROM age_population GROUP BY country) o
           ON o.country = p.control_code""")
def scale_to_control_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = (t.pixels(spark, sf_dir, "pop", "region_id").join(t.country_index(spark, sf_dir), "region_id")
          .select("pixel_id", F.when(F.col("region_id") == 14, "NATION_5").otherwise(F.col("code"))
                  .alias("control_code"), "pop"))
    totals = t.age_population(spark, sf_dir).groupBy(F.col("country").alias("control_code")).agg(
        F.sum("pop").alias("total"))
    return rounded(burden.scale_to_control_total(df, totals).select("pixel_id", "control_code", "pop"), 4)


@query("fold_age_regions", "SELECT country, age, pop FROM ages_folded")
def fold_age_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burden.fold_age_regions(t.age_population(spark, sf_dir), t.PARENTS)


@query("pop_by_age", "SELECT x, y, code, age, pop_age FROM age_cases")
def pop_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = t.case_inputs(spark, sf_dir)
    df = burden.pop_by_age(case_generation.located_pixels(inputs), case_generation.profile(inputs),
                           inputs.spread)
    return df.select("x", "y", "code", "age", "pop_age")


@query("symptomatic_mean", "SELECT round(avg(rate), 10) AS rate FROM rate_draws")
def symptomatic_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(burden.symptomatic_mean(t.rate_draws(spark, sf_dir)), 10)


@query("catalytic_cases", "SELECT x, y, code, age, round(cases, 8) AS cases FROM age_cases")
def catalytic_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = case_generation.generate_cases_by_age(t.case_inputs(spark, sf_dir))
    return df.select("x", "y", "code", "age", F.round("cases", 8).alias("cases"))


@query("cases_total", "SELECT x, y, code, round(cases, 6) AS cases FROM pixel_cases")
def cases_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = case_generation.generate_cases(t.case_inputs(spark, sf_dir))
    return df.select("x", "y", "code", F.round("cases", 6).alias("cases"))


@query("cases_by_region", """
    SELECT r.region_id, r.code, round(coalesce(c.cases, 0), 4) AS cases
    FROM rules r LEFT JOIN (SELECT region_id, sum(cases) AS cases FROM pixel_cases GROUP BY region_id) c
      ON c.region_id = r.region_id""")
def cases_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = t.case_inputs(spark, sf_dir)
    return rounded(burden.cases_by_region(case_generation.generate_cases(inputs), inputs.rules), 4)


@query("raster_index", """
    SELECT pixel_id, round((x - x0) / 5)::BIGINT AS col, round((y1 - y) / 5)::BIGINT AS row,
           TRUE AS on_grid FROM pixels, (SELECT min(x) AS x0, max(y) AS y1 FROM pixels)""")
def raster_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.raster_index(t.pixels(spark, sf_dir, "ur")).select("pixel_id", "col", "row", "on_grid")
