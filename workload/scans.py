"""Scans and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid import sources
from riskgrid.operators import aggregates, compare, reshape, split
from riskgrid.plans import case_generation
from riskgrid.roles import Roles
from riskgrid.sources.readers import with_row_index
from workload import tables as t
from workload.registry import query

PIXEL_SCHEMA = ("pixel_id BIGINT, x DOUBLE, y DOUBLE, f1 DOUBLE, f2 DOUBLE, f3 DOUBLE, f4 DOUBLE, "
                "f5 DOUBLE, ur STRING, region_id INT, foi DOUBLE")


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round the named columns (all floating-point ones by default) for the comparison."""
    names = names or tuple(f.name for f in df.schema if f.dataType.typeName() in ("double", "float"))
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("scan_features", """
    SELECT pixel_id, x, y, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, f4, f5, ur,
           region_id, round(foi, 6) AS foi FROM pixels""")
def scan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "features")
    sources.convert_table(t.pixels(spark, sf_dir), path)
    return rounded(sources.read_features(spark, path, PIXEL_SCHEMA), 6, "f1", "f2", "f3", "foi")


@query("scan_grid", "SELECT x, y, grid_id FROM grid")
def scan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "grid")
    sources.convert_table(t.grid(spark, sf_dir), path)
    return sources.read_grid(spark, path)


@query("scan_unlabelled", """
    SELECT pixel_id, x, y, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, f4, f5, ur,
           region_id FROM pixels""")
def scan_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "endemic")
    sources.convert_table(t.pixels(spark, sf_dir), path)
    df = sources.read_unlabelled(spark, path, PIXEL_SCHEMA, roles=Roles(label="foi"))
    return rounded(df, 6, "f1", "f2", "f3")


@query("scan_tsv_drop_index", """
    SELECT x, py AS y, round(yhat, 10) AS predict FROM predictions""")
def scan_tsv_drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "predicted")
    df = t.predictions(spark, sf_dir).select("x", F.col("py").alias("y"), F.col("yhat").alias("predict"),
                                             "lower", "upper")
    with_row_index(df).write.option("sep", "\t").option("header", True).csv(path)
    return rounded(sources.read_tsv_drop_index(spark, path), 10, "predict")


@query("scan_dims", """
    SELECT 'ages' AS name, count(*) AS n, round(sum(pop), 2) AS total FROM age_population
    UNION ALL SELECT 'population', count(*), round(sum(pop), 2) FROM pixels
    UNION ALL SELECT 'rates', count(*), round(sum(rate), 2) FROM rate_draws
    UNION ALL SELECT 'regions', count(*), round(sum(region_id)::DOUBLE, 2) FROM pixels
    UNION ALL SELECT 'countries', count(*), round(sum(region_id)::DOUBLE, 2) FROM country_index""")
def scan_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"ages": (t.age_population(spark, sf_dir), "pop"),
              "population": (t.population(spark, sf_dir), "pop"),
              "rates": (t.rate_draws(spark, sf_dir), "rate"),
              "regions": (t.regions(spark, sf_dir), "region_id"),
              "countries": (t.country_index(spark, sf_dir), "region_id")}
    base = sources.shared_path(spark, "dims")
    for name, (df, _) in frames.items():
        df.write.parquet(f"{base}/{name}")
    dims = sources.read_dims(spark, {name: f"{base}/{name}" for name in frames})
    parts = [dims[name].agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("double").alias("total"))
             .select(F.lit(name).alias("name"), "n", F.round("total", 2).alias("total"))
             for name, (_, value) in frames.items()]
    return reshape.union_splits(*parts)


@query("convert_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def convert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "converted")
    sources.convert_table(t.table(spark, sf_dir, "nation"), path)
    return sources.read_table(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT", "csv")


@query("sink_split", """
    SELECT x, y, CASE split WHEN 'train' THEN 1 WHEN 'validate' THEN 2 ELSE 3 END::INTEGER AS "Type"
    FROM pixel_splits""")
def sink_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "split")
    sources.write_split(split.group_split(t.grid(spark, sf_dir)), path)
    return sources.read_table(spark, path, "x DOUBLE, y DOUBLE, Type INT", "csv", sep="\t")


@query("sink_report", """
    SELECT s.split, round(avg((p.y - p.yhat) ** 2), 8) AS mse, count(*) AS n
    FROM predictions p JOIN pixel_splits s ON s.pixel_id = p.pixel_id
    WHERE p.y IS NOT NULL GROUP BY s.split""")
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "report")
    scored = split.group_split(
        t.predictions(spark, sf_dir).join(
            t.grid(spark, sf_dir).withColumnRenamed("y", "py"), ["x", "py"])).where("y IS NOT NULL")
    report = scored.groupBy("split").agg(
        F.round(F.avg(aggregates.squared_error("y", "yhat")), 8).alias("mse"), F.count("*").alias("n"))
    sources.write_report(report, path)
    return sources.read_table(spark, path, "split STRING, mse DOUBLE, n BIGINT", "csv", sep="\t")


@query("sink_predictions", """
    SELECT x, py AS y, round(y, 10) AS actual, round(yhat, 10) AS predict, round(lower, 10) AS lower,
           round(upper, 10) AS upper, 'RF' AS model FROM predictions""")
def sink_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "predictions")
    df = t.predictions(spark, sf_dir).select(
        "x", F.col("py").alias("y"), F.col("y").alias("actual"), F.col("yhat").alias("predict"),
        "lower", "upper")
    sources.write_predictions(df, path, "RF")
    return rounded(spark.read.parquet(path), 10, "actual", "predict", "lower", "upper")


@query("sink_cases_by_age", """
    SELECT 'Age_' || lpad(age::VARCHAR, 2, '0') AS part, count(*) AS n, round(sum(cases), 4) AS cases
    FROM age_cases GROUP BY age
    UNION ALL SELECT 'Total', count(*), round(sum(cases), 4) FROM pixel_cases""")
def sink_cases_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "cases")
    sources.write_cases_by_age(*case_generation.generate_cases_both(t.case_inputs(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("part").agg(
        F.count("*").alias("n"), F.round(F.sum("cases"), 4).alias("cases"))


@query("sink_foi_by_country", "SELECT code, round(value, 6) AS value FROM mapped_foi")
def sink_foi_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources.shared_path(spark, "foi")
    sources.write_values_by_country(pooled(spark, sf_dir), path)
    return rounded(spark.read.parquet(path).select("code", "value"), 6, "value")


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the map by country of their region."""
    located = t.pixels(spark, sf_dir, "foi", "region_id").join(t.country_index(spark, sf_dir), "region_id")
    return compare.pool_by_country(located, t.rules(spark, sf_dir))
