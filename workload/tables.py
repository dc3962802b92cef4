"""The pixel tables of the library, derived from the test tables, as Spark frames and as SQL.

Averages are taken over whole cents and hundredths, so both engines get the same doubles whatever
the order of the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import whole
from riskgrid.operators.burden import country_rules
from riskgrid.plans.case_generation import CaseInputs

N_AGES = 50
DROPPED = ["NATION_14"]
PARENTS = {"NATION_17": "NATION_16"}
PROFILE_OF = {"NATION_24": "NATION_5"}
CASE_PARENTS = {"NATION_24": "NATION_5"}
MODEL_PARENTS = {"NATION_17": "NATION_16", "NATION_24": "NATION_5"}

LINE_COLUMNS = {"f1", "f2", "f3", "foi"}
CUSTOMER_COLUMNS = {"f5", "region_id", "pop"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hundredths(name: str) -> Column:
    return F.sum(whole(F.col(name) * 100.0).cast("long")).cast("double")


def pixels(spark: SparkSession, sf_dir: str, *columns: str, hashed: bool = False) -> DataFrame:
    """One pixel per order. Only the tables that the wanted columns need are read. ``hashed`` joins the lines by hash
    tables of shuffle partitions, for many pixels: none is sorted."""
    columns = columns or ("f1", "f2", "f3", "f4", "f5", "ur", "region_id", "foi")
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pixel_id"), "o_custkey",
        ((F.col("o_orderkey") % 200) * 5.0).alias("x"),
        (F.floor(F.col("o_orderkey") / 200) * 5.0).alias("y"),
        F.col("o_totalprice").alias("f4"), F.col("o_orderpriority").alias("ur"))
    if LINE_COLUMNS & set(columns):
        n = F.count(F.lit(1)).cast("double") * 100.0
        lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pixel_id")).agg(
            (_hundredths("l_quantity") / n).alias("f1"), (_hundredths("l_extendedprice") / n).alias("f2"),
            (_hundredths("l_tax") / n).alias("f3"), (5.0 * _hundredths("l_discount") / n).alias("foi"))
        df = df.join(lines.hint("shuffle_hash") if hashed else lines, "pixel_id", "left")
    if CUSTOMER_COLUMNS & set(columns):
        customer = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("f5"),
            F.abs("c_acctbal").alias("pop"), F.col("c_nationkey").alias("region_id"))
        df = df.join(customer, "o_custkey", "left")
    return df.select("pixel_id", "x", "y", *columns)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.floor(F.col("x") / 50) * 100000 + F.floor(F.col("y") / 50)).cast("long")
    return pixels(spark, sf_dir, "ur").select("x", "y", number.alias("grid_id"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, "pop").select("x", "y", "pop")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, "region_id").select("x", "y", "region_id")


def country_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("code"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return country_rules(country_index(spark, sf_dir), DROPPED, PARENTS, PROFILE_OF, CASE_PARENTS)


def age_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied quantity per supplier nation (below 20) and part size, as population per age."""
    supplier = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("region_id"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"),
                                               (F.col("p_size") - 1).alias("age"))
    return (table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
            .join(supplier, "l_suppkey").join(part, "l_partkey")
            .groupBy("region_id", "age").agg(F.sum("l_quantity").alias("pop"))
            .join(country_index(spark, sf_dir), "region_id")
            .select(F.col("code").alias("country"), "age", "pop"))


def rate_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.lit(0.002) + F.lit(0.002) * F.col("l_tax") / F.lit(0.08)).alias("rate"))


def modelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region_id"))
    return (table(spark, sf_dir, "orders").join(customer, "o_custkey")
            .groupBy("region_id", (F.col("o_orderkey") % 16).cast("int").alias("draw"),
                     F.year("o_orderdate").alias("year"))
            .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100000.0).alias("cases"))
            .join(country_index(spark, sf_dir), "region_id")
            .select("code", "draw", "year", "cases"))


def modelled_foi(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = country_index(spark, sf_dir).withColumnRenamed("region_id", "label")
    return (table(spark, sf_dir, "embeddings").join(index, "label")
            .select("code", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("lambda")))


def predictions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Actual value, a deterministic prediction and bounds; pixels without lines have neither."""
    yhat = F.col("f3") / 0.08 * 0.5
    return (pixels(spark, sf_dir, "f3", "foi", *extra)
            .select("pixel_id", "x", F.col("y").alias("py"), F.col("foi").alias("y"),
                    yhat.alias("yhat"), (yhat - 0.1).alias("lower"), (yhat + 0.1).alias("upper"), *extra))


def foi_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted rate per pixel: pixels with a value."""
    return pixels(spark, sf_dir, "foi").where("foi IS NOT NULL").select("x", "y", "foi")


def case_inputs(spark: SparkSession, sf_dir: str) -> CaseInputs:
    """The test files have one row group each, so pixels arrive in one task and are spread."""
    return CaseInputs(
        foi=foi_map(spark, sf_dir), population=population(spark, sf_dir),
        regions=regions(spark, sf_dir), rules=rules(spark, sf_dir),
        ages=age_population(spark, sf_dir), rates=rate_draws(spark, sf_dir),
        age_parents=PARENTS, n_ages=N_AGES, spread=("x", "y"))


def model_pixels(spark: SparkSession, sf_dir: str, hashed: bool = False) -> DataFrame:
    """Complete pixels with a label that depends on two of the features, for the model queries:
    the plain ``foi`` is unrelated to the other columns."""
    noise = (F.conv(F.substring(F.md5(F.col("pixel_id").cast("string").cast("binary")), 1, 8), 16, 10)
             .cast("double") / 4294967296.0 - 0.5) * 0.04
    label = 0.25 + 0.2 * F.sin(F.col("f1") / 8) * (F.col("f3") > 0.04).cast("double") + noise
    df = pixels(spark, sf_dir, "f1", "f2", "f3", "f4", "f5", "ur", hashed=hashed).where("f1 IS NOT NULL")
    return df.withColumn("label", label)


# -- the same tables in SQL -----------------------------------------------------------------------

_CTE = {
    "line_means": """
        SELECT l_orderkey AS pixel_id, count(*)::DOUBLE * 100e0 AS n100,
               sum(round(l_quantity * 100)::BIGINT)::DOUBLE AS q,
               sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS e,
               sum(round(l_tax * 100)::BIGINT)::DOUBLE AS t,
               sum(round(l_discount * 100)::BIGINT)::DOUBLE AS d
        FROM lineitem GROUP BY l_orderkey""",
    "pixels": """
        SELECT o_orderkey AS pixel_id, (o_orderkey % 200) * 5e0 AS x, floor(o_orderkey / 200) * 5e0 AS y,
               q / n100 AS f1, e / n100 AS f2, t / n100 AS f3, o_totalprice AS f4, c_acctbal AS f5,
               o_orderpriority AS ur, c_nationkey AS region_id, 5e0 * d / n100 AS foi,
               abs(c_acctbal) AS pop
        FROM orders LEFT JOIN line_means ON line_means.pixel_id = o_orderkey
             LEFT JOIN customer ON c_custkey = o_custkey""",
    "grid": """
        SELECT pixel_id, x, y, (floor(x / 50) * 100000 + floor(y / 50))::BIGINT AS grid_id FROM pixels""",
    "country_index": "SELECT n_nationkey AS region_id, n_name AS code FROM nation",
    "rules": """
        SELECT region_id, code,
               CASE WHEN code = 'NATION_14' THEN NULL WHEN code = 'NATION_17' THEN 'NATION_16'
                    WHEN code = 'NATION_24' THEN 'NATION_5' ELSE code END AS profile_code,
               CASE WHEN code = 'NATION_14' THEN NULL WHEN code = 'NATION_17' THEN 'NATION_16'
                    WHEN code = 'NATION_24' THEN 'NATION_5' ELSE code END AS case_code,
               CASE WHEN code = 'NATION_14' THEN NULL WHEN code = 'NATION_17' THEN 'NATION_16'
                    ELSE code END AS foi_code
        FROM country_index""",
    "age_population": """
        SELECT n_name AS country, p_size - 1 AS age, sum(l_quantity) AS pop
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
             JOIN nation ON n_nationkey = s_nationkey
        WHERE s_nationkey < 20 GROUP BY 1, 2""",
    "ages_folded": """
        SELECT CASE WHEN country = 'NATION_17' THEN 'NATION_16' ELSE country END AS country, age,
               sum(pop) AS pop FROM age_population GROUP BY 1, 2""",
    "shares": """
        SELECT country, age, pop, pop / sum(pop) OVER (PARTITION BY country) AS share FROM ages_folded""",
    "profile": """
        SELECT c.profile_code, a.age,
               coalesce(s.share, CASE WHEN k.country IS NULL THEN 1e0 / 50 ELSE 0e0 END) AS share
        FROM (SELECT DISTINCT profile_code FROM rules WHERE profile_code IS NOT NULL) c
             CROSS JOIN (SELECT unnest(range(50))::INTEGER AS age) a
             LEFT JOIN (SELECT DISTINCT country FROM shares) k ON k.country = c.profile_code
             LEFT JOIN shares s ON s.country = c.profile_code AND s.age = a.age""",
    "rate_draws": "SELECT 0.002e0 + 0.002e0 * l_tax / 0.08e0 AS rate FROM lineitem",
    "located": """
        SELECT p.pixel_id, p.x, p.y, p.foi, p.pop, r.region_id, r.code, r.profile_code, r.case_code,
               r.foi_code
        FROM pixels p JOIN rules r ON r.region_id = p.region_id WHERE p.foi IS NOT NULL""",
    "age_cases": """
        SELECT l.pixel_id, l.x, l.y, l.region_id, l.code, l.case_code, a.age, l.pop * a.share AS pop_age,
               (1 - exp(-l.foi)) * exp(-l.foi * a.age) * (SELECT avg(rate) FROM rate_draws)
               * (l.pop * a.share) AS cases
        FROM located l JOIN profile a ON a.profile_code = l.profile_code""",
    "pixel_cases": """
        SELECT pixel_id, x, y, region_id, code, case_code, sum(cases) AS cases
        FROM age_cases GROUP BY ALL""",
    "modelled_cases": """
        SELECT n_name AS code, (o_orderkey % 16)::INTEGER AS draw, year(o_orderdate)::INTEGER AS year,
               sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100000e0 AS cases
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
        GROUP BY 1, 2, 3""",
    "draws_folded": """
        SELECT CASE code WHEN 'NATION_17' THEN 'NATION_16' WHEN 'NATION_24' THEN 'NATION_5' ELSE code END
               AS code, draw, year, sum(cases) AS cases FROM modelled_cases GROUP BY 1, 2, 3""",
    "modelled_foi": """
        SELECT n_name AS code, embedding FROM embeddings JOIN nation ON n_nationkey = label""",
    "posterior": "SELECT code, abs(unnest(embedding)::DOUBLE) AS value FROM modelled_foi",
    "mapped_foi": "SELECT foi_code AS code, foi AS value FROM located WHERE foi_code IS NOT NULL",
    "predictions": """
        SELECT pixel_id, x, y AS py, foi AS y, f3 / 0.08e0 * 0.5e0 AS yhat,
               f3 / 0.08e0 * 0.5e0 - 0.1e0 AS lower, f3 / 0.08e0 * 0.5e0 + 0.1e0 AS upper, region_id
        FROM pixels""",
    "group_sizes": "SELECT grid_id, count(*) AS n FROM grid GROUP BY grid_id",
    "group_splits": """
        SELECT s.grid_id, s.n,
               CASE WHEN s.n < 100 THEN 'train' WHEN k.r <= round_even(0.7e0 * k.c, 0) THEN 'train'
                    WHEN k.r <= round_even(0.7e0 * k.c, 0) + round_even(0.15e0 * k.c, 0) THEN 'validate'
                    ELSE 'test' END AS split
        FROM group_sizes s LEFT JOIN (
             SELECT grid_id, row_number() OVER (ORDER BY md5(grid_id || ':5')) AS r, count(*) OVER () AS c
             FROM group_sizes WHERE n >= 100) k ON k.grid_id = s.grid_id""",
    "pixel_splits": """
        SELECT p.*, s.grid_id, s.split FROM pixels p JOIN grid g ON g.pixel_id = p.pixel_id
             JOIN group_splits s ON s.grid_id = g.grid_id""",
}


def with_tables(sql: str) -> str:
    """Prefix a statement with the derived tables it uses, directly or through one another."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in _CTE:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(_CTE[name])

    visit(sql)
    if not used:
        return sql
    parts = [f"{name} AS ({_CTE[name]})" for name in _CTE if name in used]
    return "WITH " + ",\n".join(parts) + "\n" + sql
