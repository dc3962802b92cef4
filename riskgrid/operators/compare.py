"""Comparison of the mapped totals and rates with a second, posterior-sample source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import half_even
from riskgrid.operators.aggregates import box_stats, country_sum, draw_mean, method_mean, rank_bands
from riskgrid.operators.quality import map_values
from riskgrid.operators.reshape import melt_methods, merge_regions
from riskgrid.operators.sizes import lookup_join

# Last rank of each band, and the band labels of the case chart.
COMPARISON_CUTS = (6, 17, 23, 25)
CASE_CUTS = (6, 16, 23, 25)
CASE_BANDS = (
    "[1] Below 400 Cases",
    "[2] 400 - 2000 Cases",
    "[3] 2000 - 20000 Cases",
    "[4] Above 20000 Cases",
)
METHODS = {"mod": "WHO-IG", "map": "Mapping"}


def region_fold_draws(draws: DataFrame, parents: Mapping[str, str]) -> DataFrame:
    """Sub-regions added up within each draw (and year)."""
    keys = ["code", "draw"] + (["year"] if "year" in draws.columns else [])
    return (draws.withColumn("code", map_values(F.col("code"), parents))
            .groupBy(*keys).agg(F.sum("cases").alias("cases")))


def row_select(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """A fixed selection of rows by their index value."""
    return df.where(F.col(column).isin(*values))


def pool_by_country(values: DataFrame, rules: DataFrame, use: str = "foi_code",
                    value: str = "foi") -> DataFrame:
    """All pixel values of each country as a long table ``code, value``; never a list per country.
    Missing values stay out of the pool, and so do regions that count for none."""
    pooled = merge_regions(values.select("code", F.col(value).alias("value")), rules, use)
    return pooled.where(F.col("value").isNotNull() & ~F.isnan("value"))


def posterior_pool(posterior: DataFrame) -> DataFrame:
    """Draw arrays to rows ``code, value``."""
    return posterior.select("code", F.explode("lambda").alias("value")).select(
        "code", F.col("value").cast("double").alias("value"))


def source_compare_join(mapped: DataFrame, modelled: DataFrame, how: str = "inner") -> DataFrame:
    """One row per country with the value of both sources; ``full_outer`` shows gaps."""
    return (mapped.select("code", F.col("cases").alias("map"))
            .join(modelled.select("code", F.col("cases").alias("mod")), "code", how))


def external_compare(yearly: DataFrame, mapped: DataFrame, year: int) -> DataFrame:
    """Yearly reference table, one year, summed per country and joined to the mapped totals."""
    reference = (yearly.where(F.col("year") == F.lit(year))
                 .groupBy("code").agg(F.sum("cases").alias("reference")))
    return reference.join(mapped.select("code", F.col("cases").alias("mapped")), "code", "inner")


def cases_mapping_vs_model(pixel_cases: DataFrame, rules: DataFrame, draws: DataFrame,
                           parents: Mapping[str, str], cuts: Sequence[int] = COMPARISON_CUTS) -> DataFrame:
    """Long table ``code, method, cases, rank, band``: mapped sums against modelled means.

    Both sides are summed to one row per country before they meet; ranks follow the modelled value.
    """
    mapped = country_sum(merge_regions(pixel_cases.select("code", "cases"), rules, "case_code"))
    modelled = draw_mean(region_fold_draws(draws, parents))
    both = source_compare_join(mapped, modelled).select(
        "code", half_even(F.col("map")).alias("map"), half_even(F.col("mod")).alias("mod"))
    ranked = rank_bands(both, "mod", cuts)
    return melt_methods(ranked, METHODS, ["code", "rank", "band"])


def cases_bands(pixel_cases: DataFrame, rules: DataFrame, cuts: Sequence[int] = CASE_CUTS,
                labels: Sequence[str] = CASE_BANDS) -> DataFrame:
    """Rounded total per country with its band."""
    mapped = country_sum(merge_regions(pixel_cases.select("code", "cases"), rules, "case_code"))
    return rank_bands(mapped.withColumn("cases", half_even(F.col("cases"))), "cases", cuts, labels)


def tag_sources(mapped: DataFrame, posterior: DataFrame) -> DataFrame:
    """Both long tables under one another, tagged by method."""
    return (mapped.select("code", "value", F.lit(METHODS["map"]).alias("method"))
            .unionByName(posterior.select("code", "value", F.lit(METHODS["mod"]).alias("method"))))


def foi_mapping_vs_posterior(mapped: DataFrame, posterior: DataFrame) -> DataFrame:
    """Mean and box statistics per country and method. Countries of the map without a posterior stay,
    one-sided; posterior countries that are not on the map are left out."""
    codes = mapped.select("code").distinct()
    tagged = tag_sources(mapped, lookup_join(posterior, codes, ["code"], "left_semi"))
    means = method_mean(tagged).drop("n")
    return means.join(box_stats(tagged, "value", ["code", "method"]), ["code", "method"])
