"""From a rate, a population map and an age profile to expected cases."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions import catalytic_cases as catalytic
from riskgrid.operators.keys import attach_by_pixel
from riskgrid.operators.quality import map_values
from riskgrid.operators.sizes import BROADCAST_ROWS, checked_broadcast, lookup_join

N_AGES = 100


def country_rules(index: DataFrame, dropped: Iterable[str] = (), parents: Mapping[str, str] | None = None,
                  profile_of: Mapping[str, str] | None = None,
                  case_parents: Mapping[str, str] | None = None) -> DataFrame:
    """The country index with the rules for special codes as columns.

    ``profile_code``: whose age profile applies; ``case_code`` and ``foi_code``: the country a region
    counts for in case totals and in rate distributions. NULL means "not counted".
    """
    dropped = list(dropped)
    parents = dict(parents or {})

    def ruled(*maps: Mapping[str, str]) -> Column:
        merged: dict[str, str] = {}
        for m in maps:
            merged.update(m)
        kept = map_values(F.col("code"), merged)
        return F.when(~F.col("code").isin(*dropped), kept) if dropped else kept

    return index.select(
        "region_id", "code", ruled(parents, profile_of or {}).alias("profile_code"),
        ruled(parents, case_parents or {}).alias("case_code"), ruled(parents).alias("foi_code"))


def region_join(pixels: DataFrame, regions: DataFrame, rules: DataFrame, res: float = 5.0) -> DataFrame:
    """Region of each pixel by pixel key, then the country rules of that region.

    ``rules`` is the country index: one row per region of the map.
    """
    return attach_by_pixel(pixels, regions, ["region_id"], res).join(rules, "region_id", "inner")


def scale_to_control_total(df: DataFrame, totals: DataFrame, code: str = "control_code",
                           value: str = "pop") -> DataFrame:
    """Scale pixel populations so that each country adds up to its official total.

    Mapped totals are summed per country and joined back as a ratio. A country without an official
    total, or with nobody mapped, keeps its values.
    """
    mapped = df.groupBy(code).agg(F.sum(value).alias("_mapped"))
    ratio = mapped.join(totals, code, "inner").select(
        code, (F.col("total") / F.nullif(F.col("_mapped"), F.lit(0.0))).alias("_ratio"))
    return (lookup_join(df, ratio, [code], "left")
            .withColumn(value, F.col(value) * F.coalesce("_ratio", F.lit(1.0))).drop("_ratio"))


def fold_age_regions(ages: DataFrame, parents: Mapping[str, str]) -> DataFrame:
    """Age populations of sub-regions summed into their country."""
    return (ages.withColumn("country", map_values(F.col("country"), parents))
            .groupBy("country", "age").agg(F.sum("pop").alias("pop")))


def age_share(ages: DataFrame) -> DataFrame:
    """Share of each age in its country. The table has one row per country and age."""
    whole = Window.partitionBy("country")
    return ages.select("country", "age", "pop",
                       (F.col("pop") / F.nullif(F.sum("pop").over(whole), F.lit(0.0))).alias("share"))


def age_profile(shares: DataFrame, codes: DataFrame, n_ages: int = N_AGES) -> DataFrame:
    """A full profile for every code: ``profile_code, age, share`` for ages 0 .. n_ages - 1.

    A code without any age data gets the same share for every age.
    """
    wanted = codes.select("profile_code").where("profile_code IS NOT NULL").distinct()
    known = shares.select(F.col("country").alias("profile_code")).distinct().withColumn("_known", F.lit(True))
    frame = (wanted.join(known, "profile_code", "left")
             .withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(n_ages - 1)))))
    data = shares.select(F.col("country").alias("profile_code"), "age", "share")
    fallback = F.when(F.col("_known").isNull(), F.lit(1.0 / n_ages)).otherwise(F.lit(0.0))
    return frame.join(data, ["profile_code", "age"], "left").select(
        "profile_code", "age", F.coalesce("share", fallback).alias("share"))


def pop_by_age(pixels: DataFrame, profile: DataFrame, spread: Sequence[str] = ()) -> DataFrame:
    """Population of each pixel and age, long. Pixels of codes that count for none are left out.

    Every pixel becomes as many rows as there are ages, in the task that holds it. Where pixels come
    in few splits, ``spread`` distributes the short rows by these columns first.
    """
    columns = [c for c in pixels.columns if c != "pop"]
    profile, _ = checked_broadcast(profile)
    rows = pixels.repartition(*spread) if spread else pixels
    return rows.join(profile, "profile_code", "inner").select(
        *columns, "age", (F.col("pop") * F.col("share")).alias("pop_age"))


def symptomatic_mean(rates: DataFrame) -> DataFrame:
    """Mean of the symptomatic-rate draws."""
    return rates.agg(F.avg("rate").alias("rate"))


def catalytic_cases(pop_ages: DataFrame, rate: float, foi: str = "foi") -> DataFrame:
    """Expected cases per pixel and age, one expression on the long table."""
    return pop_ages.withColumn(
        "cases", catalytic(F.col(foi), F.col("age"), F.lit(float(rate)), F.col("pop_age")))


def wide_profile(profile: DataFrame, n_ages: int = N_AGES) -> DataFrame:
    """The profiles with one column per age, ``s0 .. s{n-1}``: one row per code.

    A profile within the broadcast bound is turned on the driver, into columns that are known not to
    be NULL; that keeps the generated code of :func:`cases_total` short enough to be compiled.
    """
    names = [f"s{a}" for a in range(n_ages)]
    rows = profile.select("profile_code", "age", "share").limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS:
        pivoted = profile.groupBy("profile_code").pivot("age", list(range(n_ages))).agg(F.first("share"))
        return pivoted.select("profile_code", *[
            F.coalesce(F.col(str(a)), F.lit(0.0)).alias(n) for a, n in enumerate(names)])
    table = rows.to_pandas().pivot(index="profile_code", columns="age", values="share").reindex(
        columns=range(n_ages)).fillna(0.0)
    schema = T.StructType([T.StructField("profile_code", T.StringType(), False)]
                          + [T.StructField(n, T.DoubleType(), False) for n in names])
    local = [(code, *[float(v) for v in shares]) for code, shares in zip(table.index, table.to_numpy())]
    return F.broadcast(profile.sparkSession.createDataFrame(local, schema))


def cases_total(pixels: DataFrame, profile: DataFrame, rate: float, n_ages: int = N_AGES,
                foi: str = "foi") -> DataFrame:
    """Cases of all ages per pixel, without making a row per age.

    With q = exp(-foi) the ages add up to a polynomial in q whose coefficients are the age shares,
    so each pixel row needs one ``exp`` and a multiply-add per age, and nothing is shuffled.
    """
    columns = pixels.columns
    joined = pixels.join(wide_profile(profile, n_ages), "profile_code", "inner").withColumn(
        "_q", F.exp(-F.coalesce(F.col(foi), F.lit(0.0))))
    total = F.col(f"s{n_ages - 1}")
    for age in range(n_ages - 2, -1, -1):
        total = F.col(f"s{age}") + F.col("_q") * total
    cases = (1 - F.col("_q")) * total * F.lit(float(rate)) * F.col("pop")
    return joined.select(*columns, F.when(F.col(foi).isNotNull(), cases).alias("cases"))


def cases_by_region(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Total per region attached to the country index; regions without pixels get 0."""
    sums = cases.groupBy("region_id").agg(F.sum("cases").alias("cases"))
    return rules.join(sums, "region_id", "left").select(
        "region_id", "code", F.coalesce("cases", F.lit(0.0)).alias("cases"))
