"""Predicted rate + population + age profile -> expected cases."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskgrid.operators import burden, keys
from riskgrid.sources.workdir import materialize


@dataclass(frozen=True)
class CaseInputs:
    """Tables of a case run: rate ``x, y, foi``; population ``x, y, pop``; regions ``x, y,
    region_id``; rules (``country_rules``); ages ``country, age, pop``; rates ``rate``."""

    foi: DataFrame
    population: DataFrame
    regions: DataFrame
    rules: DataFrame
    ages: DataFrame
    rates: DataFrame
    age_parents: Mapping[str, str]
    n_ages: int = burden.N_AGES
    res: float = 5.0
    spread: tuple[str, ...] = ()  # see burden.pop_by_age


def located_pixels(inputs: CaseInputs) -> DataFrame:
    """Pixels with rate, population, region and the code of their age profile."""
    located = keys.attach_all_by_pixel(
        inputs.foi, [(inputs.population, ["pop"]), (inputs.regions, ["region_id"])], inputs.res)
    return located.join(inputs.rules, "region_id")


def profile(inputs: CaseInputs) -> DataFrame:
    """Age profile of every code in use."""
    shares = burden.age_share(burden.fold_age_regions(inputs.ages, inputs.age_parents))
    return burden.age_profile(shares, inputs.rules, inputs.n_ages)


def mean_rate(inputs: CaseInputs) -> float:
    """Mean symptomatic rate as a number."""
    return burden.symptomatic_mean(inputs.rates).first()["rate"]


def generate_cases_by_age(inputs: CaseInputs) -> DataFrame:
    """Cases per pixel and age (long)."""
    return burden.catalytic_cases(
        burden.pop_by_age(located_pixels(inputs), profile(inputs), inputs.spread), mean_rate(inputs))


def generate_cases(inputs: CaseInputs) -> DataFrame:
    """Cases per pixel over all ages."""
    return burden.cases_total(located_pixels(inputs), profile(inputs), mean_rate(inputs), inputs.n_ages)


def generate_cases_both(inputs: CaseInputs) -> tuple[DataFrame, DataFrame]:
    """Cases per pixel and age (long), and per pixel over all ages.

    Pixels are located once and written to the shared folder, as are the profiles; both tables start there.
    """
    located, shares = materialize(located_pixels(inputs), "located"), materialize(profile(inputs), "profile")
    rate = mean_rate(inputs)
    ages = burden.catalytic_cases(burden.pop_by_age(located, shares, inputs.spread), rate)
    return ages, burden.cases_total(located, shares, rate, inputs.n_ages)
