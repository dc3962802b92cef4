"""Case totals and rate distributions of the map against the posterior-sample source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from riskgrid.operators import aggregates, compare
from riskgrid.plans.case_generation import CaseInputs, generate_cases


def compare_cases(inputs: CaseInputs, modelled: DataFrame, parents: Mapping[str, str]) -> DataFrame:
    """Expected cases per country, map against model, for the last modelled year."""
    return compare.cases_mapping_vs_model(
        generate_cases(inputs), inputs.rules, aggregates.year_slice(modelled), parents)


def compare_foi(values: DataFrame, rules: DataFrame, posterior: DataFrame) -> DataFrame:
    """Rate distribution per country, map against posterior."""
    return compare.foi_mapping_vs_posterior(
        compare.pool_by_country(values, rules), compare.posterior_pool(posterior))
