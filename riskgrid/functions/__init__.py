"""Column functions shared by the operators. All but ``poisson_counts`` are built-in expressions."""

from riskgrid.functions.scalar import (
    age_label,
    catalytic_cases,
    half_even,
    hash_uniform,
    inverse_link,
    is_missing,
    link,
    percentile_of_sorted,
    pixel_key_columns,
    poisson_counts,
    poisson_of,
    poisson_one,
    round_count,
    row_hash,
    whole,
)

__all__ = [
    "age_label",
    "catalytic_cases",
    "half_even",
    "hash_uniform",
    "inverse_link",
    "is_missing",
    "link",
    "percentile_of_sorted",
    "pixel_key_columns",
    "poisson_counts",
    "poisson_of",
    "poisson_one",
    "round_count",
    "row_hash",
    "whole",
]
