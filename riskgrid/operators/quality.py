"""Missing values, feature selection, simple filters and renames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import half_even, is_missing
from riskgrid.roles import STUDY, Roles


def select_features(df: DataFrame, kind: str = "full", roles: Roles = STUDY) -> DataFrame:
    """Feature columns only: coordinates and label go, and for ``climate`` the other covariates too."""
    return df.select(*[c for c in roles.features(kind) if c in df.columns])


def any_missing(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """True where at least one of the columns (default: all) is missing."""
    return reduce(lambda a, b: a | b, [is_missing(df, c) for c in columns or df.columns])


def drop_na_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows in which no cell is missing."""
    return df.where(~any_missing(df, columns))


def na_report(df: DataFrame, by: str | None = "split", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a missing cell, all rows and the percentage, for every split in one pass."""
    counted = (df.groupBy(by) if by else df.groupBy()).agg(
        F.count_if(any_missing(df, columns)).alias("na_rows"), F.count(F.lit(1)).alias("total"))
    percent = F.col("na_rows") / F.nullif(F.col("total"), F.lit(0)) * 100
    return counted.withColumn("na_percent", half_even(percent, 2))


def tail_filter(df: DataFrame, column: str, threshold: float = 0.25) -> DataFrame:
    """Rows whose value is above the threshold."""
    return df.where(F.col(column) > threshold)


def tail_share(df: DataFrame, column: str, threshold: float = 0.25) -> DataFrame:
    """Share of rows above the threshold."""
    return df.agg(F.avg((F.col(column) > threshold).cast("int")).alias("share"))


def project_coords(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coordinates and the given result columns; rows carry their own key throughout."""
    return df.select("x", "y", *columns)


def relabel(df: DataFrame, columns: Mapping[str, str], value_column: str,
            values: Mapping[str, str]) -> DataFrame:
    """Rename columns, then replace the codes of one column by labels."""
    renamed = df.withColumnsRenamed(dict(columns))
    return renamed.withColumn(value_column, map_values(F.col(value_column), values))


def map_values(column: Column, values: Mapping[str, str]) -> Column:
    """Replace the listed values; others stay."""
    result = column
    for old, new in values.items():
        result = F.when(column == old, F.lit(new)).otherwise(result)
    return result


def head_rows(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(*key).limit(n)
