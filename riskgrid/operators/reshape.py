"""Unions, long/wide forms and merging of regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import age_label
from riskgrid.operators.quality import map_values


def union_splits(*frames: DataFrame) -> DataFrame:
    """Concatenate splits by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_regions(df: DataFrame, rules: DataFrame, parent: str, code: str = "code") -> DataFrame:
    """Give every row the country it counts for and drop rows of regions that count for none.

    ``rules`` has one row per region code and a column per use (see ``country_rules``).
    """
    lookup = rules.select(F.col("code").alias(code), F.col(parent).alias("_parent"))
    return (df.join(lookup, code, "inner").where(F.col("_parent").isNotNull())
            .withColumn(code, F.col("_parent")).drop("_parent"))


def melt_methods(df: DataFrame, columns: Mapping[str, str], ids: Sequence[str] = ("code",)) -> DataFrame:
    """Wide columns, one per method, to rows ``ids.., method, cases`` with the given labels."""
    long = df.unpivot(list(ids), list(columns), "method", "cases")
    return long.withColumn("method", map_values(F.col("method"), columns))


def ages_to_wide(df: DataFrame, keys: Sequence[str], n_ages: int, value: str = "cases") -> DataFrame:
    """One column per age from the long table; the column list is fixed, so no extra pass finds it."""
    labels = [f"Age_{a:02d}" for a in range(n_ages)]
    return (df.select(*keys, age_label(F.col("age")).alias("_age"), value)
            .groupBy(*keys).pivot("_age", labels).agg(F.sum(value)))


def ages_to_long(df: DataFrame, keys: Sequence[str], value: str = "cases") -> DataFrame:
    """Back from one column per age to rows."""
    columns = [c for c in df.columns if c.startswith("Age_")]
    long = df.unpivot(list(keys), columns, "_label", value)
    return long.select(*keys, F.substring_index("_label", "_", -1).cast("int").alias("age"), value)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(column).distinct()


def zip_columns(df: DataFrame, y: str = "y", yhat: str = "yhat", lower: str = "lower",
                upper: str = "upper", keys: Sequence[str] = ("pixel_id",)) -> DataFrame:
    """Actual, predicted, lower and upper side by side; all come from the same keyed row."""
    return df.select(*keys, F.col(y).alias("y"), F.col(yhat).alias("yhat"),
                     F.col(lower).alias("lower"), F.col(upper).alias("upper"))
