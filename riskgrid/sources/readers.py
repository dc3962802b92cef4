"""Readers with declared schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.roles import STUDY, Roles


def feature_schema(roles: Roles = STUDY, labelled: bool = True) -> T.StructType:
    """Schema of a pixel table: coordinates, covariates and, if ``labelled``, the label."""
    fields = [T.StructField(k, T.DoubleType()) for k in roles.key]
    for name in roles.features():
        kind = T.StringType() if name in roles.category else T.DoubleType()
        fields.append(T.StructField(name, kind))
    if labelled:
        fields.append(T.StructField(roles.label, T.DoubleType()))
    return T.StructType(fields)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", sep: str = ",", header: bool = True) -> DataFrame:
    """Read one Parquet or delimited table. Delimited text needs a schema; its columns are matched
    by position, so the schema lists every column of the file in order."""
    if fmt == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if fmt == "csv":
        if schema is None:
            raise ValueError("delimited text needs a declared schema")
        return (spark.read.schema(schema).option("header", header).option("sep", sep)
                .option("nanValue", "NaN").option("nullValue", "").csv(path))
    raise ValueError(f"unsupported format {fmt!r}; use 'parquet' or 'csv'")


def read_features(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                  fmt: str = "csv", roles: Roles = STUDY) -> DataFrame:
    """Study pixels: coordinates, covariates, label."""
    if schema is None and fmt == "csv":
        schema = feature_schema(roles)
    return read_table(spark, path, schema, fmt)


def read_grid(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Grid assignment ``x, y, grid_id``."""
    return read_table(spark, path, "x DOUBLE, y DOUBLE, grid_id BIGINT", fmt)


def read_unlabelled(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    fmt: str = "csv", roles: Roles = STUDY) -> DataFrame:
    """Pixels to predict for: the label column is dropped when there is one."""
    return read_features(spark, path, schema, fmt, roles).drop(roles.label)


def read_tsv_drop_index(spark: SparkSession, path: str,
                        columns: tuple[str, ...] = ("x", "y", "predict", "lower", "upper"),
                        keep: tuple[str, ...] = ("x", "y", "predict")) -> DataFrame:
    """Tab-separated prediction with a leading, unnamed row-index column that is not kept."""
    schema = T.StructType([T.StructField("row_index", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in columns])
    return read_table(spark, path, schema, "csv", sep="\t").select(*keep)


def read_dims(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
              schemas: dict[str, T.StructType | str] | None = None) -> dict[str, DataFrame]:
    """Population, age, region, country and rate tables by name."""
    schemas = schemas or {}
    return {name: read_table(spark, path, schemas.get(name), fmt) for name, path in paths.items()}


def convert_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write a stored table as CSV with a header and no row names."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("header", True).csv(path)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Put a unique row number in front, for readers that expect such a column."""
    return df.select(F.monotonically_increasing_id().alias(name), "*")
