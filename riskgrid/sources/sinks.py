"""Writers. Each one writes its table in parallel, one file per task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import age_label


# Folders that a task writes side by side; a table with more is sorted by folder first.
OPEN_FOLDERS = 128
# Bytes that a writer gathers before it writes them out, so that many open ones fit in memory.
OPEN_BYTES = 4 * 2 ** 20


@contextmanager
def open_folders(spark: SparkSession, most: int = OPEN_FOLDERS) -> Iterator[None]:
    """Let a task keep a writer open for each folder, where it would sort its rows by folder before."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_split(df: DataFrame, path: str) -> None:
    """``x, y, Type`` as tab-separated text; 1 train, 2 validate, 3 test, 0 none."""
    code = (F.when(F.col("split") == "train", 1).when(F.col("split") == "validate", 2)
            .when(F.col("split") == "test", 3).otherwise(0))
    (df.select("x", "y", code.alias("Type")).write.mode("overwrite")
     .option("header", True).option("sep", "\t").csv(path))


def write_report(df: DataFrame, path: str) -> None:
    """A report table (parameters, errors, importances, top features) as one tab-separated file.
    Reports have one row per parameter, feature or round, so one writer is enough."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_predictions(df: DataFrame, path: str, model: str) -> None:
    """Predictions with coordinates; the model name is a partition column, not part of a file name."""
    wanted = ("x", "y", "actual", "predict", "lower", "upper")
    (df.select(*[c for c in wanted if c in df.columns], F.lit(model).alias("model"))
     .write.mode("overwrite").partitionBy("model").parquet(path))


def write_cases_by_age(ages: DataFrame, totals: DataFrame, path: str,
                       keys: tuple[str, ...] = ("x", "y")) -> None:
    """One folder per age and one named ``Total``.

    Every pixel has a row for every age, so a task's rows spread evenly over the folders and are
    written where they are, without a shuffle, and without a sort of the unfolded rows: a writer stays open for every
    age. ``totals`` has one row per pixel.
    """
    with open_folders(ages.sparkSession):
        (ages.select(*keys, age_label(F.col("age")).alias("part"), "cases")
         .write.mode("overwrite").option("parquet.block.size", OPEN_BYTES).partitionBy("part").parquet(path))
    (totals.select(*keys, F.lit("Total").alias("part"), "cases")
     .write.mode("append").partitionBy("part").parquet(path))


def write_values_by_country(df: DataFrame, path: str) -> None:
    """Long table ``code, value`` with one folder per country."""
    (df.select("code", "value").hint("rebalance", "code")
     .write.mode("overwrite").partitionBy("code").parquet(path))


def save_model(model: MLWritable, path: str) -> None:
    """Persist a fitted MLlib model as a distributed folder; ensembles have ``save`` of their own."""
    model.write().overwrite().save(path)


def load_model(model_class: type[MLReadable], path: str):
    """Restore a fitted MLlib model."""
    return model_class.load(path)
