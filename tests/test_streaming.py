"""Operators without state give the same rows on a streaming table, over several batches, as on a finite one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators import burden, features, keys, linear, quality
from workload import tables as t

FOLDER = "/root/testdata/sf0.001"


def run_as_stream(spark, rows: DataFrame, transform, tmp_path) -> list:
    """Rows of ``transform`` over a stream of the table's files, one file a batch."""
    rows.repartition(4, "pixel_id").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = (transform(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
               .trigger(availableNow=True).start(str(tmp_path / "out")))
    assert running.awaitTermination(120) and running.exception() is None
    assert sum(p["numInputRows"] > 0 for p in running.recentProgress) >= 3
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_rows_without_state(spark, tmp_path):
    pixels = t.pixels(spark, FOLDER, "f1", "f3", "foi")

    def transform(df: DataFrame) -> DataFrame:
        kept = quality.tail_filter(quality.drop_na_rows(df), "foi", 0.2)
        return burden.catalytic_cases(keys.pixel_key(kept).withColumns(
            {"age": F.col("pixel_id") % 50, "pop_age": F.col("f1") * 10}), 0.003)

    got = run_as_stream(spark, pixels, transform, tmp_path)
    assert 0 < len(got) < pixels.count()
    assert got == sorted(tuple(r) for r in transform(pixels).collect())


def test_fitted_models(spark, tmp_path):
    names = ["f1", "f3", "f4"]
    pixels = quality.drop_na_rows(t.pixels(spark, FOLDER, *names, "foi"))
    scaling = features.fit_scaling(pixels, names)
    fit = linear.pcr_fit(features.standardize(pixels, scaling), names, "foi", 2)

    def transform(df: DataFrame) -> DataFrame:
        return linear.pcr_predict(features.standardize(df, scaling), fit)

    got = run_as_stream(spark, pixels, transform, tmp_path)
    assert len(got) == pixels.count()
    assert got == sorted(tuple(r) for r in transform(pixels).collect())
