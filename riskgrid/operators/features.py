"""From columns to feature vectors: category codes, standardisation, assembly."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_indexer(columns: Sequence[str]) -> StringIndexer:
    """Codes in alphabetical order; a value not seen in the fit gets a code of its own."""
    return StringIndexer(inputCols=list(columns), outputCols=[f"{c}_code" for c in columns],
                         stringOrderType="alphabetAsc", handleInvalid="keep")


def encode_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace categories by codes learned on the whole table."""
    return category_indexer(columns).fit(df).transform(df)


def feature_pipeline(df: DataFrame, numeric: Sequence[str], category: Sequence[str] = ()) -> PipelineModel:
    """Fitted encoding and assembly, so that every later table is treated alike."""
    names = [*numeric, *[f"{c}_code" for c in category]]
    stages = [category_indexer(category)] if category else []
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="features")]).fit(df)


def input_array(names: Sequence[str]) -> Column:
    """What the assembled vector holds, as an array of doubles in built-in expressions: tree operators take either, and
    an array is not packed and unpacked for every pass. A missing value is an error, as in the assembler."""
    values = [F.col(n).cast("double") for n in names]
    missing = reduce(or_, [v.isNull() | F.isnan(v) for v in values])
    return F.when(missing, F.raise_error(F.lit(f"a missing value in {', '.join(names)}"))).otherwise(F.array(*values))


@dataclass(frozen=True)
class Scaling:
    """Means and population standard deviations of the training columns."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """One pass; a constant column gets scale 1."""
    row = df.agg(*[f(c).alias(f"{p}_{c}") for c in columns
                   for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return Scaling(tuple(columns), tuple(row[f"m_{c}"] for c in columns),
                   tuple(row[f"s_{c}"] or 1.0 for c in columns))


def standardize(df: DataFrame, scaling: Scaling) -> DataFrame:
    """Zero mean and unit variance under the training figures; plain column arithmetic."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, m, s in zip(scaling.columns, scaling.means, scaling.sds)})
