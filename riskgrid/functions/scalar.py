"""Scalar column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, name: str) -> Column:
    """True where a cell is NULL, or NaN for floating-point columns."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def half_even(column: Column, digits: int = 0) -> Column:
    """Round half to even, as R and Python do."""
    return F.bround(column, digits)


def whole(column: Column) -> Column:
    """``round`` of a double to a whole number, halves away from zero: the same values without a decimal for each."""
    near = F.rint(column)
    return F.when(F.abs(column - near) == 0.5, column + F.signum(column) * 0.5).otherwise(near)


def round_count(n: float) -> int:
    """Driver-side companion of :func:`half_even` for row counts."""
    return int(round(n))


def link(column: Column, kind: str = "identity") -> Column:
    """Transform a rate before fitting: ``identity`` or ``logit``."""
    if kind == "identity":
        return column
    if kind == "logit":
        return F.ln(column / (1 - column))
    raise ValueError(f"unknown link {kind!r}")


def inverse_link(column: Column, kind: str = "identity") -> Column:
    """Transform a prediction or bound back to a rate."""
    if kind == "identity":
        return column
    if kind == "logit":
        return 1 / (1 + F.exp(-column))
    raise ValueError(f"unknown link {kind!r}")


def row_hash(keys: Sequence[str | Column], seed: int) -> Column:
    """md5 of ``key1:key2:..:seed``: an order that depends on the key alone, so a lost task that is
    run again sees the same order. Cast numeric keys to BIGINT before."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(str(seed))).cast("binary"))


def hash_uniform(keys: Sequence[str | Column], seed: int | Column) -> Column:
    """Uniform number in [0, 1) from a 64-bit hash of the keys."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    seed_column = seed if isinstance(seed, Column) else F.lit(seed)
    bits = F.shiftrightunsigned(F.xxhash64(*columns, seed_column), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


# Cumulative Poisson(1) probabilities; beyond 12 the tail is below 1e-10.
_POISSON_CDF = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def poisson_one(uniform: Column) -> Column:
    """Poisson(1) count by inversion of a uniform number."""
    count = F.lit(0.0)
    for edge in _POISSON_CDF:
        count = count + (uniform >= F.lit(edge)).cast("double")
    return count


def poisson_of(uniforms: np.ndarray) -> np.ndarray:
    """:func:`poisson_one` of a numpy array, a byte each."""
    return np.searchsorted(_POISSON_CDF, uniforms, side="right").astype(np.uint8)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def poisson_counts(uniforms: pa.Array) -> pa.Array:
    """:func:`poisson_one` of all numbers of an array, without an interpreted function for each."""
    counts = poisson_of(uniforms.flatten().to_numpy(zero_copy_only=False)).astype(float)
    sizes = uniforms.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts))


def age_label(age: Column, prefix: str = "Age_") -> Column:
    """Zero-padded label, e.g. ``Age_07``."""
    return F.concat(F.lit(prefix), F.lpad(age.cast("string"), 2, "0"))


def pixel_key_columns(x: Column, y: Column, res: float = 5.0, origin: tuple[float, float] = (0.0, 0.0)
                      ) -> tuple[Column, Column]:
    """Integer cell numbers of a coordinate pair, cells being centred on ``origin`` and whole steps from it. Float noise
    does not change them as long as the coordinates lie near centres. NULL and NaN have no cell."""
    def cell(c: Column, start: float) -> Column:
        known = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        return whole((known - F.lit(float(start))) / F.lit(float(res))).cast("long")

    return cell(x, origin[0]), cell(y, origin[1])


def percentile_of_sorted(values: Column, p: float) -> Column:
    """Percentile (0..1) with linear interpolation of a sorted, non-empty array."""
    position = (F.size(values) - 1) * F.lit(float(p))
    low = F.floor(position).cast("int")
    high = F.ceil(position).cast("int")
    at_low, at_high = F.get(values, low), F.get(values, high)
    return at_low + (position - low) * (at_high - at_low)


def catalytic_cases(foi: Column, age: Column, rate: Column, population: Column) -> Column:
    """Expected symptomatic cases at one age: infected this year, not infected in any year before."""
    return (1 - F.exp(-foi)) * F.exp(-foi * age) * rate * population
