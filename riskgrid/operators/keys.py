"""Pixel keys, coordinate checks and raster positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import pixel_key_columns

COORDINATE_TOLERANCE = 1.9e-12  # Fixed value: allowed float noise between two coordinate columns.


Origin = tuple[float, float]


def pixel_key(df: DataFrame, res: float = 5.0, x: str = "x", y: str = "y", origin: Origin = (0.0, 0.0)) -> DataFrame:
    """Add the integer cell numbers ``kx, ky``: a hashable key that survives float noise. Cells are centred on the
    lattice through ``origin`` (see :func:`lattice_origin`)."""
    kx, ky = pixel_key_columns(F.col(x), F.col(y), res, origin)
    return df.withColumn("kx", kx).withColumn("ky", ky)


def lattice_origin(df: DataFrame, res: float = 5.0) -> Origin:
    """Where the lattice of a table's coordinates lies: any one of its points, reduced to the first cell.

    All points are whole steps from it, so cells that are centred on it have no point near a boundary, wherever the
    lattice begins. One row is read; a table without coordinates has the origin 0, 0.
    """
    point = df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").first()
    return (point["x"] % res, point["y"] % res) if point else (0.0, 0.0)


def coord_match_check(left: DataFrame, right: DataFrame, res: float = 5.0) -> DataFrame:
    """One row: rows on the left, rows without a partner, duplicate keys per side, and the verdict.

    Both sides are counted per key first, so the join is one row per key however often a key repeats. Cells are those of
    the left table's lattice.
    """
    origin = lattice_origin(left, res)

    def per_key(df: DataFrame, name: str) -> DataFrame:
        return pixel_key(df.select("x", "y"), res, origin=origin).groupBy("kx", "ky").agg(
            F.count(F.lit(1)).alias(name))

    both = per_key(left, "nl").join(per_key(right, "nr"), ["kx", "ky"], "full_outer")
    checked = both.agg(
        F.coalesce(F.sum("nl"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(F.when(F.col("nr").isNull(), F.col("nl"))), F.lit(0)).alias("unmatched"),
        F.count_if(F.col("nl") > 1).alias("left_duplicate_keys"),
        F.count_if(F.col("nr") > 1).alias("right_duplicate_keys"))
    return checked.withColumn("matched", (F.col("unmatched") == 0)
                              & (F.col("left_duplicate_keys") == 0)
                              & (F.col("right_duplicate_keys") == 0))


def align_grid(df: DataFrame, grid: DataFrame, res: float = 5.0) -> DataFrame:
    """Attach ``grid_id`` by pixel key. Keys are unique on both sides (see ``coord_match_check``)."""
    return attach_by_pixel(df, grid, ["grid_id"], res)


def coord_tolerance_check(left: DataFrame, right: DataFrame, res: float = 5.0,
                          tolerance: float = COORDINATE_TOLERANCE) -> DataFrame:
    """One row: joined rows, rows of either side without a partner, largest coordinate differences, and whether every
    row has one, x is within the tolerance and y equal, over all rows."""
    origin = lattice_origin(left, res)
    a = pixel_key(left.select("x", "y", F.lit(True).alias("here")), res, origin=origin)
    b = pixel_key(right.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(True).alias("there")), res, "x2", "y2",
                  origin)
    joined = a.join(b, ["kx", "ky"], "full_outer")
    worst = joined.agg(F.count_if(F.col("here") & F.col("there")).alias("n"),
                       F.count_if(F.col("there").isNull()).alias("left_unmatched"),
                       F.count_if(F.col("here").isNull()).alias("right_unmatched"),
                       F.max(F.abs(F.col("x") - F.col("x2"))).alias("max_dx"),
                       F.max(F.abs(F.col("y") - F.col("y2"))).alias("max_dy"))
    return worst.withColumn("within", (F.col("left_unmatched") == 0) & (F.col("right_unmatched") == 0)
                            & (F.col("max_dx") < tolerance) & (F.col("max_dy") == 0))


def attach_by_pixel(df: DataFrame, other: DataFrame, columns: list[str], res: float = 5.0,
                    how: str = "inner", origin: Origin | None = None) -> DataFrame:
    """Bring columns of another pixel table to this one by pixel key, not by row position."""
    return attach_all_by_pixel(df, [(other, columns)], res, how, origin)


def attach_all_by_pixel(df: DataFrame, others: Sequence[tuple[DataFrame, list[str]]], res: float = 5.0,
                        how: str = "inner", origin: Origin | None = None) -> DataFrame:
    """The same for several tables. All joins use one key, on the lattice of this table, so it is shuffled once
    at most. The lattice's ``origin`` can be given where it is known: else a row of this table is computed, and one row
    of a join or aggregation costs all of it."""
    origin = lattice_origin(df, res) if origin is None else origin
    keyed = pixel_key(df, res, origin=origin)
    for other, columns in others:
        keyed = keyed.join(pixel_key(other, res, origin=origin).select("kx", "ky", *columns), ["kx", "ky"], how)
    return keyed.drop("kx", "ky")


def raster_index(df: DataFrame, res: float = 5.0) -> DataFrame:
    """Row and column of each pixel on the regular grid spanned by the table, top row first, and
    whether the pixel lies on a cell centre. The extent is found first (two numbers)."""
    left, top = df.agg(F.min("x"), F.max("y")).first()
    col = (F.col("x") - F.lit(left)) / F.lit(float(res))
    row = (F.lit(top) - F.col("y")) / F.lit(float(res))
    near = F.lit(1e-6)
    return (df.withColumn("col", F.round(col).cast("long"))
            .withColumn("row", F.round(row).cast("long"))
            .withColumn("on_grid", (F.abs(col - F.round(col)) < near)
                        & (F.abs(row - F.round(row)) < near)))
