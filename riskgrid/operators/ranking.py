"""Exact order statistics of a hash order without a global sort.

A row hash is uniform over its leading hex digits, so counting rows per prefix (at most 16^digits
counts) locates every rank up to one small prefix group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import row_hash

PREFIX_DIGITS = 4


def hash_cutoffs(df: DataFrame, keys: Sequence[str], seed: int, ranks: Sequence[int],
                 digits: int = PREFIX_DIGITS) -> list[str]:
    """For each rank r, the r-th smallest row hash (1-based). Keys must be unique.

    Two jobs: prefix counts (a bounded table), then the few prefix groups that hold a wanted rank.
    A filter ``hash <= cutoff`` then takes exactly r rows with no shuffle at all. Rank 0 gives the
    empty string, which no hash is below.
    """
    hashed = df.select(row_hash(keys, seed).alias("h"))
    counts = (hashed.groupBy(F.substring("h", 1, digits).alias("prefix")).count()
              .orderBy("prefix").collect())
    wanted: dict[str, set[int]] = {}
    place: dict[int, tuple[str, int]] = {}
    before = 0
    pending = sorted({r for r in ranks if r > 0})
    for row in counts:
        while pending and pending[0] <= before + row["count"]:
            rank = pending.pop(0)
            place[rank] = (row["prefix"], rank - before)
            wanted.setdefault(row["prefix"], set()).add(rank - before)
        before += row["count"]
    if pending:
        raise ValueError(f"rank {pending[0]} is beyond the {before} rows")
    if not place:
        return ["" for _ in ranks]
    order = Window.partitionBy("prefix").orderBy("h")
    found = (hashed.withColumn("prefix", F.substring("h", 1, digits))
             .where(F.col("prefix").isin(*wanted))
             .withColumn("r", F.row_number().over(order))
             .where(F.col("r").isin(*{r for rs in wanted.values() for r in rs}))
             .collect())
    value = {(row["prefix"], row["r"]): row["h"] for row in found}
    return [value[place[r]] if r > 0 else "" for r in ranks]


def band_of_hash(keys: Sequence[str], seed: int, cutoffs: Sequence[str], labels: Sequence) -> Column:
    """Label of the first cutoff that the row hash does not exceed; the last label is the rest."""
    hash_column = row_hash(keys, seed)
    result = F.lit(labels[-1])
    for cutoff, label in reversed(list(zip(cutoffs, labels[:-1]))):
        result = F.when(hash_column <= F.lit(cutoff), F.lit(label)).otherwise(result)
    return result


def hash_rank(df: DataFrame, hash_column: Column, by: Sequence[str] = (), name: str = "rank",
              digits: int = PREFIX_DIGITS) -> DataFrame:
    """Add the 1-based rank of every row in hash order, within ``by``.

    Rows are numbered inside their prefix group and shifted by the number of rows in lower groups;
    the shifts are one row per (by, prefix). Work is spread over all prefixes.
    """
    by = list(by)
    hashed = df.withColumn("_hash", hash_column).withColumn("_prefix", F.substring("_hash", 1, digits))
    counts = hashed.groupBy(*by, "_prefix").count()
    lower = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        "_prefix").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*by, "_prefix", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*by, "_prefix").orderBy("_hash")
    numbered = hashed.withColumn("_within", F.row_number().over(inside))
    return (numbered.join(shifts, [*by, "_prefix"])
            .withColumn(name, F.col("_shift") + F.col("_within"))
            .drop("_hash", "_prefix", "_shift", "_within"))
