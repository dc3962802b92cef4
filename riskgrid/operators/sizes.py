"""Size-checked broadcast and skew-aware lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows up to which a lookup table is broadcast. Lookup rows here are a few numbers wide.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Mark a lookup table for broadcast only when it is within the bound.

    Within it, the rows are held as a local table, so they are computed once. Beyond it the table is
    handed back unmarked, and the join is left to shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True


def lookup_join(fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS, heavy_rows: int = 1_000_000) -> DataFrame:
    """Join a large table to a lookup table whose key is unique.

    Within ``max_rows`` the lookup is broadcast. Beyond it, keys that hold more than ``heavy_rows``
    rows of ``fact`` are joined by broadcasting just their lookup rows, and all other keys by a
    shuffle, so no single task receives a heavy key. Every row of ``fact`` goes through exactly one
    of the two joins. If even the heavy keys exceed the bound, they are left to the shuffle with the
    others (each is then a small part of the table).
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup join {how!r}")
    on = list(on)
    small, fits = checked_broadcast(lookup, max_rows)
    if fits:
        return fact.join(small, on, how)
    heavy, fits = checked_broadcast(
        fact.groupBy(*on).count().where(F.col("count") > heavy_rows).select(*on), max_rows)
    if not fits or heavy.isEmpty():
        return fact.join(lookup, on, how)
    heavy_lookup, fits = checked_broadcast(lookup.join(heavy, on, "left_semi"), max_rows)
    if not fits:
        return fact.join(lookup, on, how)
    light = fact.join(heavy, on, "left_anti").join(lookup, on, how)
    hot = fact.join(heavy, on, "left_semi").join(heavy_lookup, on, how)
    return light.unionByName(hot)
