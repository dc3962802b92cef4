"""Group-wise splitting, sampling, folds and column permutation.

Splits, samples and folds follow the md5 order of the row key, so they are the same on every run and after a
lost executor, and need no random state. Permutations follow the row numbers of a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import round_count, row_hash
from riskgrid.operators.ranking import band_of_hash, hash_cutoffs, hash_rank
from riskgrid.operators.sizes import lookup_join
from riskgrid.sources.workdir import materialize

TOP_K_ROWS = 10_000


def group_sizes(df: DataFrame, group: str = "grid_id") -> DataFrame:
    """Rows per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def group_split_table(df: DataFrame, group: str = "grid_id", min_rows: int = 100,
                      train: float = 0.70, validate: float = 0.15, seed: int = 5) -> DataFrame:
    """One row per group with its split.

    Groups below ``min_rows`` always train. The others are taken in hash order: the first
    ``round(train * n)`` train, the next ``round(validate * n)`` validate, the rest test. The two
    boundaries are hash values, so the assignment is a plain expression on the group table.
    """
    sizes = materialize(group_sizes(df, group), "group-sizes")
    large = sizes.where(F.col("n") >= min_rows)
    count = large.count()
    n_train = round_count(count * train)
    n_validate = min(round_count(count * validate), count - n_train)
    cutoffs = hash_cutoffs(large, [group], seed, [n_train, n_train + n_validate]) if count else ["", ""]
    split = band_of_hash([group], seed, cutoffs, ["train", "validate", "test"])
    return sizes.withColumn(
        "split", F.when(F.col("n") < min_rows, F.lit("train")).otherwise(split))


def group_split(df: DataFrame, group: str = "grid_id", min_rows: int = 100,
                train: float = 0.70, validate: float = 0.15, seed: int = 5) -> DataFrame:
    """Attach ``split`` to every row; a group is never cut."""
    table = group_split_table(df, group, min_rows, train, validate, seed).select(group, "split")
    return lookup_join(df, table, [group], "inner")


def split_membership(df: DataFrame, table: DataFrame, split: str, group: str = "grid_id") -> DataFrame:
    """Rows whose group belongs to one split."""
    chosen = table.where(F.col("split") == split).select(group)
    return lookup_join(df, chosen, [group], "left_semi")


def split_counts(table: DataFrame) -> DataFrame:
    """Groups per split."""
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"))


def sample_fraction(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 1,
                    exact: bool = True) -> DataFrame:
    """Sample without replacement. Exact: ``round(fraction * n)`` rows, taken by a hash cutoff and
    thus without moving rows. Otherwise an independent draw per row (one pass, size approximate)."""
    if not exact:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    return sample_n(df, keys, round_count(df.count() * fraction), seed)


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (all rows, if there are fewer). Small samples are a top-k, larger ones a
    hash cutoff."""
    if n <= TOP_K_ROWS:
        return df.withColumn("_h", row_hash(keys, seed)).orderBy("_h").limit(n).drop("_h")
    if n >= df.count():
        return df
    (cutoff,) = hash_cutoffs(df, keys, seed, [n])
    return df.where(row_hash(keys, seed) <= F.lit(cutoff))


def kfold_assign(df: DataFrame, keys: Sequence[str], k: int, seed: int = 2) -> DataFrame:
    """Shuffled folds of equal size: the first ``n mod k`` folds have one row more."""
    total = df.count()
    sizes = [total // k + (1 if i < total % k else 0) for i in range(k)]
    ranks = [sum(sizes[:i + 1]) for i in range(k - 1)]
    cutoffs = hash_cutoffs(df, keys, seed, ranks)
    return df.withColumn("fold", band_of_hash(keys, seed, cutoffs, list(range(k))))


def numbered(df: DataFrame, name: str = "_row") -> tuple[DataFrame, int]:
    """Add contiguous row numbers from 0 and tell how many there are, without a sort.

    The table is written with the place of every row in its partition; the partitions' sizes (a number for
    each) are added up on the driver and joined back. A task that is run again reads the same numbers.
    """
    stored = materialize(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(offsets, "_part BIGINT, _offset BIGINT")
    rows = lookup_join(stored.withColumn("_part", part), offsets, ["_part"], "inner")
    number = F.col("_offset") + F.col("_place").bitwiseAND(F.lit(2 ** 33 - 1))
    return rows.withColumn(name, number).drop("_place", "_part", "_offset"), total


def feistel(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: four Feistel rounds on the smallest even number of bits that holds n, again
    while the result lies beyond n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def mixed(v: np.ndarray, key: int) -> np.ndarray:
        v = v + np.uint64((key * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2 ** 64)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    out = rows.astype(np.uint64)
    walking = np.ones(len(out), dtype=bool)
    while walking.any():
        left, right = out[walking] >> half, out[walking] & mask
        for number in range(4):
            left, right = right, left ^ (mixed(right, 4 * seed + number) & mask)
        out[walking] = (left << half) | right
        walking = out >= n
    return out.astype(np.int64)


def permuted(row: Column, n: int, seed: Column | int) -> Column:
    """The place of a row number under the keyed permutation; the seed may be a column."""
    @F.pandas_udf("bigint")
    def place(rows: pd.Series, seeds: pd.Series) -> pd.Series:
        out = np.empty(len(rows), dtype=np.int64)
        for value in seeds.unique():
            own = (seeds == value).to_numpy()
            out[own] = feistel(rows.to_numpy()[own], n, int(value))
        return pd.Series(out)

    return place(row, seed if isinstance(seed, Column) else F.lit(seed))


def permute_column(df: DataFrame, keys: Sequence[str], column: str, seed: int = 42, by_key: bool = False) -> DataFrame:
    """Shuffle one column over the rows, the rest stays.

    Rows are numbered by partition and place, and a row receives the value of the row whose number the keyed
    permutation takes to its own: one equi-join, no sort. The result is fixed for a written table, but follows its
    layout. ``by_key`` makes it follow the keys alone, at the price of two hash orders: the row at rank r of one order
    receives the value of the row at rank r of a second, independent one.
    """
    if by_key:
        receivers = hash_rank(df.drop(column), row_hash(keys, seed), name="_rank")
        givers = hash_rank(df.select(*keys, column), row_hash(keys, seed + 1), name="_rank").select(
            "_rank", column)
        return receivers.join(givers, "_rank").drop("_rank").select(*df.columns)
    rows, n = numbered(df)
    givers = rows.select(permuted(F.col("_row"), n, seed).alias("_row"), column)
    return rows.drop(column).join(givers.hint("shuffle_hash"), "_row").select(*df.columns)
