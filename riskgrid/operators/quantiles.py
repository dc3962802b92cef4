"""Exact quantiles per group that never gather a large group in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.sources.workdir import materialize

# Groups up to this many rows use the built-in exact percentile, which holds a group's values in memory.
IN_MEMORY_ROWS = 2_000_000
BINS = 512
# One over the rank error of the summary that brackets a quantile, as a part of the rows.
ACCURACY = 10_000
# Values that a task sorts at once for a rank summary.
CHUNK = 1_000_000
# Values that stand for all different ones of a chunk.
PICKS = 512

# The number of its group and the value of every row of a batch.
Reader = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def exact_quantiles(df: DataFrame, value: Column | str, probs: Sequence[float],
                    by: Sequence[str] = (), in_memory_rows: int = IN_MEMORY_ROWS,
                    total_rows: int | None = None) -> DataFrame:
    """One row per group: ``by.., n, q0, q1, ..`` with linearly interpolated quantiles.

    Missing values (NULL, NaN) do not count. Groups within ``in_memory_rows`` are done by
    ``percentile``; larger ones by a mergeable rank summary that brackets every quantile and an exact count of what
    lies in the brackets, two passes whatever the distribution. Both ways are exact. A known ``total_rows`` within the bound saves the size check.
    """
    found = quantile_arrays(df, value, probs, by, in_memory_rows, total_rows)
    return found.select(*by, "n", *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))])


def quantile_arrays(df: DataFrame, value: Column | str, probs: Sequence[float],
                    by: Sequence[str] = (), in_memory_rows: int = IN_MEMORY_ROWS,
                    total_rows: int | None = None) -> DataFrame:
    """The same with all quantiles of a group in one array: ``by.., n, q``."""
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, value.cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    groups = by or ["_all"]
    largest, hot = total_rows, None
    if total_rows is None or total_rows > in_memory_rows:
        sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
        hot = sizes.where(F.col("_n") > in_memory_rows).select(*groups)
    if largest <= in_memory_rows:
        result = _by_percentile(rows, groups, probs)
    else:
        result = _by_percentile(rows.join(hot, groups, "left_anti"), groups, probs).unionByName(
            # Fewer than that many rows are never summarised, so the error is some rows at least.
            _by_brackets(rows.join(hot, groups, "left_semi"), groups, probs, min(ACCURACY, max(1, in_memory_rows // 10))))
    return result if by else result.drop("_all")


def _by_percentile(rows: DataFrame, groups: list[str], probs: Sequence[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", wanted).alias("q"))


def _near(rows: DataFrame, groups: list[str], probs: Sequence[float], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Two passes over the rows: ``groups, n, i, lo, hi, below`` for every quantile, and the counted values of its bracket.

    A mergeable rank summary gives values whose ranks are off by at most 1 / accuracy of the rows. Asked for twice that on
    either side of a quantile, it brackets the wanted ranks for certain (a group has ten rows for each part or more). The second pass counts the rows under every bracket
    and the distinct values in it: some thousandth of the rows, whatever their distribution.
    """
    around = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-2 / accuracy, 2 / accuracy)]
    summary = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in around]), accuracy).alias("s"))
    brackets = F.array(*[F.struct(
        F.lit(i).alias("i"),
        (F.col("least") if around[2 * i] <= 0 else F.get("s", F.lit(2 * i))).alias("lo"),
        (F.col("most") if around[2 * i + 1] >= 1 else F.get("s", F.lit(2 * i + 1))).alias("hi"))
        for i in range(len(probs))])
    summary = materialize(summary.select(*groups, "n", brackets.alias("brackets")), "quantile-brackets")
    located = rows.join(F.broadcast(summary.drop("n")) if len(groups) == 1 and groups[0] == "_all" else summary.drop("n"), groups)
    inside = F.filter("brackets", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    under = F.size(F.filter("brackets", lambda b: b["lo"] <= F.col("_v")))
    empty = F.lit(None).cast("double")
    cells = F.concat(F.array(F.struct(F.lit(-1).alias("i"), under.alias("place"), empty.alias("v"))),
                     F.transform(inside, lambda b: F.struct(b["i"].alias("i"), F.lit(0).alias("place"),
                                                            F.col("_v").alias("v"))))
    counted = materialize(located.select(*groups, F.explode(cells).alias("c")).select(*groups, "c.*")
                          .groupBy(*groups, "i", "place", "v").agg(F.count(F.lit(1)).alias("c")), "quantile-near")
    # A row is under a bracket if it is not above its lower end: by how many lower ends it has reached.
    reached = counted.where("i = -1").groupBy(*groups).agg(
        F.collect_list(F.struct("place", "c")).alias("reached"))  # at most one entry for each quantile
    one = summary.select(*groups, "n", F.explode("brackets").alias("b"), "brackets").join(reached, groups)
    order = F.size(F.filter("brackets", lambda o: (o["lo"] < F.col("b.lo"))))
    below = F.aggregate("reached", F.lit(0).cast("bigint"),
                        lambda a, r: a + F.when(r["place"] <= F.col("order"), r["c"]).otherwise(F.lit(0).cast("bigint")))
    targets = one.withColumn("order", order).select(*groups, "n", "b.i", "b.lo", "b.hi", below.alias("below"))
    return targets, counted.where("i >= 0").select(*groups, "i", F.col("v").alias("_v"), "c")


def _by_brackets(rows: DataFrame, groups: list[str], probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Each quantile needs the two order statistics around its position. They are brought into brackets by a rank summary
    and an exact count (two passes over the rows); what lies in the brackets is written, and all else is done on it. A
    bracket ``[lo, hi]`` with ``below`` rows under it is cut into equal-width bins; the bin that holds the wanted rank
    becomes the next bracket, with the smallest and largest value seen in it as its ends. Since those ends
    are values of the data, the bracket shrinks in every pass and ends as one value.
    """
    starts, near = _near(rows, groups, probs, accuracy)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), (F.floor if side == 0 else F.ceil)(
        F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i")) * (F.col("n") - 1)).alias("rank")) for side in (0, 1)])
    targets = materialize(starts.withColumn("t", F.explode(sides)).select(
        *groups, "n", "lo", "hi", "below", "i", "t.side", "t.rank"), "quantile-targets")
    keys = [*groups, "i"]
    while not targets.where("lo < hi").isEmpty():
        open_targets = targets.where("lo < hi")
        brackets = open_targets.select(*keys, "lo", "hi").distinct()
        width = F.col("hi") - F.col("lo")
        bin_number = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("lo")) / width * BINS))
        histogram = (near.join(brackets, keys)
                     .where(F.col("_v").between(F.col("lo"), F.col("hi")))
                     .groupBy(*keys, "lo", "hi", bin_number.alias("bin"))
                     .agg(F.sum("c").alias("c"), F.min("_v").alias("bin_lo"), F.max("_v").alias("bin_hi")))
        lower = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(
            Window.unboundedPreceding, -1)
        histogram = histogram.withColumn("c_before", F.coalesce(F.sum("c").over(lower), F.lit(0)))
        in_bin = F.col("rank") - F.col("below") - F.col("c_before")
        narrowed = (open_targets.join(histogram, [*keys, "lo", "hi"])
                    .where((in_bin >= 0) & (in_bin < F.col("c")))
                    .select(*groups, "n", F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"),
                            (F.col("below") + F.col("c_before")).alias("below"), "i", "side", "rank"))
        targets = materialize(targets.where("lo >= hi").unionByName(narrowed), "quantile-targets")
    ends = F.array_sort(F.collect_list(F.struct("i", "side", "lo")))  # two entries per quantile
    wanted = F.array(*[F.lit(float(p)) for p in probs])

    def interpolate(p: Column, i: Column) -> Column:
        position = p * (F.col("n") - 1)
        low, high = F.get("_ends", 2 * i)["lo"], F.get("_ends", 2 * i + 1)["lo"]
        return low + (position - F.floor(position)) * (high - low)

    return targets.groupBy(*groups, "n").agg(ends.alias("_ends")).select(
        *groups, "n", F.transform(wanted, interpolate).alias("q"))


# -- a few numbered groups, values worked out in Arrow batches ---------------------------------------

def _picked(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` of the different values, evenly spaced with the first and the last among them, and how many values
    lie under each and up to it."""
    different, counts = np.unique(values, return_counts=True)
    upto = counts.cumsum()
    n = len(different)
    place = np.arange(n) if n <= most else np.arange(most) * (n - 1) // (most - 1)
    return different[place], (upto - counts)[place], upto[place]


def _chunks(rows: DataFrame, read: Reader, brackets: dict[int, tuple[int, float, float]], most: int, chunk: int
            ) -> dict[int, tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """One pass: for every bracket (its group, lowest and highest value) the values under it, and summaries of those in it.

    A summary is the number of values of a chunk and its picked ones.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(brackets)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = dict.fromkeys(shipped.value, 0)
        held: dict[int, list[np.ndarray]] = {i: [] for i in shipped.value}
        sizes = dict.fromkeys(shipped.value, 0)

        def summaries(chosen: Sequence[int]) -> pa.RecordBatch:
            found = []
            for i in chosen:
                values = np.concatenate([np.zeros(0), *held[i]])
                found.append((i, below[i], len(values), *_picked(values, most)))
                below[i], held[i], sizes[i] = 0, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)),
                 pa.array([f[3] for f in found], pa.list_(pa.float64())),
                 *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (4, 5))],
                names=["i", "below", "n", "picks", "under", "upto"])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, values = read(batch)
            known = ~np.isnan(values)
            groups, values = groups[known], values[known]
            for i, (group, low, high) in shipped.value.items():
                own = values[groups == group]
                below[i] += int((own < low).sum())
                own = own[(own >= low) & (own <= high)]
                if len(own):
                    held[i].append(own)
                    sizes[i] += len(own)
            if sum(sizes.values()) > chunk:
                yield summaries([i for i in sizes if sizes[i]])
        left = [i for i in sizes if sizes[i] or below[i]]
        if left:
            yield summaries(left)

    table = rows.mapInArrow(partial, "i int, below bigint, n bigint, picks array<double>, under array<bigint>, "
                                     "upto array<bigint>").toArrow()
    out: dict[int, tuple[int, list]] = {i: (0, []) for i in brackets}
    columns = [table.column(c).to_pylist() for c in ("i", "below", "n")]
    picks = [[own.values.to_numpy(zero_copy_only=False) for part in table.column(c).chunks for own in part]
             for c in ("picks", "under", "upto")]
    for i, below, n, *own in zip(*columns, *picks):
        out[i] = (out[i][0] + below, out[i][1])
        if n:
            out[i][1].append((n, *own))
    return out


def _enclose(chunks: Sequence[tuple[int, np.ndarray, np.ndarray, np.ndarray]], ranks: Sequence[int]
             ) -> list[tuple[float, float]]:
    """Values that certainly enclose the order statistics of some ranks, equal if the chunks tell them."""
    # Up to a value lie all values up to the last pick that is not above it for certain, and under a value those under the
    # next pick at most. Both are sums over the chunks of steps at their picks.
    values = np.concatenate([own for _, own, _, _ in chunks])
    at_most = [np.diff(upto, prepend=0) for _, _, _, upto in chunks]
    under = [np.diff(below, append=n) for n, _, below, _ in chunks]
    order = np.argsort(values, kind="stable")
    values, at_most, under = values[order], np.concatenate(at_most)[order].cumsum(), np.concatenate(under)[order].cumsum()
    firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lasts = np.append(firsts[1:], len(values)) - 1
    before = np.where(firsts > 0, under[firsts - 1], 0)
    distinct, reached = values[firsts], at_most[lasts]
    out = []
    for rank in ranks:
        low = np.searchsorted(before, rank, side="right") - 1
        high = np.searchsorted(reached, rank + 1, side="left")
        out.append((float(distinct[low]), float(distinct[high])))
    return out


def numbered_quantiles(rows: DataFrame, read: Reader, groups: Sequence[int], probs: Sequence[float],
                       chunk: int = CHUNK, picks: int = PICKS) -> dict[int, np.ndarray]:
    """Exact quantiles (as of :func:`exact_quantiles`) of a few groups that are told by a number.

    A task sorts its values in chunks and emits evenly spaced values of each with their ranks. Together they enclose every
    wanted rank in two values with some thousandths of the group between them; the next pass counts what lies under
    the bracket and summarises what lies in it, mostly all of it. Nothing is shuffled; some values of every chunk come
    to the driver. Groups without a value are left out.
    """
    most = max(picks, 80 * len(probs))
    open_brackets = {i: (group, -np.inf, np.inf) for i, group in enumerate(groups)}
    wanted: dict[int, list[tuple[int, int, int]]] = {}  # bracket -> (group, quantile and side, rank)
    found: dict[tuple[int, int], float] = {}
    sizes: dict[int, int] = {}
    while open_brackets:
        summary = _chunks(rows, read, open_brackets, most, chunk)
        following: dict[tuple[int, float, float], list[tuple[int, int, int]]] = {}
        for i, (group, _, _) in open_brackets.items():
            below, chunks = summary[i]
            if i not in wanted or not sizes.get(group):
                sizes[group] = sum(c[0] for c in chunks)
                if not sizes[group]:
                    continue
                wanted[i] = [(group, 2 * k + side, int(end(p * (sizes[group] - 1))))
                             for k, p in enumerate(probs) for side, end in enumerate((np.floor, np.ceil))]
            ends = _enclose(chunks, [rank - below for _, _, rank in wanted[i]])
            for k in range(0, len(ends), 2):
                pair, own = ends[k:k + 2], wanted[i][k:k + 2]
                if all(low == high for low, high in pair):
                    found.update({(group, side): low for (_, side, _), (low, _) in zip(own, pair)})
                else:
                    following.setdefault((group, pair[0][0], pair[1][1]), []).extend(own)
        open_brackets = dict(enumerate(following))
        wanted = dict(enumerate(following.values()))
        most *= 2  # so that it ends, however the values repeat
    out = {}
    for group, n in sizes.items():
        if n:
            low, high = (np.array([found[group, 2 * k + side] for k in range(len(probs))]) for side in (0, 1))
            position = np.asarray(probs, dtype=float) * (n - 1)
            share = position - np.floor(position)
            out[group] = np.where(low == high, low, (np.ceil(position) - position) * low + share * high)
    return out
