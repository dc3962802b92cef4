"""Second-order regression trees grown level by level from distributed gradient and hessian histograms.

With gradient -w y and hessian w the gain is the reduction of weighted squared error, so the same grower serves
boosting and forests. Large nodes are split by histograms, one aggregation for all of a level; nodes with few rows are
shuffled by node and finished exactly inside a task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions import poisson_of
from riskgrid.operators.packed import COLUMNS, Tree, as_array, matrix, numbers
from riskgrid.sources.workdir import materialize

# Bins of a feature: values are in 0 .. 254, missing ones in the last.
MISSING = 255
MAX_EDGES = MISSING - 1
# Histogram cells that the driver holds for one pass; wider levels take several passes.
CELLS = 4_000_000
# Rows of a node up to which it is finished inside a task.
LOCAL_ROWS = 50_000
# Rows that are added up together.
GATHERED = 50_000
# Rows in a block of :func:`block_table`: 10,000 of them, an Arrow batch, take some 200 MB at most with eight features.
BLOCK_ROWS = 256
# Gains below this part of the children's score are rounding.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Growth:
    """Limits of a tree. Gain is score(left) + score(right) - score(node) with score T(g)^2 / (h + l2), T the
    soft threshold by l1; a cut must gain more than ``min_gain`` and leave ``min_leaf`` rows and ``min_child`` hessian
    on both sides. ``max_step`` bounds a leaf's value (0: not). ``by_tree``, ``by_level`` and ``by_node`` are the shares of features that are tried."""

    depth: int = 6
    min_leaf: int = 1
    min_child: float = 0.0
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    max_step: float = 0.0
    by_tree: float = 1.0
    by_level: float = 1.0
    by_node: float = 1.0
    seed: int = 123

    def score(self, g, h):
        with np.errstate(divide="ignore", invalid="ignore"):
            shrunk = np.maximum(np.abs(g) - self.l1, 0.0)
            return np.where(h + self.l2 > 0, shrunk * shrunk / (h + self.l2), 0.0)

    def weight(self, g, h):
        with np.errstate(divide="ignore", invalid="ignore"):
            shrunk = np.sign(g) * np.maximum(np.abs(g) - self.l1, 0.0)
            step = np.where(h + self.l2 > 0, -shrunk / (h + self.l2), 0.0)
        return np.clip(step, -self.max_step, self.max_step) if self.max_step else step


def subset(count: int, share: float, *seed) -> list[int]:
    """A seeded choice of features, at least one."""
    if share >= 1:
        return list(range(count))
    return sorted(random.Random(repr(seed)).sample(range(count), max(1, round(share * count))))


class Features:
    """Which features a node may use: nested choices by tree, level and node, the same on every run."""

    def __init__(self, growth: Growth, count: int, tree: int):
        self.growth, self.tree = growth, tree
        self.own = subset(count, growth.by_tree, growth.seed, tree)
        self.count = count

    def mask(self, level: int, path: int) -> np.ndarray:
        chosen = self.own
        chosen = [chosen[i] for i in subset(len(chosen), self.growth.by_level, self.growth.seed, self.tree, level, "l")]
        chosen = [chosen[i] for i in subset(len(chosen), self.growth.by_node, self.growth.seed, self.tree, level, path)]
        out = np.zeros(self.count, dtype=bool)
        out[chosen] = True
        return out


# -- bins -----------------------------------------------------------------------------------------

def bin_edges(df: DataFrame, features: str = "features", most: int = MAX_EDGES) -> list[np.ndarray]:
    """Cut values of every feature: a row is in bin b if b cuts are below it.

    A feature with at most ``most`` + 1 distinct values is cut at each of them, others at approximate quantiles. At most
    ``most`` numbers for each feature come to the driver.
    """
    first = df.select(features).first()
    if first is None:
        raise ValueError("no rows to bin")
    count = len(first[0])
    array = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)
    rows = df.select(array.alias("x"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * count
        for batch in batches:
            if batch.num_rows and any(len(s) <= most + 1 for s in seen):
                x = matrix(batch.column("x"))
                for f in range(count):
                    if len(seen[f]) <= most + 1:
                        values = x[:, f]
                        seen[f] = np.union1d(seen[f], values[~np.isnan(values)])
        for f in range(count):
            own = seen[f][:most + 2]
            yield pa.RecordBatch.from_pydict({"f": np.full(len(own), f, dtype=np.int32), "v": own})

    # A task gives at most ``most`` + 2 values of a feature, and what is too many does not leave its group.
    values = rows.mapInArrow(distinct, "f int, v double").distinct().groupBy("f").agg(F.collect_list("v").alias("v"))
    found = {r["f"]: r["v"] for r in values.select("f", F.when(F.size("v") <= most + 1, F.col("v")).alias("v")).collect()}
    many = [f for f, v in sorted(found.items()) if v is None]
    edges = [np.sort(np.array(found.get(f) or [], dtype=float)) for f in range(count)]
    if many:
        wide = rows.select(*[F.get("x", F.lit(f)).alias(f"f{f}") for f in many])
        cuts = wide.approxQuantile([f"f{f}" for f in many], [i / most for i in range(most + 1)], 1 / (4 * most))
        for f, c in zip(many, cuts):
            edges[f] = np.unique(c)
    # Nothing lies above the largest value, so it cuts nothing off.
    return [e[:-1] for e in edges]


def binned(df: DataFrame, edges: Sequence[np.ndarray], features: str = "features", name: str = "_b") -> DataFrame:
    """Add the bins of every row, one byte per feature. A NaN is in the last bin."""
    shipped = df.sparkSession.sparkContext.broadcast([np.asarray(e) for e in edges])
    array = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)

    @F.arrow_udf(T.BinaryType())
    def bins(rows: pa.Array) -> pa.Array:
        return row_bytes(bin_numbers(matrix(rows) if len(rows) else np.zeros((0, len(shipped.value))), shipped.value))

    return df.withColumn(name, bins(array))


def bin_numbers(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value, a byte each."""
    out = np.empty(x.shape, dtype=np.uint8)
    for f, cuts in enumerate(edges):
        out[:, f] = np.searchsorted(cuts, x[:, f], side="left")
        out[np.isnan(x[:, f]), f] = MISSING
    return out


def row_bytes(table: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of bytes."""
    ends = np.arange(len(table) + 1, dtype=np.int32) * (table.shape[1] * table.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(table.tobytes())])


def block_bytes(table: np.ndarray, rows: int = BLOCK_ROWS) -> pa.Array:
    """The rows of a matrix as an Arrow column of bytes, ``rows`` of them in each value."""
    flat = np.ascontiguousarray(table)
    ends = block_ends(len(flat), rows) * (flat.nbytes // max(len(flat), 1))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                 [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def block_ends(count: int, rows: int = BLOCK_ROWS) -> np.ndarray:
    """Where blocks of ``rows`` rows begin and end; the last one may be shorter."""
    return np.minimum(np.arange(-(-count // rows) + 1) * rows, count)


def joined_bytes(rows: pa.Array) -> np.ndarray:
    """All bytes of a binary column, end to end."""
    if rows.null_count:
        raise ValueError(f"{rows.null_count} rows have no array")
    _, ends, values = rows.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if pa.types.is_large_binary(rows.type) else np.int32)
    start, end = int(ends[rows.offset]), int(ends[rows.offset + len(rows)])
    return np.frombuffer(values, dtype=np.uint8)[start:end]


def doubles(rows: pa.Array, count: int | None = None) -> np.ndarray:
    """A column of arrays, or of the bytes of their doubles, as one matrix; of ``count`` rows where the bytes are blocks."""
    if pa.types.is_list(rows.type) or pa.types.is_large_list(rows.type) or not len(rows):
        return matrix(rows)
    # The rows may begin at any byte of the buffer.
    return np.frombuffer(joined_bytes(rows).tobytes(), dtype=np.float64).reshape(len(rows) if count is None else count, -1)


def batch_rows(batch: pa.RecordBatch) -> int:
    """Rows that a batch holds: those of its blocks, if it has blocks."""
    return int(numbers(batch.column("_rows")).sum()) if "_rows" in batch.schema.names else batch.num_rows


def copies_of(batch: pa.RecordBatch, trees: int) -> np.ndarray:
    """The copies of a batch's rows, rows x trees. Blocks hold a byte or a double for each."""
    if "_rows" not in batch.schema.names:
        return doubles(batch.column("_n"))
    count, own = batch_rows(batch), joined_bytes(batch.column("_n"))
    return (own if len(own) == count * trees else np.frombuffer(own.tobytes(), dtype=np.float64)).reshape(count, trees)


def block_table(rows: DataFrame, edges: Sequence[np.ndarray], copies: Column, uniform: bool = False,
                features: str = "features", others: Sequence[str] = ()) -> DataFrame:
    """Write rows with ``_y`` for :func:`grow` as blocks: ``_x``, ``_b``, ``_y``, ``_n`` and ``others`` (as doubles) hold
    the bytes of ``_rows`` rows each.

    Every level reads the table once more, and a block costs Spark as much as a row would. ``copies`` is an array with a
    number for each tree: the row's copies, or, with ``uniform``, what Poisson(1) copies are drawn from.
    """
    shipped = rows.sparkSession.sparkContext.broadcast([np.asarray(e) for e in edges])
    names = ["_y", *others]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ascontiguousarray(matrix(batch.column("_x")), dtype=np.float64)
            n = matrix(batch.column("_n"))
            yield pa.RecordBatch.from_pydict({
                "_rows": np.diff(block_ends(len(x))).astype(np.int32), "_x": block_bytes(x),
                "_b": block_bytes(bin_numbers(x, shipped.value)),
                "_n": block_bytes(poisson_of(n) if uniform else np.asarray(n, dtype=np.float64)),
                **{c: block_bytes(np.asarray(numbers(batch.column(c)), dtype=np.float64)) for c in names}})

    columns = ["_rows", "_x", "_b", "_n", *names]
    return materialize(
        rows.select(as_array(rows, features).alias("_x"), copies.alias("_n"), *names).mapInArrow(
            blocks, ", ".join(f"{c} {'int' if c == '_rows' else 'binary'}" for c in columns)), "drawn")


@F.arrow_udf(T.BinaryType())
def as_bytes(rows: pa.Array) -> pa.Array:
    """An array of doubles as its bytes, which Spark copies whole where it would convert an array number by number."""
    return row_bytes(np.ascontiguousarray(matrix(rows), dtype=np.float64))


def on_bins(tree: Tree, edges: Sequence[np.ndarray]) -> Tree:
    """The same tree with bin numbers for thresholds."""
    cut = [np.searchsorted(edges[f], v, side="left") if f >= 0 else np.inf for f, v in zip(tree.feature, tree.threshold)]
    return replace(tree, threshold=np.array(cut, dtype=float))


def bin_matrix(rows: pd.Series | pa.Array, count: int) -> np.ndarray:
    if isinstance(rows, pd.Series):
        return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, count)
    if not len(rows):
        return np.zeros((0, count), dtype=np.uint8)
    return joined_bytes(rows).reshape(-1, count)


class Drawn:
    """A batch of rows as matrices: bins, and per tree its gradient, hessian and copies.

    Rows come with the arrays ``_g`` and ``_h``, or with ``_y`` alone for least squares: gradient -n y, hessian n.
    ``_n`` is an array or the bytes of its doubles (see :func:`as_bytes`). All can be blocks (see :func:`block_table`).
    """

    def __init__(self, batch: pa.RecordBatch, count: int, trees: int):
        self.bins, self.n = bin_matrix(batch.column("_b"), count), copies_of(batch, trees)
        self.plain = "_y" in batch.schema.names
        if "_rows" in batch.schema.names:
            self.g, self.h = doubles(batch.column("_y"), len(self.bins)).ravel(), None
        elif self.plain:
            self.g, self.h = numbers(batch.column("_y")), None
        else:
            self.g, self.h = matrix(batch.column("_g")), matrix(batch.column("_h"))

    def of(self, tree: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient, hessian and copies of some rows in a tree."""
        n = self.n[at, tree].astype(float)
        return (-n * self.g[at], n, n) if self.plain else (self.g[at, tree], self.h[at, tree], n)

    @staticmethod
    def columns(rows: DataFrame) -> list[str]:
        blocks = ["_rows"] if "_rows" in rows.columns else []
        return [*blocks, "_b", "_y", "_n"] if "_y" in rows.columns else ["_b", "_g", "_h", "_n"]


# -- trees under construction ---------------------------------------------------------------------

class Growing:
    """A tree whose thresholds are still bin numbers."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right = [-1], [0.0], [-1], [-1]
        self.g, self.h, self.n, self.gain = [0.0], [0.0], [0], [0.0]

    def split(self, node: int, feature: int, cut: float, gain: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = at, at + 1
        for values, empty in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.g, 0.0),
                              (self.h, 0.0), (self.n, 0), (self.gain, 0.0)):
            values += [empty, empty]
        return at, at + 1

    def total(self, node: int, g: float, h: float, n: int) -> None:
        self.g[node], self.h[node], self.n[node] = float(g), float(h), int(n)

    def tree(self, growth: Growth, thresholds) -> Tree:
        feature = np.array(self.feature, dtype=np.int32)
        left = np.array(self.left, dtype=np.int32)
        g, h = np.array(self.g), np.array(self.h)
        return Tree(feature, np.array([thresholds(f, c) if f >= 0 else np.inf for f, c in zip(self.feature, self.cut)]),
                    left, np.array(self.right, dtype=np.int32), np.where(left < 0, growth.weight(g, h), 0.0),
                    np.array(self.gain), h, np.array(self.n, dtype=np.int64))


def best_cuts(hist: np.ndarray, masks: np.ndarray, growth: Growth) -> list[tuple[float, int, int, np.ndarray] | None]:
    """For every node (nodes x features x bins x [g, h, n]): the best cut as (gain, feature, bin, sums of the left side).

    Of equal gains the first feature and the lowest bin.
    """
    left = hist.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    children = growth.score(left[..., 0], left[..., 1]) + growth.score(right[..., 0], right[..., 1])
    gain = children - growth.score(total[..., 0], total[..., 1])
    fine = ((left[..., 2] >= growth.min_leaf) & (right[..., 2] >= growth.min_leaf) & (left[..., 2] > 0)
            & (right[..., 2] > 0) & (left[..., 1] >= growth.min_child) & (right[..., 1] >= growth.min_child)
            & (gain > LEAST_GAIN * children) & (gain > growth.min_gain) & masks[:, :, None])
    gain = np.where(fine, gain, -np.inf)
    out: list = []
    for node, flat in enumerate(gain.reshape(len(gain), -1)):
        at = int(flat.argmax())
        if not np.isfinite(flat[at]):
            out.append(None)
            continue
        feature, cut = divmod(at, gain.shape[2])
        out.append((float(flat[at]), feature, cut, left[node, feature, cut]))
    return out


class BinWalk:
    """The nodes of a growing tree that rows of bins fall into, in small integers throughout."""

    def __init__(self, tree: Tree):
        at, leaf = np.arange(len(tree)), tree.left < 0
        self.feature = np.where(leaf, 0, tree.feature).astype(np.int64)
        self.cut = np.where(leaf, 0, tree.threshold).astype(np.uint8)
        self.children = np.column_stack([np.where(leaf, at, tree.right), np.where(leaf, at, tree.left)]).ravel()
        self.depth = tree.depth()

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        flat, rows = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        node = np.zeros(len(bins), dtype=np.int64)
        for _ in range(self.depth):
            goes_left = flat.take(rows + self.feature.take(node)) <= self.cut.take(node)
            node = self.children.take(2 * node + goes_left)
        return node


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches put together to some more rows, as every batch costs a few calls for every tree and feature."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            held += batch_rows(batch)
        if held >= rows:
            yield pa.concat_batches(waiting)
            waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _histograms(rows: DataFrame, trees: list[Growing], wanted: list[tuple[int, int]], count: int, bins: int) -> np.ndarray:
    """Sums of gradient, hessian and rows per (tree, node), feature and bin, in one aggregation.

    ``rows`` has the columns of :class:`Drawn`. A task walks its rows down the trees so far, adds them up, and shuffles
    its filled cells. Batches are taken from Arrow as matrices: no object is made for a row.
    """
    structure = [Tree(np.array(t.feature), np.array(t.cut, dtype=float), np.array(t.left), np.array(t.right),
                      *(np.zeros(len(t.feature)) for _ in range(4))) for t in trees]
    slots, plain = {key: i for i, key in enumerate(wanted)}, "_y" in rows.columns
    used = sorted({t for t, _ in wanted})
    shipped = rows.sparkSession.sparkContext.broadcast((structure, slots, used))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        structure, slots, used = shipped.value
        # By feature first: a tree's rows fill a range of slots of each, no wider than the tree.
        sums = np.zeros((3, count, len(slots) * bins))
        walkers = {t: BinWalk(structure[t]) for t in used}
        slot_of = {t: np.full(len(structure[t]), -1, dtype=np.int64) for t in used}
        for (t, node), slot in slots.items():
            slot_of[t][node] = slot
        first = {t: min(slot for (own, _), slot in slots.items() if own == t) for t in used}
        last = {t: max(slot for (own, _), slot in slots.items() if own == t) + 1 for t in used}
        for batch in gathered(batches):
            drawn = Drawn(batch, count, len(structure))
            by_feature = np.ascontiguousarray(np.minimum(drawn.bins, bins - 1).T)
            for t in used:
                inside = np.flatnonzero(drawn.n[:, t] > 0)
                slot = slot_of[t].take(walkers[t].nodes(drawn.bins[inside]))
                fits = np.flatnonzero(slot >= 0)
                own = inside[fits]
                g, h, n = drawn.of(t, own)
                # A tree's slots lie side by side: its rows fill the cells of this range only.
                base = (slot[fits] - first[t]) * bins
                size = (last[t] - first[t]) * bins
                span = slice(first[t] * bins, last[t] * bins)
                for f in range(count):
                    cell = base + by_feature[f].take(own)
                    for i, v in enumerate((g, n) if h is n else (g, n, h)):
                        sums[(0, 2, 1)[i], f, span] += np.bincount(cell, v, size)
        if plain:
            sums[1] = sums[2]
        # The cells are numbered by slot, feature and bin.
        table = sums.reshape(3, count, len(slots), bins).transpose(0, 2, 1, 3).reshape(3, -1)
        at = np.flatnonzero(table[2])
        yield pa.RecordBatch.from_pydict({"cell": at, "g": table[0][at], "h": table[1][at], "n": table[2][at]})

    cells = (rows.select(*Drawn.columns(rows)).mapInArrow(partial, "cell bigint, g double, h double, n double")
             .groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas())
    out = np.zeros((len(wanted) * count * bins, 3))
    out[cells["cell"].to_numpy()] = cells[["g", "h", "n"]].to_numpy()
    return out.reshape(len(wanted), count, bins, 3)


def grow(rows: DataFrame, edges: Sequence[np.ndarray], growth: Growth | Sequence[Growth], trees: int = 1,
         first_tree: int = 0, local_rows: int = 0, features: str = "features",
         numbers: Sequence[int] | None = None) -> list[Tree]:
    """Grow some trees side by side on rows with ``_b`` and the arrays ``_g``, ``_h``, ``_n`` (one entry per tree), or
    with ``_y`` in place of ``_g`` and ``_h`` for least squares. ``_n`` and the features can also be bytes (:func:`as_bytes`),
    or all of it blocks (:func:`block_table`).

    Trees can have limits of their own (a list of ``growth``); ``numbers`` (from ``first_tree`` on, if not given) fix their
    choice of features.

    Each level is one aggregation over the rows (more only if its histograms pass ``CELLS``); of two children the one with
    fewer rows is counted, the other is what the parent has more. With ``local_rows`` nodes of at most so many rows (copies
    counted) leave the level-wise way: their rows are shuffled by (tree, node) and the subtree is finished on exact
    feature values inside a task, down to the depth.
    """
    count, bins = len(edges), max(len(e) for e in edges) + 2  # the last bin holds missing values
    grown = [Growing() for _ in range(trees)]
    limits = [growth] * trees if isinstance(growth, Growth) else list(growth)
    numbers = list(numbers) if numbers is not None else list(range(first_tree, first_tree + trees))
    choice = [Features(limits[t], count, numbers[t]) for t in range(trees)]
    frontier = {(t, 0): 1 for t in range(trees)}  # node -> its path from the root as a binary number
    known: dict[tuple[int, int], np.ndarray] = {}
    local: list[tuple[int, int, int, int]] = []
    if local_rows:
        totals = _copies(rows, trees)
        for t in range(trees):
            if (totals[t] or 0) <= local_rows:
                local.append((t, 0, 0, 1))
                del frontier[t, 0]
    per_node = count * bins
    for level in range(max((g.depth for g in limits), default=0) + 1):
        if not frontier:
            break
        counted = [k for k in frontier if k not in known]
        held: dict[tuple[int, int], np.ndarray] = {}
        step = max(1, CELLS // per_node)
        following: dict[tuple[int, int], int] = {}
        siblings: dict[tuple[int, int], tuple[tuple[int, int], tuple[int, int]]] = {
            k: known[k] for k in frontier if k in known}
        for at in range(0, len(counted), step):
            part = counted[at:at + step]
            for key, h in zip(part, _histograms(rows, grown, part, count, bins)):
                held[key] = h
        for key, (parent_hist, other) in siblings.items():
            held[key] = parent_hist - held[other]
        known = {}
        for t, node in frontier:
            grown[t].total(node, *held[t, node][0].sum(axis=0))
        # Only the root of a tree without levels is here at its full depth.
        keys = [k for k in frontier if limits[k[0]].depth > level]
        if not keys:
            break
        masks = np.stack([choice[t].mask(level, frontier[t, node]) for t, node in keys])
        cuts: dict[tuple[int, int], tuple | None] = {}
        for own in dict.fromkeys(limits[t] for t, _ in keys):
            same = [i for i, (t, _) in enumerate(keys) if limits[t] == own]
            for at in range(0, len(same), step):
                part = same[at:at + step]
                found = best_cuts(np.stack([held[keys[i]] for i in part]), masks[part], own)
                cuts.update(zip([keys[i] for i in part], found))
        for t, node in keys:
            hist, cut, own = held[t, node], cuts[t, node], limits[t]
            total = hist[0].sum(axis=0)
            if cut is None:
                continue
            gain, feature, place, left_sums = cut
            a, b = grown[t].split(node, feature, place, gain)
            right_sums = total - left_sums
            grown[t].total(a, *left_sums)
            grown[t].total(b, *right_sums)
            open_children = []
            for child, sums, path in ((a, left_sums, frontier[t, node] * 2), (b, right_sums, frontier[t, node] * 2 + 1)):
                if level + 1 == own.depth or sums[2] < 2 * max(own.min_leaf, 1):
                    continue
                if local_rows and sums[2] <= local_rows:
                    local.append((t, child, level + 1, path))
                    continue
                open_children.append(child)
                following[t, child] = path
            if len(open_children) == 2:
                fewer, more = (a, b) if left_sums[2] <= right_sums[2] else (b, a)
                known[t, more] = (hist, (t, fewer))
        frontier = following
    finished = _finish(rows, grown, local, limits, count, numbers, features) if local else {}
    return [_assemble(grown[t], finished.get(t, []), limits[t], edges) for t in range(trees)]


def _copies(rows: DataFrame, trees: int) -> list[float]:
    """Rows of every tree, copies counted."""
    if isinstance(rows.schema["_n"].dataType, T.ArrayType):
        return rows.agg(*[F.sum(F.get("_n", F.lit(t))).alias(str(t)) for t in range(trees)]).first()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trees)
        for batch in batches:
            if batch.num_rows:
                total += np.nansum(copies_of(batch, trees), axis=0, dtype=float)
        yield pa.RecordBatch.from_pydict({"tree": np.arange(trees, dtype=np.int32), "n": total})

    own = ["_rows", "_n"] if "_rows" in rows.columns else ["_n"]
    found = rows.select(*own).mapInArrow(partial, "tree int, n double").groupBy("tree").agg(F.sum("n").alias("n")).collect()
    totals = {r["tree"]: r["n"] for r in found}
    return [totals.get(t, 0.0) for t in range(trees)]


def _assemble(grown: Growing, parts: Sequence[pd.DataFrame], growth: Growth, edges: Sequence[np.ndarray]) -> Tree:
    """The tree with the subtrees that tasks have finished put in their places, all at once."""
    def value(feature: int, cut: float) -> float:
        # Beyond the last cut only missing values are left.
        return float(edges[feature][int(cut)]) if cut < len(edges[feature]) else float("inf")

    tree = grown.tree(growth, value)
    if not parts:
        return tree
    sizes = np.array([len(p) - 1 for p in parts])
    shifts = len(tree) + np.cumsum(sizes) - sizes - 1  # a subtree's node 1 follows what is there
    roots = np.array([p["root"].iloc[0] for p in parts])
    arrays = {}
    for name in COLUMNS:
        columns = [p[name].to_numpy() for p in parts]
        if name in ("left", "right"):
            columns = [np.where(c >= 0, c + shift, -1) for c, shift in zip(columns, shifts)]
        arrays[name] = np.concatenate([getattr(tree, name), *[c[1:] for c in columns]])
        arrays[name][roots] = [c[0] for c in columns]
    return Tree(**arrays)


# -- finishing small nodes ------------------------------------------------------------------------

def exact_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, growth: Growth, choice: Features,
               depth: int, path: int) -> pd.DataFrame:
    """The subtree over some rows with cuts between any two different values, all nodes of a level side by side.

    ``depth`` and ``path`` tell where its root lies. Nodes are in the order of levels; a NaN is larger than any value.
    """
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    orders = [np.argsort(x[:, f], kind="stable") for f in range(x.shape[1])]
    columns: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "value", "gain", "cover", "n")}
    first, paths = 0, [path]
    level = depth
    while True:
        width = len(paths)
        sums = [np.bincount(node[rows], v[rows], width) for v in (g, h, n)]
        gain = np.full(width, -np.inf)
        feature = np.full(width, -1, dtype=np.int64)
        threshold = np.full(width, np.inf)
        if level < growth.depth:
            masks = np.stack([choice.mask(level, p) for p in paths])
            own_g, totals, floor = g, sums[0], np.zeros(width)
            if growth.l1 == 0 and growth.l2 == 0:
                # Without penalties the gain does not change with a common shift; centred sums keep its digits.
                middle = sums[0] / np.maximum(sums[1], 1e-300)
                own_g = g - h * middle[np.minimum(node, width - 1)]
                totals = np.bincount(node[rows], own_g[rows], width)
                floor = (4 * np.finfo(float).eps * middle) ** 2 * sums[1]
            total_score = growth.score(totals, sums[1])
            for f in np.flatnonzero(masks.any(axis=0)):
                order = orders[f]
                by = order[np.argsort(node[order], kind="stable")]
                at = node[by]
                value = x[by, f]
                begins = np.concatenate([[True], at[1:] != at[:-1]])
                start = np.flatnonzero(begins)[np.cumsum(begins) - 1]

                def prefix(v):
                    run = np.cumsum(v[by])
                    return run - (run[start] - v[by][start])

                gl, hl, nl = prefix(own_g), prefix(h), prefix(n)
                gr, hr, nr = totals[at] - gl, sums[1][at] - hl, sums[2][at] - nl
                apart = np.zeros(len(by), dtype=bool)
                apart[:-1] = (at[1:] == at[:-1]) & (value[:-1] != value[1:]) & ~np.isnan(value[:-1])
                fine = (apart & masks[at, f] & (nl >= growth.min_leaf) & (nr >= growth.min_leaf)
                        & (hl >= growth.min_child) & (hr >= growth.min_child))
                children = growth.score(gl, hl) + growth.score(gr, hr)
                own = children - total_score[at]
                own = np.where(fine & (own > LEAST_GAIN * children) & (own > floor[at]) & (own > growth.min_gain), own,
                               -np.inf)
                top = np.maximum.reduceat(own, np.flatnonzero(begins))
                nodes = at[begins]
                better = top > gain[nodes]
                if better.any():
                    is_top = np.flatnonzero(own == top[np.cumsum(begins) - 1])
                    place = is_top[np.unique(at[is_top], return_index=True)[1]]
                    low, high = value[place], value[np.minimum(place + 1, len(value) - 1)]
                    middle = np.where(np.isnan(high), low, low + (high - low) / 2)
                    middle = np.where((middle >= low) & (middle < high) | np.isnan(high), middle, low)
                    gain[nodes[better]] = top[better]
                    feature[nodes[better]] = f
                    threshold[nodes[better]] = middle[better]
        split = feature >= 0
        child = first + width + 2 * (np.cumsum(split) - 1)
        columns["feature"] += np.where(split, feature, -1).tolist()
        columns["threshold"] += np.where(split, threshold, np.inf).tolist()
        columns["left"] += np.where(split, child, -1).tolist()
        columns["right"] += np.where(split, child + 1, -1).tolist()
        columns["value"] += np.where(split, 0.0, growth.weight(sums[0], sums[1])).tolist()
        columns["gain"] += np.where(split, gain, 0.0).tolist()
        columns["cover"] += sums[1].tolist()
        columns["n"] += sums[2].astype(np.int64).tolist()
        if not split.any():
            return pd.DataFrame(columns)
        stays = split[node[rows]]
        rows = rows[stays]
        orders = [o[split[node[o]]] for o in orders]
        at = node[rows]
        goes_right = ~(x[rows, feature[at]] <= threshold[at])
        new = 2 * (np.cumsum(split) - 1)
        node[rows] = new[at] + goes_right
        paths = [p * 2 + side for p, s in zip(paths, split) if s for side in (0, 1)]
        first += width
        level += 1


def _finish(rows: DataFrame, grown: list[Growing], local: list[tuple[int, int, int, int]], limits: Sequence[Growth],
            count: int, names: Sequence[int], features: str) -> dict[int, list[pd.DataFrame]]:
    structure = [Tree(np.array(t.feature), np.array(t.cut, dtype=float), np.array(t.left), np.array(t.right),
                      *(np.zeros(len(t.feature)) for _ in range(4))) for t in grown]
    places = {(t, node): (level, path) for t, node, level, path in local}
    shipped = rows.sparkSession.sparkContext.broadcast((structure, places))
    kept = isinstance(rows.schema[features].dataType, (T.ArrayType, T.BinaryType))
    array = F.col(features) if kept else vector_to_array(features)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        structure, places = shipped.value
        used = sorted({t for t, _ in places})
        walkers = {t: BinWalk(structure[t]) for t in used}
        wanted = {t: np.array([(t, i) in places for i in range(len(structure[t]))]) for t in used}
        for batch in batches:
            if not batch.num_rows:
                continue
            drawn = Drawn(batch, count, len(structure))
            x = doubles(batch.column("_x"), len(drawn.bins))
            for t in used:
                inside = np.flatnonzero(drawn.n[:, t] > 0)
                node = walkers[t].nodes(drawn.bins[inside])
                fits = wanted[t][node]
                own = inside[fits]
                if len(own):
                    yield pa.RecordBatch.from_pydict({
                        "tree": np.full(len(own), t, dtype=np.int32), "root": node[fits].astype(np.int32),
                        "row": row_bytes(np.column_stack([x[own], *drawn.of(t, own)]))})

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        _, places = shipped.value
        t, root = (int(k.as_py()) for k in key)
        level, path = places[t, root]
        table = np.concatenate([doubles(chunk) for chunk in group.column("row").chunks if len(chunk)])
        x, (g, h, n) = table[:, :-3], np.ascontiguousarray(table[:, -3:].T)
        # The order of shuffled rows is not fixed, the order of sums is.
        order = np.lexsort((*x.T, n, h, g))
        out = exact_tree(x[order], g[order], h[order], n[order], limits[t], Features(limits[t], count, names[t]), level,
                         path)
        whole = pd.DataFrame({"tree": t, "root": root, "node": np.arange(len(out))}).join(out)
        return pa.Table.from_pandas(whole.astype({c: "int32" for c in ("tree", "root", "node", "feature", "left", "right")}),
                                    preserve_index=False)

    routed = rows.select(*Drawn.columns(rows), array.alias("_x")).mapInArrow(
        route, "tree int, root int, row binary")
    found = routed.groupBy("tree", "root").applyInArrow(
        finish, "tree int, root int, node int, feature int, threshold double, left int, right int, value double, "
                "gain double, cover double, n bigint").toPandas().sort_values(["tree", "root", "node"])
    parts: dict[int, list[pd.DataFrame]] = {}
    for (t, _), part in found.groupby(["tree", "root"], sort=True):
        parts.setdefault(t, []).append(part)
    return parts
