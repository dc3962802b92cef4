"""Tree ensembles as flat arrays: broadcast once, scored in one vectorised pass, saved as one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.sources.workdir import materialize, shared_path

# Bytes of node arrays that are broadcast at once; larger ensembles are scored block by block.
BROADCAST_BYTES = 256 * 2 ** 20
# Rows times trees that are walked side by side.
WALK = 1_000_000
COLUMNS = ("feature", "threshold", "left", "right", "value", "gain", "cover", "n")
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, value double, gain double, "
               "cover double, n bigint, categories array<int>")


@dataclass(frozen=True)
class Tree:
    """One tree. Node 0 is the root; ``left`` and ``right`` are -1 at leaves. A row goes left where its feature is at
    most the threshold, or, at nodes with ``categories``, where it is one of them; a NaN goes right."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    n: np.ndarray
    categories: dict[int, tuple[int, ...]] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.feature)

    @property
    def leaves(self) -> np.ndarray:
        """Node numbers of the leaves; a leaf's number is its place here."""
        return np.flatnonzero(self.left < 0)

    def depth(self) -> int:
        level = np.zeros(len(self), dtype=int)
        for i in range(len(self)):  # children come after their parents
            if self.left[i] >= 0:
                level[self.left[i]] = level[self.right[i]] = level[i] + 1
        return int(level.max())

    def with_values(self, values: Sequence[float]) -> Tree:
        """New leaf values, by leaf number."""
        value = np.zeros(len(self))
        value[self.leaves] = values
        return replace(self, value=value)


class Packed:
    """The nodes of some trees end to end, in the form that rows are walked through. Leaves lead to themselves."""

    def __init__(self, trees: Sequence[Tree]):
        sizes = np.array([len(t) for t in trees])
        self.roots = np.cumsum(sizes) - sizes
        shift = np.repeat(self.roots, sizes)
        at = np.arange(len(shift))
        left = np.concatenate([t.left for t in trees]).astype(np.int64)
        leaf = left < 0
        self.left = np.where(leaf, at, left + shift)
        self.right = np.where(leaf, at, np.concatenate([t.right for t in trees]) + shift)
        self.feature = np.where(leaf, 0, np.concatenate([t.feature for t in trees])).astype(np.int64)
        self.threshold = np.where(leaf, np.inf, np.concatenate([t.threshold for t in trees]))
        self.value = np.concatenate([t.value for t in trees]).astype(float)
        self.leaf = np.concatenate([np.cumsum(t.left < 0) - 1 for t in trees])
        self.children = np.column_stack([self.right, self.left]).ravel()
        self.depth = max(t.depth() for t in trees)
        members: list[int] = []
        self.set_at = np.full(len(at), -1, dtype=np.int64)
        self.set_size = np.zeros(len(at), dtype=np.int64)
        for root, tree in zip(self.roots, trees):
            for node, chosen in tree.categories.items():
                table = np.zeros(max(chosen, default=0) + 1, dtype=np.int64)
                table[list(chosen)] = 1
                self.set_at[root + node], self.set_size[root + node] = len(members), len(table)
                members.extend(table)
        self.members = np.array(members or [0], dtype=bool)
        self.has_sets = bool((self.set_at >= 0).any())

    def walk(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """For blocks of trees: the tree numbers, and the final node of every row (rows x trees)."""
        x = np.ascontiguousarray(x)
        flat, width = x.ravel(), x.shape[1]
        rows = (np.arange(len(x)) * width)[:, None]
        step = max(1, WALK // max(len(x), 1))
        for first in range(0, len(self.roots), step):
            roots = self.roots[first:first + step]
            node = np.broadcast_to(roots, (len(x), len(roots))).copy()
            for _ in range(self.depth):
                seen = flat.take(rows + self.feature.take(node))
                goes_left = seen <= self.threshold.take(node)
                if self.has_sets:
                    at, size = self.set_at[node], self.set_size[node]
                    whole = np.where((seen >= 0) & (seen < size), seen, 0).astype(np.int64)
                    known = (seen >= 0) & (seen < size) & self.members[np.maximum(at, 0) + whole]
                    goes_left = np.where(at >= 0, known, goes_left)
                node = self.children.take(2 * node + goes_left)
            yield slice(first, first + len(roots)), node

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' outputs for every row."""
        total = np.zeros(len(x))
        for _, node in self.walk(x):
            total += self.value.take(node).sum(axis=1)
        return total


def matrix(rows: pd.Series | pa.Array) -> np.ndarray:
    """A column of equally long arrays as one matrix. An Arrow column is taken as it lies in memory."""
    if not len(rows):
        return np.zeros((0, 1))
    if isinstance(rows, pd.Series):
        return np.stack(rows.to_numpy())
    if rows.null_count:
        raise ValueError(f"{rows.null_count} rows have no array")
    return numbers(rows.flatten()).reshape(len(rows), -1)


def numbers(column: pa.Array) -> np.ndarray:
    """An Arrow column of numbers; a NULL is NaN."""
    return column.to_numpy(zero_copy_only=False)


def arrays(table: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of arrays."""
    ends = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(table).ravel()))


def structs(**columns: np.ndarray) -> pa.Array:
    """Columns of equal length as one Arrow column of structs."""
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


@dataclass(frozen=True)
class Ensemble:
    """Trees whose outputs, times ``rate``, are added to ``base`` (boosting) or averaged (``mean``).

    The number of features is that of the vectors it was fitted on. ``log`` holds the errors of the fit.
    """

    trees: tuple[Tree, ...]
    base: float = 0.0
    rate: float = 1.0
    mean: bool = False
    log: tuple[tuple[int, str, float], ...] = ()

    def __len__(self) -> int:
        return len(self.trees)

    def first(self, trees: int | None) -> Ensemble:
        return self if trees is None else replace(self, trees=self.trees[:trees])

    def _blocks(self, limit: int) -> list[tuple[Tree, ...]]:
        blocks: list[list[Tree]] = [[]]
        size = 0
        for tree in self.trees:
            if blocks[-1] and size + 64 * len(tree) > limit:
                blocks.append([])
                size = 0
            blocks[-1].append(tree)
            size += 64 * len(tree)
        return [tuple(b) for b in blocks if b]

    def fits_one_block(self, limit: int = BROADCAST_BYTES) -> bool:
        """Whether all trees may be broadcast at once."""
        return len(self._blocks(limit)) <= 1

    def transform(self, df: DataFrame, name: str = "yhat", rounds: int | None = None, features: str = "features",
                  limit: int = BROADCAST_BYTES) -> DataFrame:
        """Add the prediction of the first ``rounds`` trees (all by default) as one scoring node.

        The node arrays are broadcast once. Beyond ``limit`` bytes trees are scored block by block, each in a pass
        that adds to the sums of the last one, so that no worker holds more than a block.
        """
        used = self.first(rounds)
        weight = self.rate / len(used) if self.mean and len(used) else self.rate
        out, total = df, F.lit(float(self.base))
        blocks = used._blocks(limit)
        for number, block in enumerate(blocks):
            total = total + F.lit(weight) * _sums(df.sparkSession, block)(as_array(df, features))
            if number < len(blocks) - 1:
                out = materialize(out.withColumn("_partial", total), "scored")
                total = F.col("_partial")
        return out.withColumn(name, total).drop("_partial")

    def outputs(self, df: DataFrame, name: str = "tree_predictions", features: str = "features") -> DataFrame:
        """Add the outputs of the single trees as an array."""
        shipped = df.sparkSession.sparkContext.broadcast(Packed(self.trees))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def outputs(rows: pa.Array) -> pa.Array:
            return arrays(tree_outputs(shipped.value, matrix(rows)))

        return df.withColumn(name, outputs(as_array(df, features)))

    def leaf_numbers(self, df: DataFrame, name: str, features: str = "features") -> DataFrame:
        """Add the leaf a row falls into in each tree, as an array."""
        shipped = df.sparkSession.sparkContext.broadcast(Packed(self.trees))

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def leaves(rows: pa.Array) -> pa.Array:
            return arrays(tree_leaves(shipped.value, matrix(rows)))

        return df.withColumn(name, leaves(as_array(df, features)))

    def eval_log(self, spark: SparkSession) -> DataFrame:
        """``round, split, rmse`` as recorded during the fit."""
        return spark.createDataFrame(list(self.log), "round INT, split STRING, rmse DOUBLE")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node; its size is that of the model, which the driver holds anyway."""
        parts = []
        for number, t in enumerate(self.trees):
            parts.append(pd.DataFrame({
                "tree": number, "node": np.arange(len(t)), "feature": t.feature, "threshold": t.threshold, "left": t.left,
                "right": t.right, "value": t.value, "gain": t.gain, "cover": t.cover, "n": t.n,
                "categories": [list(t.categories[i]) if i in t.categories else None for i in range(len(t))]}))
        columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        whole = pd.concat(parts) if parts else pd.DataFrame(columns=columns)
        return spark.createDataFrame([tuple(r) for r in whole.astype(object).itertuples(index=False)], NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """All trees as one table of nodes, the head and the log beside it."""
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.base, self.rate, self.mean, len(self))],
                              "base DOUBLE, rate DOUBLE, mean BOOLEAN, trees INT").write.mode("overwrite").parquet(f"{path}/head")
        self.eval_log(spark).write.mode("overwrite").parquet(f"{path}/log")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        head = spark.read.parquet(f"{path}/head").first()
        log = tuple(tuple(r) for r in spark.read.parquet(f"{path}/log").orderBy("round", "split").collect())
        trees = _trees(spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas())
        if len(trees) != head["trees"]:
            raise ValueError(f"{path} holds {len(trees)} of {head['trees']} trees")
        return Ensemble(trees, head["base"], head["rate"], head["mean"], log)


def _trees(nodes: pd.DataFrame) -> tuple[Tree, ...]:
    trees = []
    for _, t in nodes.groupby("tree", sort=True):
        sets = {int(n): tuple(int(v) for v in c) for n, c in zip(t["node"], t["categories"]) if c is not None}
        trees.append(Tree(*(t[c].to_numpy() for c in COLUMNS), sets))
    return tuple(trees)


def as_array(df: DataFrame, features: str) -> Column:
    """A column of vectors as one of arrays; arrays stay as they are."""
    return F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)


def _sums(spark: SparkSession, trees: Sequence[Tree]) -> Callable[[Column], Column]:
    shipped = spark.sparkContext.broadcast(Packed(trees))

    @F.arrow_udf(T.DoubleType())
    def sums(rows: pa.Array) -> pa.Array:
        return pa.array(shipped.value.sums(matrix(rows)))

    return sums


def tree_outputs(packed: Packed, x: np.ndarray) -> np.ndarray:
    """Rows x trees."""
    out = np.empty((len(x), len(packed.roots)))
    for trees, node in packed.walk(x):
        out[:, trees] = packed.value[node]
    return out


def tree_leaves(packed: Packed, x: np.ndarray) -> np.ndarray:
    """Rows x trees: the leaf's number in its tree."""
    out = np.empty((len(x), len(packed.roots)), dtype=np.int32)
    for trees, node in packed.walk(x):
        out[:, trees] = packed.leaf[node]
    return out


def pack(spark: SparkSession, model: Ensemble | MLWritable) -> Ensemble:
    """The ensemble of a fitted MLlib tree model (single tree, forest or boosted trees); ensembles stay as they are."""
    if isinstance(model, Ensemble):
        return model
    path = shared_path(spark, "model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    nodes = (nodes.select(F.col("treeID").alias("tree"), "nodeData.*") if "treeID" in nodes.columns
             else nodes.select(F.lit(0).alias("tree"), "*"))
    is_leaf = F.col("leftChild") < 0
    by_set = F.col("split.numCategories") >= 0
    rows = nodes.select(
        "tree", F.col("id").alias("node"), F.when(is_leaf, -1).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(is_leaf | by_set, float("inf")).otherwise(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("value"), "gain",
        F.col("rawCount").cast("double").alias("cover"), F.col("rawCount").alias("n"),
        F.when(~is_leaf & by_set, F.col("split.leftCategoriesOrThreshold")).alias("categories")).orderBy("tree", "node")
    trees = _trees(rows.toPandas())
    weights = getattr(model, "treeWeights", None)
    if weights and len(set(weights)) > 1:
        trees = tuple(replace(t, value=t.value * w) for t, w in zip(trees, weights))
        return Ensemble(trees)
    averaged = "Forest" in type(model).__name__
    return Ensemble(trees, mean=averaged, rate=1.0 if averaged or not weights else weights[0])
