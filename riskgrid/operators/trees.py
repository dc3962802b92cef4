"""What the tree operators share: node tables, leaf numbers, per-tree outputs, errors of prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.operators.packed import Packed, as_array, matrix, numbers, pack, tree_outputs

LEAF = "_leaf"


def node_table(spark: SparkSession, model) -> DataFrame:
    """Nodes of a tree model: ``tree, node, prediction, n, cover, gain, feature, is_leaf``."""
    return pack(spark, model).nodes(spark).select(
        "tree", "node", F.col("value").alias("prediction"), "n", "cover", "gain", "feature",
        (F.col("left") < 0).alias("is_leaf"))


def prediction_name(model) -> str:
    return model.getPredictionCol() if hasattr(model, "getPredictionCol") else "yhat"


def leaf_numbers(model, df: DataFrame) -> DataFrame:
    """Add ``_leaf``, the leaf a row falls into in each tree, as an array, and the prediction unless
    the table has it already."""
    packed = pack(df.sparkSession, model)
    name = prediction_name(model)
    scored = df if name in df.columns else packed.transform(df, name)
    return packed.leaf_numbers(scored, LEAF)


def tree_predictions(model, df: DataFrame, name: str = "tree_predictions") -> DataFrame:
    """Add the predictions of the single trees as an array, and the prediction unless the table has it already."""
    packed = pack(df.sparkSession, model)
    known = prediction_name(model)
    scored = df if known in df.columns else packed.transform(df, known)
    return packed.outputs(scored, name)


def prefix_sums(model, df: DataFrame, label: str, sizes: Sequence[int], by: str,
                features: str = "features") -> DataFrame:
    """Sums for the error of the first s trees, for all sizes at once: ``by, trees, n, sy, syy, sse``.

    Each task adds up its rows; nothing per row leaves it.
    """
    shipped = df.sparkSession.sparkContext.broadcast(Packed(pack(df.sparkSession, model).trees))
    positions = np.asarray(sizes) - 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = tree_outputs(shipped.value, matrix(batch.column("_x")))
            means = np.cumsum(trees, axis=1)[:, positions] / (positions + 1)
            y = numbers(batch.column(label)).astype(float)
            sides = batch.column(by).dictionary_encode()
            place = sides.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for number, key in enumerate(sides.dictionary.to_pylist()):
                at = np.flatnonzero(place == number)
                part = np.vstack([np.full(len(positions), len(at)), np.full(len(positions), y[at].sum()),
                                  np.full(len(positions), (y[at] ** 2).sum()),
                                  ((y[at, None] - means[at]) ** 2).sum(axis=0)])
                sums[key] = sums.get(key, 0) + part
        for key, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(positions)), pa.array(positions + 1, pa.int32()), pa.array(total[0].astype(np.int64)),
                 *(pa.array(total[i]) for i in (1, 2, 3))], names=[by, "trees", "n", "sy", "syy", "sse"])

    kind = df.schema[by].dataType.simpleString()
    return (df.select(by, label, as_array(df, features).alias("_x"))
            .mapInArrow(partial, f"{by} {kind}, trees INT, n BIGINT, sy DOUBLE, syy DOUBLE, sse DOUBLE")
            .groupBy(by, "trees").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "sse")]))


def r2_of_sums() -> Column:
    """R2 from the sums of :func:`prefix_sums`."""
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return 1 - F.col("sse") / F.nullif(spread, F.lit(0.0))
