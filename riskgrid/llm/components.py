"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.sources.workdir import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
                                                    F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``links`` (a, b).

    Alternates two star operations until nothing changes: every node hands its larger neighbours, then
    its smaller ones, to its smallest neighbour. The number of links never grows, the number of rounds is
    logarithmic in the length of chains, and each round is written to the shared folder. Minima are
    pre-aggregated, so a node with very many neighbours costs one row per task; they are written before they are
    joined, so that a join is between two plain shuffles and the links of such a node can be split over tasks.
    Links of a node to itself and null ends are ignored.
    """
    star = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .dropna().where(F.col("a") > F.col("b")).distinct(), "links")
    before = _state(star)
    while before[0]:
        both = star.union(star.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")),
                            "least")
        large = materialize(both.where(F.col("b") > F.col("a")).join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        small = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        star = materialize(
            large.join(small, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small).distinct(), "links")
        after = _state(star)
        if after == before:
            break
        before = after
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
