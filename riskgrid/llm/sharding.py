"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.operators.sizes import lookup_join
from riskgrid.sources.workdir import materialize

SHARDS = 40
# A group that has at least this part of a shard's share of bytes, tokens or rows is placed by itself, and
# dealt in pieces of about that part; all smaller groups are placed in bundles, this many for each shard.
FINENESS = 64
ROW_BYTES = 16
# Rows of a shard are numbered within so many ranges.
RANGES = 256
LAW = "bytes"
DIMENSIONS = ("size", "tokens", "rows")


def pack(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of every item (rows of ``sizes``, one column per dimension).

    Items are taken by falling share of the total, and each goes where the dot product with the residual
    capacity is highest; ties go to the first bin. Capacity is an equal share of the total.
    """
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1)
    residual = np.full((bins, sizes.shape[1]), 1 / bins)
    place = np.empty(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.sum(axis=1))):
        place[i] = np.argmax(residual @ share[i])
        residual[place[i]] -= share[i]
    return place


def _measures() -> list[Column]:
    return [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def assign(documents: DataFrame, doc_id: str, text: str, shards: int = SHARDS,
           fineness: int = FINENESS) -> DataFrame:
    """Shard and slot of every row: ``doc_id``, ``size``, ``text_crc32``, ``tokens``, ``shard``, ``slot``.

    Size is the text's UTF-8 bytes plus 16, tokens are its words. Equal texts form a group and share a
    shard, unless the group alone is a notable part (1 / fineness) of a shard: such a group is dealt in pieces
    of that part by a hash of the id, or, where rows of one id (null ids too) are that many, by the row's number in
    the written table. There are at most 3 x shards x fineness such groups; all others are
    bundled by a hash of the text into at most shards x fineness bundles, so the packing itself, on the driver,
    handles a number of items that does not grow with the table. Slots number a shard's rows from 0 without
    gaps, in the order of a hash of the text, id and checksum; equal rows are interchangeable.

    Null texts are a group of their own with no bytes; null ids are kept; repeated rows each get a slot.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(documents.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(content) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).cast("bigint").alias("text_crc32"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")).alias("group"),
        F.xxhash64(F.col(doc_id), F.col(doc_id).isNull()).alias("id_hash"),
        F.monotonically_increasing_id().alias("number")), "sizes")
    groups = materialize(rows.groupBy("group").agg(*_measures()), "groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    bundles = shards * fineness
    part = {d: (total[d] or 0) / bundles for d in DIMENSIONS}
    is_large = (F.col("size") >= part["size"]) | (F.col("rows") >= part["rows"])
    if total["tokens"]:
        is_large = is_large | (F.col("tokens") >= part["tokens"])
    pieces = F.greatest(*[F.floor(F.col(d) / max(part[d], 1.0)) for d in DIMENSIONS])
    # A group of one row can't be dealt; a small one stays whole.
    large = groups.where(is_large).select("group", *DIMENSIONS, F.greatest(F.lit(1), F.least(
        pieces, F.col("rows"))).cast("int").alias("pieces"))
    # Rows that share id and text and are a notable part of a shard: as many keys as there can be large groups, at most.
    same = rows.groupBy("group", "id_hash").agg(F.count("*").alias("rows"), F.sum("size").alias("size"),
                                                F.sum("tokens").alias("tokens")).where(is_large & (F.col("rows") > 1))
    rows = lookup_join(rows, same.select("group", "id_hash", F.lit(True).alias("same")), ["group", "id_hash"],
                       max_rows=3 * bundles)
    rows = rows.withColumn("deal", F.when(F.col("same"), F.xxhash64("number")).otherwise(F.col("id_hash")))
    piece = F.pmod(F.xxhash64("deal"), F.col("pieces")).cast("int")
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("int")
    keyed = lookup_join(rows, large.select("group", "pieces"), ["group"], max_rows=3 * bundles).select(
        "doc_id", "size", "text_crc32", "tokens", "group", "deal",
        F.when(F.col("pieces").isNull(), F.lit("")).otherwise(F.col("group")).alias("alone"),
        F.when(F.col("pieces").isNull(), bundle).otherwise(piece).alias("item"))
    # At most 4 items for each of the shards' parts and dimensions.
    items = keyed.groupBy("alone", "item").agg(*_measures()).orderBy("alone", "item").collect()
    place = pack(np.array([[r[d] for d in DIMENSIONS] for r in items], dtype=float).reshape(-1, 3), shards)
    spark = documents.sparkSession
    places = spark.createDataFrame([(r["alone"], r["item"], int(p)) for r, p in zip(items, place)],
                                   "alone string, item int, shard int")
    dealt = keyed.join(F.broadcast(places), ["alone", "item"]).withColumn(
        "range", F.pmod(F.xxhash64("group", "deal"), F.lit(RANGES)))
    order = Window.partitionBy("shard", "range").orderBy("group", "doc_id")
    dealt = materialize(dealt.withColumn("place", F.row_number().over(order)).drop("alone", "item", "group", "deal"), "dealt")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x ranges rows.
    offsets = dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return dealt.join(F.broadcast(offsets), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "tokens", "shard", (F.col("place") - 1 + F.col("offset")).alias("slot"))
