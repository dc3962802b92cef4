"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskgrid.sources.workdir import materialize

BITS = 64
# Codes that are packed together before they are dealt to buckets, probes likewise.
PACK_ROWS = 131_072
PACK_PROBES = 1_000_000
# Distances that are computed at once.
CELLS = 2_000_000


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where element i is positive. Null unless the vector has exactly ``bits`` elements."""
    bit = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(
        F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
        .otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(vector) == bits, F.aggregate(
        bit, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


def segment_bits_for(rows: int) -> int:
    """The segment length of multi-index hashing: the largest divisor of the code with 2^length <= rows."""
    return max(b for b in (8, 16, 32) if b == 8 or 2 ** b <= rows)


@lru_cache(maxsize=64)
def _masks(bits: int, radius: int) -> np.ndarray:
    """All bit patterns of a segment with ``radius`` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], dtype=np.uint64)


def _segments(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes as (rows, segments)."""
    shifts = np.arange(0, BITS, bits, dtype=np.uint64)
    return (codes[:, None] >> shifts) & np.uint64(2 ** bits - 1)


def _packed(segment: np.ndarray, value: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """One tuple per (segment, value): both, then the columns' elements as bytes."""
    order = np.lexsort((value, segment))
    segment, value, columns = segment[order], value[order], [c[order] for c in columns]
    new = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (value[1:] != value[:-1])])
    for start, end in zip(new, np.r_[new[1:], len(segment)]):
        yield (int(segment[start]), int(value[start]), *(c[start:end].tobytes() for c in columns))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _buckets(bits: int):
    names = ["segment", "value", "ids", "codes"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(at, PACK_ROWS)
                ids, codes = _column(part, "id"), _column(part, "code")
                values = _segments(codes.view(np.uint64), bits)
                m = values.shape[1]
                rows = list(_packed(np.tile(np.arange(m), len(ids)), values.ravel(),
                                    np.repeat(ids, m), np.repeat(codes, m)))
                if rows:
                    yield _batch(rows, names)
    return pack


def _probes(bits: int, radius: int):
    names = ["segment", "value", "query_ids", "query_codes", "bounds"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(bits, radius)
        m = BITS // bits
        step = max(1, PACK_PROBES // (m * len(masks)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, codes, bounds = (_column(part, x) for x in ("query_id", "query_code", "bound"))
                # Rounds before have verified what is within m * radius - 1; for one bit more a segment more is needed.
                row, segment = np.nonzero(np.arange(m) <= bounds[:, None].astype(np.int64) - m * radius)
                values = _segments(codes.view(np.uint64), bits)[row, segment][:, None] ^ masks
                rows = list(_packed(np.repeat(segment, len(masks)), values.ravel(),
                                    *(np.repeat(c[row], len(masks)) for c in (ids, codes, bounds.astype(np.int64)))))
                if rows:
                    yield _batch(rows, names)
    return pack


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """Rows (query, query code, id, distance), each once, at most ``k`` per query by distance and id."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    starts = np.flatnonzero(new)
    place = np.arange(len(rows)) - starts[np.cumsum(new) - 1]
    return rows[place < k]


def _verify(k: int):
    names = ["query_id", "query_code", "id", "distance"]

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            held = 0
            columns = [batch.column(x).to_pylist() for x in ("ids", "codes", "query_ids", "query_codes", "bounds")]
            for row in zip(*columns):
                ids, codes, query_ids, query_codes, bounds = (np.frombuffer(x, dtype=np.int64) for x in row)
                step = max(1, CELLS // len(ids))
                for at in range(0, len(query_ids), step):
                    q = slice(at, at + step)
                    d = np.bitwise_count((query_codes[q, None] ^ codes).view(np.uint64))
                    hit, row_of = np.nonzero((d <= bounds[q, None]) & (ids != query_ids[q, None]))
                    if len(hit):
                        got = np.stack([query_ids[q][hit], query_codes[q][hit], ids[row_of],
                                        d[hit, row_of].astype(np.int64)], axis=1)
                        found.append(_best([got], k))
                        held += len(found[-1])
                        if held > CELLS // 8:
                            found = [_best(found, k)]
                            held = 0
            if found:
                rows = _best(found, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=names)
    return distances


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segment_bits: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to every query by Hamming distance, ties by id.

    ``rows`` and ``queries`` have ``id`` and ``code`` (64 bits as a bigint). Returns ``query_id``,
    ``neighbor_id``, ``distance`` and ``rank`` from 1. A query's own id is not its neighbour.

    Codes are cut into m segments, with one hash index per segment. Round r probes every segment at
    exactly r flipped bits; after it, every code within m * (r + 1) - 1 bits has been verified. A query
    is finished once its k-th verified distance lies within that, and only unfinished queries go on, with
    that distance as a bound. With a bound of m * r + a the first a + 1 segments are enough in round r: a code that
    differs by more than r bits in each of them and by r or more in the others is farther away. Buckets and probes
    are shuffled and meet as packed blocks, so a bucket that holds a large share of the rows is many rows of the join, not
    one group.

    Of rows with the same code only the k + 1 smallest ids can be among k neighbours, so only they are
    indexed. Rows and queries with a null id or code are left out. Repeated rows count once; an id with
    several codes counts once for each. With fewer than k other rows, all are returned.
    """
    rows = rows.select(F.col("id").cast("bigint"), F.col("code").cast("bigint")).dropna()
    queries = queries.select(F.col("id").cast("bigint").alias("query_id"),
                             F.col("code").cast("bigint").alias("query_code")).dropna().distinct()
    by_code = Window.partitionBy("code").orderBy("id")
    index = materialize(rows.distinct().withColumn("place", F.row_number().over(by_code))
                        .where(F.col("place") <= k + 1).select("id", "code"), "codes")
    bits = segment_bits or segment_bits_for(index.count())
    m = BITS // bits
    buckets = materialize(index.mapInArrow(_buckets(bits), "segment int, value bigint, ids binary, codes binary"),
                          "buckets")
    active = materialize(queries.withColumn("bound", F.lit(BITS)), "queries")
    best = None
    for radius in range(bits + 1):
        probes = active.mapInArrow(_probes(bits, radius), "segment int, value bigint, query_ids binary, "
                                                          "query_codes binary, bounds binary")
        # Probes outgrow the queries they are estimated by a thousandfold: by that size they would be broadcast.
        found = (buckets.join(probes.hint("merge"), ["segment", "value"])
                 .mapInArrow(_verify(k), "query_id bigint, query_code bigint, id bigint, distance bigint"))
        if best is not None:
            found = found.unionByName(best)
        by_query = Window.partitionBy("query_id", "query_code").orderBy("distance", "id")
        best = materialize(found.distinct().withColumn("rank", F.row_number().over(by_query))
                           .where(F.col("rank") <= k).drop("rank"), "best")
        reached = best.groupBy("query_id", "query_code").agg(
            F.count("*").alias("n"), F.max("distance").alias("kth"))
        covered = m * (radius + 1) - 1
        active = materialize(
            active.drop("bound").join(reached, ["query_id", "query_code"], "left")
            .where(F.coalesce(F.col("n"), F.lit(0)) < k if covered >= BITS else
                   (F.coalesce(F.col("n"), F.lit(0)) < k) | (F.col("kth") > covered))
            .select("query_id", "query_code",
                    F.when(F.col("n") == k, F.col("kth")).otherwise(BITS).cast("int").alias("bound")), "queries")
        if covered >= BITS or active.isEmpty():
            break
    by_query = Window.partitionBy("query_id", "query_code").orderBy("distance", "id")
    return best.select("query_id", F.col("id").alias("neighbor_id"), F.col("distance").cast("int").alias("distance"),
                       F.row_number().over(by_query).alias("rank"))
