"""Exact top-k search against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from riskgrid.llm import hamming


def brute(rows, queries, k):
    want = set()
    for q, c in set(queries):
        if q is None or c is None:
            continue
        near = sorted({((c ^ d) & (2 ** 64 - 1)).bit_count() * 10 ** 9 + i for i, d in rows
                       if i is not None and d is not None and i != q})[:k]
        want |= {(q, x % 10 ** 9, x // 10 ** 9, n + 1) for n, x in enumerate(near)}
    return want


def result(spark, rows, queries, k, bits=None):
    schema = "id bigint, code bigint"
    got = hamming.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), k, bits)
    assert got.columns == ["query_id", "neighbor_id", "distance", "rank"]
    return {tuple(r) for r in got.collect()}


@pytest.mark.parametrize("bits", [8, 16])
def test_equals_all_distances(spark, bits):
    random = np.random.default_rng(1)
    far = random.integers(-2 ** 63, 2 ** 63, 300)
    # Clusters of near and of equal codes, so that there are ties at every distance.
    near = [int(c) ^ (1 << int(b)) for c in far[:20] for b in random.integers(0, 63, 8)]
    codes = [int(x) for x in far] + near + [int(far[0])] * 60
    rows = list(enumerate(codes))
    queries = rows[::17] + [(5, codes[5])]
    assert result(spark, rows, queries, 7, bits) == brute(rows, queries, 7)


def test_odd_rows(spark):
    rows = [(1, 5), (1, 5), (2, 5), (3, None), (None, 9), (4, -1), (5, 0)]
    got = result(spark, rows, [(1, 5), (3, None), (None, 9), (9, -1)], 10)
    assert got == brute(rows, [(1, 5), (9, -1)], 10)
    assert result(spark, [], [(1, 5)], 3) == set()
    assert result(spark, rows, [], 3) == set()


def test_sign_code(spark):
    from pyspark.sql import functions as F
    vectors = [[1.0] * 64, [-1.0] * 64, [1.0] + [0.0] * 63, [1.0], None, [None] * 63 + [2.0]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vectors], "v array<float>")
           .select(hamming.sign_code(F.col("v"))).collect()]
    assert got == [-1, 0, 1, None, None, -2 ** 63]


def test_segment_length():
    assert [hamming.segment_bits_for(n) for n in (0, 2 ** 15, 2 ** 16, 2 ** 40)] == [8, 8, 16, 32]


def test_probes_are_not_broadcast(spark, monkeypatch):
    plans = []
    written = hamming.materialize

    def recorded(df, name):
        out = written(df, name)
        if name == "best":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(hamming, "materialize", recorded)
    random = np.random.default_rng(2)
    rows = [(i, int(c)) for i, c in enumerate(random.integers(-2 ** 63, 2 ** 63, 200))]
    assert result(spark, rows, rows[:5], 3) == brute(rows, rows[:5], 3)
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_segments_of_a_round_follow_the_bound():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"query_id": [1, 2], "query_code": [0, 0],
                                        "bound": pa.array([17, 64], type=pa.int32())})
    segments = {1: set(), 2: set()}
    for found in hamming._probes(8, 2)([batch]):
        for row in found.to_pylist():
            for q in np.frombuffer(row["query_ids"], dtype=np.int64):
                segments[int(q)].add(row["segment"])
    assert segments == {1: {0, 1}, 2: set(range(8))}
