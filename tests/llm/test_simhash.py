"""Fingerprints, anchors and components against plain Python."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from riskgrid.llm import components as C
from riskgrid.llm import simhash as S
from riskgrid.llm.components import components
from tests.llm.samples import Groups, no_documents, odd_documents

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def plain_roots(fingerprints, threshold):
    groups = Groups()
    for a, b in combinations(sorted(set(fingerprints)), 2):
        if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= threshold:
            groups.join(a, b)
    return {x: groups.find(x) for x in set(fingerprints)}


def roots(spark, fingerprints, **options):
    links = S.anchor_links(spark.createDataFrame([(x,) for x in set(fingerprints)], "bits bigint"), **options)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    return {x: found.get(x, x) for x in set(fingerprints)}


def test_fingerprints(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = [(-1, "A b\x0bC d E f"), (-2, "one"), (-3, " "), (-4, None), (-5, "É é A a A a A a")]
    df = df.union(spark.createDataFrame(extra, df.schema))
    for r in df.select("text", S.fingerprint_hex(S.fingerprint(F.col("text"))).alias("f")).collect():
        assert r["f"] == f"{plain(r['text']):016x}"


def clustered(seed):
    random = np.random.default_rng(seed)
    out = []
    for center in random.integers(0, 2 ** 64, 25, dtype=np.uint64):
        x = int(center)
        for _ in range(random.integers(1, 14)):
            out.append(signed(x))
            for b in random.choice(64, random.integers(1, 7), replace=False):
                x ^= 1 << int(b)
    return out


@pytest.mark.parametrize("options", [{}, {"threshold": 0}, {"threshold": 2}])
def test_components_equal_all_pairs(spark, options):
    fingerprints = clustered(3) + [0, 1, -1, signed(2 ** 63)]
    assert roots(spark, fingerprints, **options) == plain_roots(fingerprints, options.get("threshold", 4))


def roots_without_spark(fingerprints, threshold):
    """The two functions that run in tasks, with a plain sort between them."""
    columns = [pa.array(sorted(set(fingerprints)), pa.int64())]
    rows = []
    for dealt in S._replicate(threshold)([pa.RecordBatch.from_arrays(columns, names=["bits"])]):
        for r in dealt.to_pylist():
            rows += [(r["anchor"], 0, 0, r["homes"])] * bool(r["homes"]) + [(r["anchor"], 0, 1, r["members"])]
    rows.sort(key=lambda r: r[:3])
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at: at + 300]), kinds)],
                                          names=["anchor", "slice", "kind", "load"])
               for at in range(0, len(rows), 300)]
    groups = Groups()
    for found in S._compare(threshold)(batches):
        for r in found.to_pylist():
            groups.join(r["a"], r["b"])
    return {x: groups.find(x) for x in set(fingerprints)}


@pytest.mark.parametrize("few", [0, 32])
@pytest.mark.parametrize("threshold", [0, 2, 4, 6])
def test_words_of_the_second_block(monkeypatch, threshold, few):
    """Homes that are looked up by their words in the second block give the same components."""
    monkeypatch.setattr(S, "FEW_HOMES", few)
    monkeypatch.setattr(S, "MEMBERS_AT_ONCE", 50)
    monkeypatch.setattr(S, "REPLICATE_AT_ONCE", 100)
    monkeypatch.setattr(S, "CELLS", 40)
    fingerprints = clustered(4) + [signed(i << 24) for i in range(150)] + [0, -1, signed(2 ** 63)]
    assert roots_without_spark(fingerprints, threshold) == plain_roots(fingerprints, threshold)


def test_lookup_finds_all_pairs():
    """Of one anchor: the same pairs as comparing all members with all homes."""
    random = np.random.default_rng(11)
    base = random.integers(0, 2 ** 64, 300, dtype=np.uint64) & ~np.uint64((1 << 23) - 1)
    near = base.copy()
    for i in range(len(near)):
        for b in random.choice(64, random.integers(0, 6), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    homes = S._Homes(0, base.view(np.int64))
    every = {(m, h) for m, h in zip(*np.nonzero(np.bitwise_count(near[:, None] ^ homes.homes.view(np.uint64)) <= 4))}
    assert len(base) > S.FEW_HOMES and len(every) > 200
    found = [(m, h) for ms, hs in homes.near(near.view(np.int64), 4) for m, h in zip(ms, hs)]
    assert len(found) == len(set(found)) and set(found) == every


def test_slices_and_chains(spark, monkeypatch):
    """One anchor is home to many fingerprints, dealt over slices; and a chain of 40 links is one component."""
    monkeypatch.setattr(S, "SLICE", 50)
    high = [signed(i << 30) for i in range(400)]
    chain, x = [], 7 << 50
    for i in range(40):
        chain.append(signed(x))
        x ^= 0b1111 << (i % 15 * 4)
        x ^= 0 if i % 2 else 0
    fingerprints = high + chain
    assert roots(spark, fingerprints) == plain_roots(fingerprints, 4)


def test_every_pair_meets_at_the_home_anchor():
    random = np.random.default_rng(8)
    bits = random.integers(0, 2 ** 64, 40, dtype=np.uint64)
    flipped = bits.copy()
    for i in range(len(bits)):
        for b in random.choice(64, 4, replace=False):
            flipped[i] ^= np.uint64(1) << np.uint64(b)
    rows, anchors, home = S.anchors_of(bits, 4)
    assert sorted(rows[home].tolist()) == list(range(40))
    to_rows, to_anchors, _ = S.anchors_of(flipped, 4)
    sent = set(zip(to_rows.tolist(), to_anchors.tolist()))
    assert {(r, a) for r, a, h in zip(rows.tolist(), anchors.tolist(), home) if h} <= sent


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], signed(plain(r["text"]))) for r in df.select("doc_id", "text").collect()]
    root = plain_roots([f for _, f in rows], 4)
    least = {}
    for i, f in rows:
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r["doc_id"]: (r["bits"], r["component_id"]) for r in S.near_duplicates(df, "doc_id", "text").collect()}
    assert got == {i: (f, least[root[f]]) for i, f in rows}
    kept = S.one_per_group(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_odd_documents(spark):
    df = odd_documents(spark)
    got = S.near_duplicates(df, "doc_id", "text").collect()
    assert len(got) == df.count()
    zero = [r for r in got if r["bits"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    kept = S.one_per_group(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 9]
    empty = no_documents(spark)
    assert S.near_duplicates(empty, "doc_id", "text").count() == 0
    assert S.one_per_group(empty, "doc_id", "text").count() == 0


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(1, 1), (2, None), (None, None), (5, 4), (4, 5), (5, 6), (9, 8)], "a bigint, b bigint")
    assert {tuple(r) for r in components(links).collect()} == {(4, 4), (5, 4), (6, 4), (8, 8), (9, 8)}
    assert components(links.limit(0)).count() == 0


def test_one_giant_component(spark, monkeypatch):
    """100,000 nodes: the first one has half of all links, the others hang on earlier nodes; its links are split."""
    rng = np.random.default_rng(8)
    n = 100_000
    parent = np.where(np.arange(1, n) % 2 == 0, 0, (rng.random(n - 1) * np.arange(1, n)).astype(int))
    names = rng.permutation(n) + 7
    links = spark.createDataFrame(pd.DataFrame({"a": names[1:], "b": names[parent]}))
    plans, write = [], C.materialize

    def written(df, name):
        if name in ("large", "links"):
            counted = df.selectExpr("count(*)")
            counted.collect()
            plans.append(counted._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(C, "materialize", written)
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        found = components(links).collect()
    finally:
        for key in small:
            spark.conf.unset(key)
    assert len(found) == n and {r["root"] for r in found} == {7}
    assert any("skew=true" in x for x in plans)
