"""Packing: ids equal the library's, pieces and sequences keep the contract, few sequences."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskgrid.llm import packing
from riskgrid.llm.queries import all_queries
from tests.llm.samples import LONG, no_documents, odd_documents
from tests.llm.test_tokens import TRICKY

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "'s", "'re", " ", "  ", "\n", "\t", "a", "B", "é", "×", "ñ", "1", "23", ".", "--", "<|endoftext|>", "<|endo", "中",
         "😀", "x", "don't", "\x00", "\r\n", "ſ", " ", "́", "²"]


def library(texts, file=FILE):
    coder = Tokenizer.from_file(file)
    return [e.ids for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("memo", [100, 400_000])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(monkeypatch, memo, name):
    monkeypatch.setattr(packing, "MEMO_ENTRIES", memo)
    file = public_tokenizers.path(name)
    coder = packing.Encoder(file)
    rng = random.Random(3)
    texts = ["", *TRICKY, *("".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)), ""]
    for _ in range(2):
        ids, counts = coder(pa.array(texts))
        assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == library(texts, file)


def test_merges_need_the_order_of_ids():
    spec = {"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "bb": 2}, "merges": ["a b", "b b"]}}
    assert packing._ranks(spec) is None
    spec["model"]["merges"].reverse()
    assert packing._ranks(spec) == {b"a": 0, b"b": 1, b"ab": 3, b"bb": 2}


def check(rows, texts, capacity=packing.CAPACITY):
    """Rows (doc, piece, start, length, crc or ids, sequence, offset) against the documents."""
    want = {}
    for doc, ids in zip(texts, library(texts.values())):
        ids = [*ids, 0]
        first = len(ids) - (math.ceil(len(ids) / capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, i] = (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), math.ceil(sum(r[3] for r in rows) / capacity)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = all_queries()["op12_packed_sequences"](spark, folder).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    used, least = check(rows, texts)
    assert used <= least + 1


@pytest.mark.parametrize("capacity", [7, 64])
def test_tree(spark, capacity):
    """Many leaves and a narrow tree: gapless, within the capacity, hardly more than best fit over all."""
    rng = random.Random(5)
    sizes = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i bigint, length bigint").repartition(40)
    rows = packing.pack(df, capacity=capacity, fan=3, leaf_items=25).collect()
    assert sorted((r["i"], r["length"]) for r in rows) == list(enumerate(sizes))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= capacity
    _, _, fills = packing.best_fit(np.array(sizes), capacity)
    assert len(bins) <= len(fills) * 1.06 + 2


def test_residuals_are_merged(spark):
    """Two small items a leaf: only the tree can bring them together (bins stay whole, so a few are not full)."""
    df = spark.createDataFrame([(i, 10) for i in range(64)], "i bigint, length bigint").repartition(32)
    assert 16 <= packing.pack(df, capacity=40, fan=2).select("sequence_id").distinct().count() <= 20


def test_items_over_half_are_not_gathered():
    fills = np.array([60] * 100 + [30, 64, 20, 63])
    up = packing._carried(fills, 64, 0, 4)
    assert sorted(fills[up].tolist()) == [20, 30, 60, 60, 60, 60, 63]


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 7, 3, 4, 10]), 10)
    assert fills.tolist() == [10, 10, 10] and bins[1] == bins[2] and bins[0] == bins[3]
    assert offsets.tolist() == [0, 0, 7, 6, 0]


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_documents(spark, make):
    df = make(spark)
    placed = packing.pack_documents(df, "text", ["doc_id"], FILE)
    rows = placed.collect()
    texts = [r["text"] for r in df.collect()]
    total = sum(len(x) + 1 for x in library(texts))
    assert sum(r["length"] for r in rows) == total
    assert sorted(r["doc_id"] or 0 for r in rows if r["piece"] == 0) == sorted(r["doc_id"] or 0 for r in df.collect())
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert len(LONG) > 100_000
    whole = packing.sequences(placed).collect()
    assert sum(r["n_tokens"] for r in whole) == total and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)


def test_sequences_hold_the_ids(spark):
    texts = {1: "one two three", 2: None, 3: "four " * 30}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    placed = packing.pack_documents(df, "text", ["doc_id"], FILE, capacity=16)
    rows = placed.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    used, least = check(rows, texts, 16)
    assert used == least
    parts = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in placed.collect()}
    for r in packing.sequences(placed).collect():
        assert bytes(r["ids"]) == b"".join(v for k, v in sorted(parts.items()) if k[0] == r["sequence_id"])


def test_refused(spark):
    df = spark.createDataFrame([(1, 41)], "i bigint, length bigint")
    with pytest.raises(Exception, match="must be from 1"):
        packing.pack(df, capacity=40).collect()
