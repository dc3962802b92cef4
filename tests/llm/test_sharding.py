"""Balance, groups and slots."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest

from riskgrid.llm import sharding as S
from tests.llm.samples import no_documents, odd_documents


def checked(df, shards=S.SHARDS):
    rows = S.assign(df, "doc_id", "text", shards).toPandas()
    assert len(rows) == df.count()
    assert rows.shard.between(0, shards - 1).all()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    return rows


def test_shards_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = checked(df)
    docs = df.toPandas().set_index("doc_id")
    own = rows.set_index("doc_id")
    for i, text in docs.text.items():
        assert own.loc[i, "size"] == len(text.encode()) + 16 and own.loc[i, "text_crc32"] == crc32(text.encode())
    for column in ("size", "tokens"):
        totals = own.groupby("shard")[column].sum()
        assert totals.max() / totals.mean() < 1.02 and totals.min() / totals.mean() > 0.98
    counts = own.groupby("shard").size()
    assert counts.max() - counts.min() < 0.1 * counts.mean()
    # Groups of equal texts that aren't a notable part of a shard stay together.
    merged = docs.assign(shard=own.shard, size=own["size"])
    groups = merged.groupby("text").agg(n=("shard", "nunique"), size=("size", "sum"), rows=("shard", "size"))
    part = merged["size"].sum() / (S.SHARDS * S.FINENESS)
    assert (groups[(groups["size"] < part) & (groups.rows < 2)].n == 1).all()
    assert (groups.n <= np.maximum(1, groups["rows"])).all()
    again = checked(df.repartition(7)).set_index("doc_id")
    assert (again.shard == own.shard[again.index]).all() and (again.slot == own.slot[again.index]).all()


def test_hot_group_is_dealt(spark):
    rows = [(i, "the same text in a third of all rows") for i in range(1000)]
    rows += [(1000 + i, f"text number {i} " * (i % 7 + 1)) for i in range(2000)]
    out = checked(spark.createDataFrame(rows, "doc_id bigint, text string"))
    totals = out.groupby("shard")["size"].sum()
    assert totals.max() / totals.mean() < 1.05
    counts = out.groupby("shard").size()
    assert counts.max() / counts.mean() < 1.1


@pytest.mark.parametrize("doc_id", [None, 7])
def test_hot_group_without_own_ids_is_dealt(spark, doc_id):
    """A third of the rows share one text and a null id, or one id."""
    rows = [(doc_id, "the same text in a third of all rows")] * 2000
    rows += [(10_000 + i, f"text number {i} " * (i % 7 + 1)) for i in range(4000)]
    out = checked(spark.createDataFrame(rows, "doc_id bigint, text string"))
    totals = out.groupby("shard")["size"].sum()
    assert totals.max() / totals.mean() < 1.02 and totals.min() / totals.mean() > 0.98


def test_pack_goes_where_the_dot_product_is_highest():
    sizes = np.array([[4, 1, 1], [1, 4, 1], [1, 1, 4], [2, 2, 2]], dtype=float)
    place = S.pack(sizes, 2)
    residual = np.full((2, 3), 0.5)
    share = sizes / sizes.sum(axis=0)
    for i in np.lexsort((np.arange(4), -share.sum(axis=1))):
        assert place[i] == np.argmax(residual @ share[i])
        residual[place[i]] -= share[i]
    assert len(S.pack(np.empty((0, 3)), 3)) == 0
    assert S.pack(np.zeros((2, 3)), 3).tolist() == [0, 0]


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_documents(spark, make):
    df = make(spark)
    rows = checked(df, 3)
    null = rows[rows["size"] == 16]
    assert (null.text_crc32 == 0).all() and (null.tokens == 0).all()
