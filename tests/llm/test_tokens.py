"""Token counts against the library, and the digest cache."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskgrid.llm import token_counts
from tests.llm.samples import LONG, no_documents, odd_documents

FILE = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["a<|endoftext|>b", "a <|endoftext|> b", "x  y   z", "don't we'll I'm", " lead", "trail ", "tab\tnew\nline  \n x",
          "é è ê", "日本語 と 中文 text", "12 34 a5 b 6", "  nbsp em a", "a​ b", "!! ?? a ... b", "𝒳 y 😀 z",
          "ſ K Å ﬁ x", "a\x1c b", "end. Next", "(a b)", "a'S b", "ͅa b"]


def library(text):
    return len(Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False))


def counts(spark, df, cache, file=FILE):
    return token_counts.count_tokens(df, "text", ["doc_id"], file, cache)


def test_counts_equal_the_library(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    rows = list(docs.itertuples(index=False, name=None)) + [(-i - 1, t) for i, t in enumerate(TRICKY)]
    got = counts(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "c")).collect()
    want = {i: (len(t.encode()), library(t)) for i, t in rows}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want


def test_memo_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 3)
    import pandas as pd
    lengths = token_counts.encoded_lengths(FILE).func
    texts = pd.Series([*TRICKY, "one two three four five six seven one two"])
    assert [list(x) for x in lengths(iter([texts]))] == [[library(x) for x in texts]]


def test_cache_serves_known_contents(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "doc_id bigint, text string"
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], schema)
    assert {tuple(r) for r in counts(spark, first, path).collect()} == {(1, 3, 2), (2, 3, 2), (3, 0, 0), (4, 0, 0)}
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    # A wrong count in the cache shows up, so known contents are not encoded again; new ones are appended.
    version = token_counts.tokenizer_digest(FILE)
    (stored.limit(0).union(spark.sql(f"SELECT '{version}', unhex(sha2('marked', 256)), 99L"))
     .write.mode("append").parquet(path))
    again = spark.createDataFrame([(1, "a b"), (5, "marked"), (6, "new text")], schema)
    got = {r["doc_id"]: r["n_tokens"] for r in counts(spark, again, path).collect()}
    assert got == {1: 2, 5: 99, 6: library("new text")}
    assert spark.read.parquet(path).count() == 4
    # Another tokenizer has counts of its own.
    other = public_tokenizers.path("word_bpe_49k.json")
    want = len(Tokenizer.from_file(other).encode("marked", add_special_tokens=False))
    got = {r["doc_id"]: r["n_tokens"] for r in counts(spark, again, path, other).collect()}
    assert got[5] == want


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_documents(spark, tmp_path, make):
    df = make(spark)
    want = sorted((r["doc_id"] or 0, library(r["text"])) for r in df.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in counts(spark, df, str(tmp_path / "c")).collect()) == want
    assert len(LONG) > 100_000
