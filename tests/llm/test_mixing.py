"""Raking and calibrated samples. The query itself is compared with SQL in test_sql."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskgrid.llm import mixing as M
from tests.llm.samples import no_documents, odd_documents, python_nodes

FOLDER = "/root/testdata/sf0.1"


def test_rake_reaches_given_margins(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 50), ("b", "x", 30), ("b", "y", 5), (None, "x", 5)],
                                  "s string, l string, tokens bigint")
    targets = {"s": spark.createDataFrame([("a", 0.5), ("b", 0.3), (None, 0.2), ("none", 0.9)], "s string, share double"),
               "l": spark.createDataFrame([("x", 0.6), ("y", 0.4)], "l string, share double")}
    rows = M.rake(cells, ["s", "l"], targets).collect()
    total = {}
    for r in rows:
        for key in (r["s"], r["l"]):
            total[key] = total.get(key, 0) + r["weight"] / 100
    assert all(abs(total[k] - v) < 1e-9 for k, v in {"a": 0.5, "b": 0.3, None: 0.2, "x": 0.6, "y": 0.4}.items())
    # Raking keeps the cross ratios of the original table.
    w = {(r["s"], r["l"]): r["weight"] for r in rows}
    assert abs(w["a", "x"] * w["b", "y"] / (w["a", "y"] * w["b", "x"]) - 10 * 5 / (50 * 30)) < 1e-9


def test_sample_has_target_margins(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    powers = {"source": 0.5, "lang": 0.5, "topic": 0.8}
    margins, tokens = M.document_margins(), M.token_weight(F.col("text"))
    rows = M.mix(docs, "doc_id", margins, tokens, powers=powers, keep=["doc_id"]).toPandas()
    assert len(rows) == docs.count() and not rows.duplicated("doc_id").any()
    assert rows.probability.max() == 1 and rows.probability.min() > 0
    for margin, power in powers.items():
        goal = rows.groupby(margin).tokens.sum() ** power
        goal /= goal.sum()
        expected = (rows.tokens * rows.probability).groupby(rows[margin]).sum()
        assert (expected / expected.sum() - goal).abs().max() < 1e-5
    sampled = rows[rows.sampled]
    assert abs(len(sampled) - rows.probability.sum()) < 5 * len(rows) ** 0.5
    again = M.mix(docs.repartition(5), "doc_id", margins, tokens, powers=powers, keep=["doc_id"]).toPandas()
    assert set(again[again.sampled].doc_id) == set(sampled.doc_id)


def test_values_without_a_target_are_never_sampled(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "s" + str(i % 2)) for i in range(20)],
                                 "doc_id bigint, text string, lang string, source string")
    only = {"source": spark.createDataFrame([("s0", 1.0)], "source string, share double")}
    rows = M.mix(docs, "doc_id", {"source": F.col("source")}, M.token_weight(F.col("text")), only, keep=["doc_id"]).collect()
    assert {r["doc_id"] % 2 for r in rows if r["sampled"]} == {0}
    assert {r["probability"] for r in rows} == {0.0, 1.0}


def test_odd_documents(spark):
    for df in (odd_documents(spark), no_documents(spark)):
        out = M.mix(df, "doc_id", M.document_margins(), M.token_weight(F.col("text")), powers={}, keep=["doc_id"])
        rows = out.collect()
        assert len(rows) == df.count()
        # Powers of 1 keep the shares as they are.
        assert all(r["probability"] == 1 and r["sampled"] for r in rows)
        assert python_nodes(out) == []


def test_rows_without_own_ids_are_drawn_each(spark):
    """Null ids, one repeated id and wholly repeated rows are each sampled at their cell's probability."""
    rows = [(None, f"text {i}", "en", "a") for i in range(1500)] + [(5, f"other {i}", "en", "a") for i in range(1500)]
    rows += [(None, "one text", "en", "a")] * 1500 + [(9, "one text", "en", "a")] * 1500
    rows += [(10 + i, "few", "fr", "b") for i in range(500)]
    docs = spark.createDataFrame([(*r, 1) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    powers = {"source": 0.5, "lang": 0.5, "topic": 1.0}

    def sample():
        out = M.mix(docs, "doc_id", M.document_margins(), M.token_weight(F.col("text")), powers=powers,
                    keep=["doc_id", "text"], content=F.col("text"))
        assert python_nodes(out) == []
        return out.toPandas()

    got = sample()
    p = got[got.source == "a"].probability.iloc[0]
    assert len(got) == len(rows) and 0.2 < p < 0.8
    own = got[got.source == "a"]
    kinds = [own.doc_id.isna() & own.text.str.startswith("text"), own.doc_id == 5, own.doc_id.isna() & (own.text == "one text"),
             own.doc_id == 9]
    for kind in kinds:
        assert kind.sum() == 1500 and abs(own[kind].sampled.mean() - p) < 5 * (p * (1 - p) / 1500) ** 0.5
    again = sample()
    counts = lambda x: x[x.sampled].fillna(-1).groupby(["doc_id", "text"]).size().to_dict()
    assert counts(again) == counts(got)


def test_margins_out_of_reach_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "s string, l string, tokens bigint")
    targets = {"s": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "s string, share double"),
               "l": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "l string, share double")}
    with pytest.warns(UserWarning, match="off its target"):
        M.rake(cells, ["s", "l"], targets, rounds=3)
    with pytest.raises(ValueError, match="off its target"):
        M.rake(cells, ["s", "l"], targets, rounds=3, strict=True)


def test_topics_and_weights(spark):
    texts = ["token = 5", "a | b | c", "A!! B!!", "### x", "plain words here", None, "", " ", "a\tb\x0bc"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        M.topic_of(F.col("t")), M.token_weight(F.col("t"))).collect()
    assert [r[0] for r in got] == ["credentials", "table", "shout", "symbols"] + ["prose"] * 5
    assert [r[1] for r in got] == [4, 6, 3, 3, 4, 1, 1, 1, 4]
