"""Queries with SQL equal DuckDB, and all queries are registered."""

from __future__ import annotations

import pytest

from riskgrid.llm.queries import all_queries, all_sql
from workload.verify import connect, difference


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(all_sql()))
def test_sql(spark, name, scale):
    folder = f"/root/testdata/{scale}"
    got = all_queries()[name](spark, folder).toPandas()
    want = connect(folder).execute(all_sql()[name]).df()
    for c in want.columns:
        if str(want[c].dtype) == "Int64":
            want[c] = want[c].astype("float64")
    assert difference(got, want) is None


def test_registered():
    from __spark_entry__ import oracle_sql, queries
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in queries()}
    assert "pipeline" in queries()
    assert set(all_sql()) <= set(oracle_sql())


def test_contract_columns(spark):
    folder = "/root/testdata/sf0.001"
    wanted = {
        "op2_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op4_simhash_groups": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op6_language_spans": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op9_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint",
                             "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
        "op10_balanced_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
                                 "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op11_ranked_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
        "op12_packed_sequences": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
                                  "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op13_repaired_conversations": {
            "conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
            "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}}
    for name, columns in wanted.items():
        types = dict(all_queries()[name](spark, folder).dtypes)
        assert columns.items() <= types.items(), name
