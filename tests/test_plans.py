"""Physical plans: pruned scans, no cross joins, one shuffle per key."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from riskgrid.functions import row_hash
from riskgrid.operators import keys, split
from riskgrid.plans import case_generation
from workload import all_queries
from workload import tables as t

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables beyond the broadcast threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cases_total", "catalytic_cases", "cases_by_region", "group_split", "raster_index",
                                  "align_grid", "coord_match_check", "grid_cross_join", "scale_to_control_total",
                                  "foi_mapping_vs_posterior", "permute_column"])
def test_no_cross_joins_or_row_udfs(no_broadcast, name):
    text = plan(all_queries()[name](no_broadcast, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(all_queries()["tail_share"](spark, SF))
    line = next(l for l in text.splitlines() if "l_discount" in l and "FileScan" in l)
    assert re.search(r"FileScan parquet \[l_orderkey#\d+L?,l_discount#\d+\]", line)
    filtered = plan(all_queries()["row_select"](spark, SF))
    assert "PushedFilters: [In(n_nationkey" in filtered


def test_pixel_tables_join_on_one_shuffle(no_broadcast):
    inputs = t.case_inputs(no_broadcast, SF)
    plain = no_broadcast.range(10).select(
        (F.col("id") * 5.0).alias("x"), (F.col("id") * 0.0).alias("y"), F.lit(0.1).alias("foi"))
    joined = keys.attach_all_by_pixel(plain, [(inputs.population, ["pop"]), (inputs.regions, ["region_id"])])
    text = plan(joined)
    # Three pixel tables, three shuffles by pixel; the intermediate result is not shuffled again.
    assert len(re.findall(r"Exchange hashpartitioning\(kx", text)) == 3


def test_samples_are_a_filter(spark):
    df = t.pixels(spark, SF, "f4").select("pixel_id", "f4")
    assert "Exchange" not in plan(split.kfold_assign(df, ["pixel_id"], 5))
    assert "Exchange" not in plan(df.where(row_hash(["pixel_id"], 1) <= "8"))


def test_totals_need_no_row_per_age(spark):
    text = plan(case_generation.generate_cases(t.case_inputs(spark, SF)))
    assert "Generate" not in text and text.count("HashAggregate") == 2  # the averages per order only


def test_both_case_tables_equal_the_single_ones(spark):
    inputs = t.case_inputs(spark, SF)
    ages, totals = case_generation.generate_cases_both(inputs)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for got, want in ((ages, case_generation.generate_cases_by_age(inputs)), (totals, case_generation.generate_cases(inputs))):
        assert got.columns == want.columns
        assert [r[:2] for r in rows(got)] == [r[:2] for r in rows(want)]
        assert abs(got.agg({"cases": "sum"}).first()[0] - want.agg({"cases": "sum"}).first()[0]) < 1e-6
