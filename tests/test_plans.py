"""Shapes of the physical plans that matter at scale."""

import contextlib
import io
import re

import pytest

from slotcast.operators import lists, schedule, shows
from slotcast.workload import QUERIES
from slotcast.workload.base import feat, slots


def plan_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize(
    "name", ["rolling_means", "prev_day_price", "prev_week_price_category", "lag_sales", "dup_times", "mean_sales_origin"]
)
def test_facts_are_not_shuffled_by_lookups(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # the small tables were stored before, so nothing is left to exchange by hash but calendar rows
    fact_scan = plan.split("parquet")[0]
    assert "hashpartitioning(category" not in fact_scan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["value_counts"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert sorted(schemas) == ["l_partkey:bigint", "p_partkey:bigint,p_name:string"]


def test_filters_reach_the_scan(spark, sf_dir):
    from slotcast.sources import bindings as B

    rows = B.airings(spark, sf_dir).where("category = 'view'").select("ts", "category")
    assert "EqualTo(event_type,view)" in plan_of(rows)


def test_top_per_group_is_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(lists.top_per_group(feat(spark, sf_dir), "hours", "small_c", "sales", 2))


def test_carry_is_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(shows.carried_slots(slots(spark, sf_dir), "category"))
    assert plan.count("WindowGroupLimit") >= 2


def test_slots_are_not_exchanged_after_their_sort(spark, sf_dir):
    runs = shows.runs(slots(spark, sf_dir), "category")
    plan = runs._jdf.queryExecution().executedPlan().toString()
    # no slot moves by chunk: one row per chunk goes to one partition, and up to two rows per chunk,
    # the runs at its ends, meet by run number
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert len([line for line in moved if "hashpartitioning(run_no" in line]) == 1
    assert all("SinglePartition" in line or "hashpartitioning(run_no" in line for line in moved)
    assert "Bucketed: true" in plan and "SortMergeJoin" not in plan


def test_contenders_are_limited_before_the_shuffle(spark):
    edges = spark.createDataFrame([(0, 1, 2, 3.0)], "g int, slot int, item int, profit double")
    assert "WindowGroupLimit" in plan_of(schedule.keep_contenders(edges, ["g"], "slot", "item"))


@pytest.mark.parametrize("name", ["cross_schedule", "triplet_tournament", "corr_matrix", "silhouettes", "histogram"])
def test_no_pairs_are_built(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_grid_needs_no_shuffle_of_cells(spark):
    products = spark.range(100).selectExpr("cast(id as string) as product_code")
    assert "Exchange" not in plan_of(schedule.cross_schedule(products, "2020-06-01", "2020-06-30"))


def test_scored_cells_are_not_shuffled(spark, sf_dir):
    from slotcast.workload.planning import scored_grid

    plan = scored_grid(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]  # what happens to the unfolded rows
    assert "BroadcastHashJoin" in above and "Exchange hashpartitioning" not in above and "SortMergeJoin" not in above
