"""What the physical plans must and must not contain."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from larder.operators import items, rollups, summaries, trends, windows
from larder.plans import logs
from larder.plans.registry import QUERIES
from larder.sources import derived

AS_OF = "2001-08-01 00:00:00"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|single|round)", plan(df)))


@pytest.mark.parametrize(
    "table",
    [items.stock_health, items.stock_health_matrix, items.critical_items, items.reorder_recommendations, items.inventory_context],
)
def test_item_tables_are_narrow(inventory, table):
    assert shuffles(table(inventory)) == 0


def test_filters_and_columns_reach_the_scan(inventory):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        items.reorder_recommendations(inventory).select("sku_id", "recommended_order_qty").explain("formatted")
    text = out.getvalue()
    scanned = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "sku_name" not in scanned and "notes" not in scanned
    assert "Not(In(inventory_status, [Discontinued,Obsolete]))" in text


def test_conditional_distinct_counts_copy_no_rows(inventory):
    text = plan(rollups.category_heatmap(inventory))
    assert "Expand" not in text
    assert shuffles(rollups.category_heatmap(inventory)) == 2


@pytest.mark.parametrize("table", [rollups.location_performance, rollups.warehouse_performance])
def test_counts_of_items_and_categories_copy_no_rows(inventory, table):
    assert "Expand" not in plan(table(inventory))


def _final_plan(df):
    """The plan that ran, after the adaptive planner's last decision."""
    df.collect()
    text = plan(df)
    assert "isFinalPlan=true" in text
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("table", [windows.inventory_anomalies, windows.change_statistics, windows.trailing_demand])
def test_item_windows_sort_and_shuffle_once_without_hot_items(inventory, table):
    """Beside the count by key bucket, which is one row per bucket."""
    text = _final_plan(table(inventory, AS_OF, 3650))
    assert text.count(" Sort [") == 1
    assert text.count("hashpartitioning(sku_id") == 1
    assert "SortMergeJoin" not in text


def test_quiet_period_is_an_anti_join(inventory, spark):
    history = derived.from_inventory(spark, "/root/testdata/sf0.001", derived.ALERT_HISTORY_SQL)
    assert "LeftAnti" in plan(logs.new_alerts(inventory, history, AS_OF))


def test_top_list_keeps_k_rows_per_task(inventory):
    from larder.operators import ranking

    assert "TakeOrderedAndProject" in plan(ranking.top_critical_items(items.stock_health(inventory)))


def test_insight_context_reads_the_inventory_twice(inventory):
    df = summaries.insight_facts(summaries.insight_context(inventory))
    text = plan(df)
    assert text.count("FileScan") <= 2 and shuffles(df) <= 10
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "WindowGroupLimit" in text  # no task sorts all places to list ten


def test_distinct_counts_in_one_row_copy_no_rows(inventory):
    health = items.stock_health(inventory)
    history = trends.snapshot_history(inventory)
    for df in (
        summaries.inventory_summary(health), rollups.overview_counts(inventory),
        rollups.table_row_counts(inventory), trends.trend_summary(history),
    ):
        assert "Expand" not in plan(df)


def test_writes_bring_rows_together_by_rebalancing(inventory):
    from larder.sources import sinks

    health = items.stock_health(inventory)
    for layout in (("location", ()), (None, ("location", "category"))):
        assert "REBALANCE_PARTITIONS_BY_COL" in plan(sinks.laid_out(health, *layout))


def test_cost_statistics_scan_once(inventory):
    df = summaries.abc_cost_stats(items.stock_health(inventory))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_no_query_runs_python_per_row_or_pairs_rows_blindly(spark):
    writes_files = {"loaded_inventory", "materialized_stock_health", "restored_counts", "purged_days", "newest_snapshot_folder"}
    for name, query in QUERIES.items():
        if name in writes_files or name.startswith("stream_"):
            continue
        text = plan(query(spark, "/root/testdata/sf0.001"))
        for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "MapInArrow"):
            assert node not in text, (name, node)
