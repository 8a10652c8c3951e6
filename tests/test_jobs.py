"""Logs, changes, overrides and sinks: what a second run, a later run and a repeat do."""

from __future__ import annotations

import datetime
from collections import Counter

from pyspark.sql import functions as F

from larder import schema
from larder.operators import items, ranking, rollups, summaries
from larder.plans import changes, jobs, logs
from larder.sources import derived, sinks, tables

AS_OF = "2001-08-01 00:00:00"


def _later(hours: int) -> str:
    return str(datetime.datetime(2001, 8, 1) + datetime.timedelta(hours=hours))


def test_alerts_are_quiet_for_a_day(spark, rows, tmp_path):
    path = str(tmp_path / "history")
    stock = rows({"quantity_on_hand": 5}, {"quantity_on_hand": 6, "batch_id": "B2"}, {"sku_id": "S2"})
    assert logs.generate_alerts(spark, stock, path, AS_OF) == 2  # both batches of one item
    assert logs.generate_alerts(spark, stock, path, AS_OF) == 0
    assert logs.generate_alerts(spark, stock, path, _later(24)) == 0
    assert logs.generate_alerts(spark, stock, path, _later(25)) == 2


def test_resolved_alert_rearms(spark, rows, tmp_path):
    path, after = str(tmp_path / "history"), str(tmp_path / "resolved")
    stock = rows({"quantity_on_hand": 5})
    assert logs.generate_alerts(spark, stock, path, AS_OF) == 1
    history = logs.open_log(spark, path, schema.ALERT_HISTORY)
    done = history.select("alert_id", F.lit("me").alias("resolved_by"), F.lit("done").alias("resolution_notes"))
    logs.rewrite_log(logs.resolve_alerts(history, done.unionAll(done), _later(1)), after, "alert_timestamp")
    row = logs.open_log(spark, after, schema.ALERT_HISTORY).first()
    assert (row.resolved, row.resolved_by, row.resolved_timestamp) == (True, "me", datetime.datetime(2001, 8, 1, 1))
    assert logs.generate_alerts(spark, stock, after, _later(2)) == 1


def test_row_without_location_alerts_every_time(spark, rows, tmp_path):
    path = str(tmp_path / "history")
    stock = rows({"quantity_on_hand": 5, "warehouse_location": None})
    assert [logs.generate_alerts(spark, stock, path, AS_OF) for _ in range(2)] == [1, 1]


def test_reorders_are_quiet_for_a_week(spark, rows, tmp_path):
    path, moved = str(tmp_path / "log"), str(tmp_path / "moved")
    stock = rows({"quantity_on_hand": 5})
    assert logs.generate_reorders(spark, stock, path, AS_OF) == 1
    assert logs.generate_reorders(spark, stock, path, _later(24 * 7)) == 0
    log = logs.open_log(spark, path, schema.REORDER_LOG)
    logs.rewrite_log(logs.move_reorders(log, log.select("action_id", F.lit("ORDERED").alias("status")), _later(1)), moved, "action_timestamp")
    row = logs.open_log(spark, moved, schema.REORDER_LOG).first()
    assert (row.status, row.order_date, row.actual_delivery_date) == ("ORDERED", datetime.date(2001, 8, 1), None)
    assert logs.generate_reorders(spark, stock, moved, _later(2)) == 1
    assert logs.generate_reorders(spark, stock, path, _later(24 * 7 + 1)) == 1


def test_purge_boundary(spark):
    cut = datetime.datetime(2001, 8, 1) - datetime.timedelta(days=90)
    before = cut - datetime.timedelta(seconds=1)
    data = [("old", True, before), ("edge", True, cut), ("open", False, before), ("unknown", True, None)]
    history = spark.createDataFrame(data, "sku_id string, resolved boolean, resolved_timestamp timestamp_ntz")
    kept = logs.keep_after_purge(history, AS_OF)
    assert sorted(r.sku_id for r in kept.collect()) == ["edge", "open", "unknown"]


def test_purge_writes_the_next_version(spark, rows, tmp_path):
    path, after = str(tmp_path / "history"), str(tmp_path / "after")
    logs.generate_alerts(spark, rows({"quantity_on_hand": 5}), path, AS_OF)
    logs.purge_resolved(spark, path, after, _later(24 * 200))
    assert logs.open_log(spark, after, schema.ALERT_HISTORY).count() == 1


def test_changes_are_a_multiset_difference(spark):
    shape = "sku_id string, batch_id string, quantity_on_hand int"
    old = [("a", "1", 5), ("a", "1", 5), ("b", "1", 7), ("c", "1", 1), ("d", None, 2), ("e", "1", 9)]
    new = [("a", "1", 5), ("b", "1", 8), ("b", "1", 8), ("d", None, 3), ("e", "1", 9), ("f", "1", 4)]
    left, right = spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)
    diff = changes.inventory_changes(left, right)
    got = {(r.sku_id, r.quantity_on_hand, r.change_action, r.is_update, r.copies) for r in diff.collect()}
    assert got == {
        ("a", 5, "DELETE", False, 1), ("b", 7, "DELETE", True, 1), ("b", 8, "INSERT", True, 2), ("c", 1, "DELETE", False, 1),
        ("d", 2, "DELETE", True, 1), ("d", 3, "INSERT", True, 1), ("f", 4, "INSERT", False, 1),
    }
    assert Counter(map(tuple, changes.apply_changes(left, diff).collect())) == Counter(new)
    assert changes.has_changes(left, right).first().has_data is True
    assert changes.has_changes(left, left).first().has_data is False


def test_override_touches_only_chosen_items(rows):
    stock = rows({"sku_id": "S2"}, {"sku_id": "S1"}, {"sku_id": "S1", "batch_id": "B2"}, {"sku_id": "S0", "category": "Other"})
    after = jobs.apply_stock_override(stock, jobs.chosen_items(stock, "Tools", 1), F.lit(5), AS_OF)
    got = sorted((r.sku_id, float(r.quantity_on_hand), r.audit_date.day) for r in after.collect())
    assert got == [("S0", 100.0, 31), ("S1", 5.0, 1), ("S1", 5.0, 1), ("S2", 100.0, 31)]
    assert after.schema == stock.schema


def test_two_level_counts_equal_plain_distinct_counts(inventory):
    cells = rollups.category_heatmap(inventory)
    rows = rollups.located(inventory)
    sku = F.col("sku_id")
    naive = rows.groupBy("location", "category").agg(
        F.count_distinct("sku_id").alias("total_skus"),
        F.count_distinct(F.when(F.col("quantity_on_hand") <= 0, sku)).alias("out_of_stock_skus"),
        F.count_distinct(F.when(F.col("quantity_on_hand") > F.col("reorder_point"), sku)).alias("healthy_skus"),
    )
    pick = cells.select(*naive.columns)
    assert Counter(map(tuple, pick.collect())) == Counter(map(tuple, naive.collect()))


def test_exclusive_bands_add_up(inventory):
    summary = rollups.location_category_summary(inventory)
    bands = sum(summary.agg(*[F.sum(c) for c in ("out_of_stock_count", "critical_count", "low_count", "healthy_count")]).first())
    assert bands == items.stock_health(inventory).count()


def test_materialized_tables_and_readers(spark, inventory, tmp_path):
    paths = {}
    for name in jobs.derived_tables(AS_OF):
        paths[name] = str(tmp_path / name)
        jobs.refresh(inventory, name, paths[name], AS_OF)
        jobs.refresh(inventory, name, paths[name], AS_OF)
    health = items.stock_health(inventory)
    assert tables.open_table(spark, paths["stock_health"]).count() == health.count()
    read = tables.read_stock_health(spark, paths["stock_health"], 50)
    assert [r.risk_score for r in read.collect()] == [100.0] * 50
    assert tables.read_active_alerts(spark, paths["active_alerts"], 7).count() == 7
    scores = [r.priority_score for r in tables.read_reorder(spark, paths["reorder_recommendations"]).collect()]
    assert scores == sorted(scores, reverse=True)
    assert tables.read_location(spark, paths["location_performance"]).count() == rollups.location_performance(inventory).count()
    assert tables.read_heatmap(spark, paths["category_heatmap"]).count() == rollups.category_heatmap(inventory).count()


def test_export_and_its_log(spark, inventory, tmp_path):
    reorders = items.reorder_recommendations(inventory)
    path, log = str(tmp_path / "list"), str(tmp_path / "log")
    place = reorders.first().location
    sinks.export_reorder(reorders, path, place)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == list(sinks.EXPORT_HEADINGS.values())
    assert back.count() == reorders.where(F.col("location") == place).count()
    for _ in range(2):
        sinks.log_export(sinks.export_log_row(spark, "REORDER_LIST", back, AS_OF, filters={"location": place}), log)
    logged = sinks.export_filters(spark.read.parquet(log))
    assert logged.count() == 2
    assert logged.select(F.variant_get("filters_applied", "$.location", "string")).first()[0] == place


def test_backup_and_restore(spark, rows, tmp_path):
    saved, table = str(tmp_path / "saved"), str(tmp_path / "table")
    stock = rows({"sku_id": "S1"}, {"sku_id": "S2"})
    sinks.backup(stock, saved)
    rows({"sku_id": "S9"}).write.parquet(table)
    assert sorted(r.sku_id for r in sinks.restore(spark, saved, table).collect()) == ["S1", "S2"]


def test_daily_insight_replaces_its_day(spark, rows, tmp_path):
    path = str(tmp_path / "insights")
    for stock, at in ((rows({"quantity_on_hand": 5}), AS_OF), (rows({"quantity_on_hand": 5}, {"quantity_on_hand": 6}), AS_OF), (rows(), _later(24))):
        jobs.append_daily_insight(spark, stock, path, at)
    got = [(str(r.insight_date), r.critical_count) for r in ranking.recent_insights(spark.read.parquet(path).drop("log_date")).collect()]
    assert got == [("2001-08-02", 0), ("2001-08-01", 2)]


def test_preview_counts_the_rest(inventory):
    head, more = tables.preview(items.stock_health(inventory).select("sku_id", "location"), 20, F.asc("sku_id"))
    rest = head.select(more.alias("n")).first().n
    assert head.count() == 20
    assert rest == items.stock_health(inventory).count() - 20


def test_empty_inventory_gives_zero_rows_or_zero_counts(spark):
    empty = spark.createDataFrame([], schema.INVENTORY)
    health = items.stock_health(empty)
    assert summaries.dashboard_kpis(health).first().health_pct == 0.0
    assert summaries.inventory_summary(health).first().critical_count == 0
    assert rollups.overview_counts(empty).first().total_records == 0
    assert summaries.daily_insight_row(empty, AS_OF).first().critical_count == 0
    assert rollups.category_heatmap(empty).count() == 0


def test_fixture_seeds_are_not_empty(spark):
    for text in (derived.ALERT_HISTORY_SQL, derived.REORDER_LOG_SQL, derived.RAW_SQL):
        assert derived.from_inventory(spark, "/root/testdata/sf0.001", text).limit(1).count() == 1
