"""Every named query over a directory of test tables.

The callables take (spark, sf_dir). The inventory is derived from the star-schema tables
first; a deployment hands its own typed table to the same operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import constants as K
from larder import schema
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.functions.numeric import as_double
from larder.operators import (
    clean,
    items,
    projection,
    questions,
    ranking,
    rollups,
    summaries,
    trends,
    windows,
)
from larder.plans import changes, days, jobs, logs
from larder.session import scratch_path
from larder.sources import delimited, derived, sinks, tables
from larder.streaming import changes as stream

AS_OF = derived.AS_OF
NEXT_DAY = "2001-08-02 01:00:00"  #: 25 hours after AS_OF
DAY_BEFORE = "2001-07-31 00:00:00"
LONG_LOOKBACK = 3650
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Heading column types of query results that leave out run times and ids.
_ALERT_COLUMNS = (
    "sku_id", "sku_name", "category", "location", "warehouse_id", "abc_class", "alert_type", "priority",
    "quantity_on_hand", "reorder_point", "safety_stock", "days_until_stockout", "resolved",
    "supplier_name", "supplier_id", "lead_time_days", "unit_cost_usd", "estimated_impact_usd",
)
_REORDER_COLUMNS = (
    "sku_id", "sku_name", "category", "location", "recommended_qty", "economic_order_qty", "priority_score",
    "unit_cost_usd", "total_order_value_usd", "status", "supplier_name", "supplier_id", "created_by",
)


def _health(inventory: DataFrame) -> DataFrame:
    return items.stock_health(inventory)


def _alerts(inventory: DataFrame) -> DataFrame:
    return items.active_alerts(inventory, AS_OF)


def _projection(inventory: DataFrame) -> DataFrame:
    return projection.stock_projection(_health(inventory))


def _stored(df: DataFrame) -> DataFrame:
    """A table as a deployment has it, in files: the test tables are joined once, not for each pass."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _on(build: Callable[[DataFrame], DataFrame], *steps: Callable[[DataFrame], DataFrame]) -> Query:
    """Query from the inventory through ``steps`` to ``build``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = derived.inventory(spark, sf_dir)
        for step in steps:
            df = step(df)
        return build(df)

    return run


def _add(name: str, query: Query) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query


def _register_items() -> None:
    _add("stock_health_matrix", _on(items.stock_health_matrix))
    _add("stock_health", _on(items.stock_health))
    _add("critical_items", _on(items.critical_items))
    _add("active_alerts", _on(_alerts))
    _add("reorder_recommendations", _on(items.reorder_recommendations))
    _add("inventory_context", _on(items.inventory_context))
    _add("item_scatter", _on(items.item_scatter, _health))
    _add("item_scatter_risk", _on(lambda h: items.item_scatter(h, "risk_score"), _health))
    _add("risk_alert_fallback", _on(lambda h: h.where(P.at_risk()).select("sku_id", "sku_name", "location", "risk_score"), _health))
    _add(
        "sliced_health",
        _on(lambda h: P.slice_by(h, location="NATION_1", category="ECONOMY", status=K.CRITICAL), _health),
    )
    _add("half_reorder_status", _on(lambda i: i.where(P.is_active()).groupBy(M.half_reorder_status().alias("stock_status")).count().withColumnRenamed("count", "item_count")))
    _add("sliced_alerts", _on(lambda a: P.slice_by(a, location="NATION_1", category="All"), _alerts))


def _register_rollups() -> None:
    for build in (
        rollups.location_category_summary,
        rollups.warehouse_performance,
        rollups.abc_analysis,
        rollups.location_performance,
        rollups.category_heatmap,
        rollups.overview_counts,
        rollups.table_row_counts,
        rollups.check_counts,
        rollups.mean_days_all,
        rollups.duplicate_keys,
        summaries.critical_item_list,
        summaries.critical_item_entries,
        summaries.critical_categories,
    ):
        _add(build.__name__, _on(build))
    _add("daily_insight_row", _on(lambda i: summaries.daily_insight_row(i, AS_OF)))
    for build in (
        summaries.health_by_location_category,
        summaries.inventory_summary,
        summaries.abc_summary,
        summaries.location_breakdown,
        summaries.category_breakdown,
        summaries.dashboard_kpis,
        summaries.abc_at_risk,
        summaries.abc_distribution,
        summaries.abc_value_share,
        summaries.abc_cost_stats,
        summaries.abc_risk,
        summaries.status_counts,
        summaries.status_by_category,
    ):
        _add(build.__name__, _on(build, _health))
    _add("alerts_by_priority", _on(summaries.alerts_by_priority, _alerts))
    _add("alert_summary", _on(summaries.alert_summary, _alerts))
    _add("reorder_stats", _on(summaries.reorder_stats, items.reorder_recommendations))
    _add("reorder_summary", _on(summaries.reorder_summary, items.reorder_recommendations))
    _add(
        "reorder_summary_by_point",
        _on(lambda r: summaries.reorder_summary(r, "reorder_point"), items.reorder_recommendations),
    )

    _add(
        "reorder_summary_by_stock",
        _on(lambda r: summaries.reorder_summary(r, urgent_from="stock"), items.reorder_recommendations),
    )
    _add("category_by_location", _on(summaries.category_by_location, _health))

    for metric in ("risk", "cover", "critical_pct"):
        _add(f"heatmap_pivot_{metric}", _on(lambda h, m=metric: summaries.heatmap_pivot(h, m), rollups.category_heatmap))

    _add("insight_context", _on(summaries.insight_facts, summaries.insight_context))


def _register_windows() -> None:
    for suffix, days in (("", K.LOOKBACK_DAYS), ("_long", LONG_LOOKBACK)):
        _add(f"audit_changes{suffix}", _on(lambda i, d=days: windows.audit_changes(i, AS_OF, d)))
        _add(f"change_statistics{suffix}", _on(lambda i, d=days: windows.change_statistics(i, AS_OF, d)))
        _add(f"inventory_anomalies{suffix}", _on(lambda i, d=days: windows.inventory_anomalies(i, AS_OF, d)))
        _add(f"trailing_demand{suffix}", _on(lambda i, d=days: windows.trailing_demand(i, AS_OF, d)))
        _add(f"demand_forecast{suffix}", _on(lambda i, d=days: windows.demand_forecast(i, AS_OF, d)))
    _add("latest_by_location_category", _on(windows.latest_by_location_category, trends.snapshot_history))
    _add("latest_snapshot", _on(windows.latest_snapshot, trends.snapshot_history))


def _register_projection_and_trends() -> None:
    _add("stock_projection", _on(_projection))
    _add("projection_compare_all", _on(projection.projection_compare, _projection))

    def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _projection(derived.inventory(spark, sf_dir))
        chosen = rows.select("item_name").distinct().orderBy("item_name").limit(5)
        return projection.projection_compare(rows, chosen)

    _add("projection_compare", compare)
    _add("projection_compare_named", _on(lambda p: projection.projection_compare(p, ["small ring", "cold anvil"]), _projection))
    for dimension in ("category", "location"):
        _add(f"forecast_risk_by_{dimension}", _on(lambda p, d=dimension: projection.forecast_risk_by(p, d), _projection))
    _add("forecast_summary", _on(projection.forecast_summary, _projection))
    _add("accuracy_by_category", _on(projection.accuracy_by_category, _projection))
    _add("accuracy_histogram", _on(projection.accuracy_histogram, _projection))

    history = trends.snapshot_history
    _add("snapshot_history", _on(history))
    for suffix, days in (("", K.HISTORY_DAYS), ("_long", LONG_LOOKBACK)):
        _add(f"trend_stock{suffix}", _on(lambda s, d=days: trends.trend_by_category(s, "current_stock", AS_OF, d), history))
        _add(f"trend_consumption{suffix}", _on(lambda s, d=days: trends.trend_by_category(s, "consumption", AS_OF, d), history))

    _add("stock_by_location", _on(trends.stock_by_location, history))
    _add("status_by_location", _on(trends.status_by_location, history))
    _add("item_snapshot_stats", _on(trends.item_snapshot_stats, history))
    _add("item_stock_by_location", _on(trends.item_stock_by_location, history))
    _add("trend_summary", _on(trends.trend_summary, history))


def _register_lists() -> None:
    reorders = items.reorder_recommendations
    _add("top_critical_items", _on(ranking.top_critical_items, _health))
    _add("top_reorders", _on(ranking.top_reorders, reorders))
    _add("reorders_in_table_order", _on(lambda r: ranking.reorders_in_table_order(r.select(*tables.REORDER_COLUMNS)), reorders))
    _add("worst_locations", _on(ranking.worst_locations, rollups.location_performance))
    _add("top_heatmap_cells", _on(ranking.top_heatmap_cells, rollups.category_heatmap))
    _add("first_alerts", _on(ranking.first_alerts, _alerts))
    _add("reorder_list", _on(ranking.reorder_list, reorders))
    _add("high_risk_forecasts", _on(ranking.high_risk_forecasts, _projection))
    _add("high_risk_search", _on(lambda p: ranking.high_risk_forecasts(p, "RING"), _projection))
    _add("top_anomalies", _on(ranking.top_anomalies, lambda i: windows.inventory_anomalies(i, AS_OF, LONG_LOOKBACK)))
    _add("top_forecasts", _on(ranking.top_forecasts, lambda i: windows.demand_forecast(i, AS_OF, LONG_LOOKBACK)))
    _add("recent_insights", _on(ranking.recent_insights, summaries.insights_by_audit_date))
    _add("location_picker", _on(lambda h: ranking.picker(h, "location"), _health))
    _add("category_picker", _on(lambda h: ranking.picker(h, "category"), _health))
    _add("read_stock_health", _on(tables.health_list, _health))
    _add("read_active_alerts", _on(tables.alert_list, _alerts))
    _add("read_reorder", _on(tables.reorder_list, reorders))
    _add("read_location", _on(tables.location_list, rollups.location_performance))
    _add("read_heatmap", _on(tables.heatmap_list, rollups.category_heatmap))

    def preview(alerts: DataFrame) -> DataFrame:
        columns = alerts.select("sku_id", "location", "priority", "days_until_stockout")
        head, more = tables.preview(columns, 20, *ranking.by_severity())
        return head.withColumn("more_rows", more)

    _add("result_preview", _on(preview, _alerts))


def _register_questions() -> None:
    for build in (
        questions.critical_by_risk,
        questions.value_by_location,
        questions.out_within_three_days,
        questions.top_items_by_value,
        questions.critical_value,
        questions.best_suppliers,
        questions.class_a_low,
    ):
        _add(f"question_{build.__name__}", _on(build, _health))
    _add("question_alerts_by_location", _on(questions.alerts_by_location, _alerts))
    _add("question_urgent_reorders", _on(questions.urgent_reorders, items.reorder_recommendations))
    _add("question_categories_needing_attention", _on(questions.categories_needing_attention, rollups.category_heatmap))
    _add("question_supplier_ontime_list", _on(questions.supplier_ontime_list))


def _register_cleaning() -> None:
    def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived.from_inventory(spark, sf_dir, derived.RAW_SQL)

    _add("cleaned_inventory", lambda spark, d: clean.clean_inventory(raw(spark, d)))
    _add("rejected_rows", lambda spark, d: clean.rejected_rows(raw(spark, d)))

    def from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "raw-file")
        delimited.write_raw(raw(spark, sf_dir), path)
        loaded = delimited.with_load_time(delimited.read_raw(spark, path), AS_OF)
        return clean.clean_inventory(loaded)

    _add("loaded_inventory", from_file)


def _register_jobs() -> None:
    def history(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived.from_inventory(spark, sf_dir, derived.ALERT_HISTORY_SQL)

    def log(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived.from_inventory(spark, sf_dir, derived.REORDER_LOG_SQL)

    def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        """Both states from one stored inventory: the star-schema tables are joined once."""
        once = _stored(derived.inventory(spark, sf_dir).select(*derived.STATE_COLUMNS))
        return tuple(spark.sql(text, inventory=once) for text in (derived.OLD_SQL, derived.NEW_SQL))

    _add(
        "generate_alerts",
        lambda s, d: logs.new_alerts(derived.inventory(s, d), history(s, d), AS_OF)
        .select(*_ALERT_COLUMNS)
        .withColumns({c: as_double(c) for c in ("days_until_stockout", "estimated_impact_usd")}),
    )
    _add(
        "generate_reorders",
        lambda s, d: logs.new_reorders(derived.inventory(s, d), log(s, d), AS_OF)
        .select(*_REORDER_COLUMNS)
        .withColumns({c: as_double(c) for c in ("recommended_qty", "economic_order_qty", "total_order_value_usd")}),
    )
    def kept_alerts(rows: DataFrame) -> DataFrame:
        return rows.select(
            "sku_id", "location", "resolved", F.to_date("alert_timestamp").alias("alerted_on"), F.to_date("resolved_timestamp").alias("resolved_on")
        )

    _add("purge_resolved", lambda s, d: kept_alerts(logs.keep_after_purge(history(s, d), AS_OF)))

    def purged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
        alerts = _stored(schema.conform(history(spark, sf_dir), schema.ALERT_HISTORY))
        manifest = days.write_days(alerts, scratch_path(spark, "alert-days"), "alert_timestamp")
        after = days.purge_resolved(spark, manifest, scratch_path(spark, "alert-days-kept"), AS_OF)
        return kept_alerts(days.open_days(spark, after, schema.ALERT_HISTORY))

    _add("purged_days", purged_days)

    def newest_snapshot_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
        snapshots = _stored(trends.snapshot_history(derived.inventory(spark, sf_dir)))
        manifest = days.write_days(snapshots, scratch_path(spark, "snapshot-days"), "snapshot_date")
        return days.open_days(spark, days.newest(manifest), snapshots.schema)

    _add("newest_snapshot_folder", newest_snapshot_folder)

    def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
        alerts = history(spark, sf_dir).withColumns(
            {"resolved_by": F.lit(None).cast("string"), "resolution_notes": F.lit(None).cast("string")}
        )
        class_a = derived.inventory(spark, sf_dir).where(F.col("abc_class") == "A")
        done = class_a.select(
            "sku_id", F.col("warehouse_location").alias("location"),
            F.lit("planner").alias("resolved_by"), F.lit("restocked").alias("resolution_notes"),
        ).distinct()
        result = logs.resolve_alerts(alerts, done, AS_OF, ("sku_id", "location"))
        return result.select(
            "sku_id", "location", "resolved", F.to_date("resolved_timestamp").alias("resolved_on"),
            F.to_date("alert_timestamp").alias("alerted_on"), "resolved_by", "resolution_notes",
        )

    _add("resolve_alerts", resolve)

    def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
        status = F.when(F.col("abc_class") == "A", "ORDERED").when(F.col("abc_class") == "B", "DELIVERED")
        rows = derived.inventory(spark, sf_dir).select("sku_id", F.col("warehouse_location").alias("location"), status.alias("status"), "audit_date")
        return rows.where(F.col("status").isNotNull()).distinct()

    def move(spark: SparkSession, sf_dir: str, sequence: str | None = None) -> DataFrame:
        actions = log(spark, sf_dir).withColumns(
            {"order_date": F.lit(None).cast("date"), "actual_delivery_date": F.lit(None).cast("date")}
        )
        result = logs.move_reorders(actions, moved(spark, sf_dir), AS_OF, ("sku_id", "location"), sequence)
        return result.withColumn("action_timestamp", F.to_date("action_timestamp")).withColumnRenamed("action_timestamp", "action_date")

    _add("move_reorders", move)
    _add("move_reorders_in_order", lambda s, d: move(s, d, "audit_date"))
    _add("clashing_moves", lambda s, d: logs.clashing_moves(moved(s, d), ("sku_id", "location")))

    def override(inventory: DataFrame) -> DataFrame:
        few = jobs.chosen_items(inventory, "ECONOMY", 3)
        some = jobs.chosen_items(inventory, "STANDARD", 5)
        emptied = jobs.apply_stock_override(inventory, few, F.lit(5), AS_OF)
        return jobs.apply_stock_override(emptied, some, M.reorder_point() * F.lit(K.LOW_TRIAL_SHARE), AS_OF)

    _add("stock_override", _on(override))
    _add("stock_override_critical", _on(lambda i: summaries.status_counts(_health(override(i)))))
    _add("inventory_changes", lambda s, d: changes.inventory_changes(*states(s, d)))
    _add("has_changes", lambda s, d: changes.has_changes(*states(s, d)))
    _add("applied_changes", lambda s, d: _applied(*states(s, d)))

    def between_states(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same changes from two written states, of which only buckets that differ are read whole."""
        paths = []
        old, new = states(spark, sf_dir)
        for df in (old, new.select(*[F.col(f.name).cast(f.dataType) for f in old.schema])):
            paths.append(scratch_path(spark, "state"))
            changes.write_state(df, paths[-1], buckets=16)
        return changes.state_changes(spark, *paths)

    _add("state_changes", between_states)

    def export(reorders: DataFrame) -> DataFrame:
        return sinks.export_frame(reorders, "NATION_1")

    _add("export_reorder", _on(export, items.reorder_recommendations))
    _add("export_shown_list", _on(lambda r: sinks.shown_list(r, include_all=False), items.reorder_recommendations))

    def export_row(spark: SparkSession, sf_dir: str) -> DataFrame:
        reorders = items.reorder_recommendations(derived.inventory(spark, sf_dir))
        row = sinks.export_log_row(spark, "REORDER_LIST", reorders, AS_OF, filters={"category": "All", "location": "All"})
        return row.select("export_type", "record_count", "exported_by", "file_format", "filters_applied")

    _add("export_log", export_row)

    def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A derived table through its Parquet files, laid out by location and category."""
        path = scratch_path(spark, "stock-health")
        health = _health(derived.inventory(spark, sf_dir))
        sinks.materialize(health, path, partition_by=None, clustered_by=("location", "category"))
        return tables.open_table(spark, path)

    _add("materialized_stock_health", materialized)

    def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Today's figures appended twice: the second run replaces the first."""
        path = scratch_path(spark, "daily-insights")
        inventory = derived.inventory(spark, sf_dir)
        for _ in range(2):
            jobs.append_daily_insight(spark, inventory, path, AS_OF)
        return spark.read.parquet(path).drop("log_date")

    _add("appended_daily_insight", daily_log)

    def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
        saved, table = scratch_path(spark, "backup"), scratch_path(spark, "table")
        sinks.backup(derived.inventory(spark, sf_dir), saved)
        back = sinks.restore(spark, saved, table)
        return back

    _add("restored_rows", restored)
    _add("restored_counts", lambda s, d: rollups.overview_counts(restored(s, d)))


def _applied(old: DataFrame, new: DataFrame) -> DataFrame:
    return changes.apply_changes(old, changes.inventory_changes(old, new))


def later_state(inventory: DataFrame) -> DataFrame:
    """A later state of the stock table: some rows gone, some restocked."""
    restocked = F.when(F.col("stock_age_days") % 13 == 0, F.col("quantity_on_hand") + 5).otherwise(F.col("quantity_on_hand"))
    return inventory.where(F.col("stock_age_days") % 17 != 0).withColumn("quantity_on_hand", restocked.cast("decimal(18,2)"))


def _register_streams() -> None:
    def refreshed(name: str) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Load, then a batch of changes, through the stream; equals the batch table of the later state.

            Row-level tables are asked for once before the changes, for the day before.
            """
            base = scratch_path(spark, f"{name}-stream")

            def taken_in() -> None:
                feed = stream.read_changes(spark, f"{base}/feed")
                stream.stream_refresh(feed, name, f"{base}/state", f"{base}/table", f"{base}/checkpoint", lag=None).awaitTermination()

            stream.publish_load(derived.inventory(spark, sf_dir), f"{base}/feed")
            old = stream.loaded(spark, f"{base}/feed")
            taken_in()
            if name not in stream.ROLLUPS:
                stream.publish_items(spark, name, f"{base}/state", DAY_BEFORE, f"{base}/table")
            stream.publish_changes(old, later_state(old), f"{base}/feed")
            taken_in()
            if name in stream.ROLLUPS:
                return stream.current_table(spark, f"{base}/table")
            stream.publish_items(spark, name, f"{base}/state", AS_OF, f"{base}/table")
            return tables.open_table(spark, f"{base}/table")

        return run

    for table in jobs.TARGET_LAG:
        _add(f"stream_{table}", refreshed(table))

    def alerts(spark: SparkSession, sf_dir: str, later: str = AS_OF) -> DataFrame:
        """Two batches of rows; the second, at `later`, is checked against the alerts of the first."""
        base = scratch_path(spark, "alert-stream")
        inventory = derived.inventory(spark, sf_dir)
        even = F.col("stock_age_days") % 2 == 0
        for part in (even, ~even):
            stream.publish_load(inventory.where(part), f"{base}/feed")
            feed = stream.read_changes(spark, f"{base}/feed")
            stream.stream_alerts(feed, f"{base}/history", f"{base}/checkpoint", lambda k: later if k else AS_OF, lag=None).awaitTermination()
        logged = spark.read.parquet(f"{base}/history")
        return logged.select("batch_id", "sku_id", "location", "alert_type", "priority", "quantity_on_hand")

    _add("stream_alert_log", alerts)
    _add("stream_alert_log_next_day", lambda spark, sf_dir: alerts(spark, sf_dir, NEXT_DAY))

    def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All rows enter at once; then only time passes, an hour and a day: what is still critical is alerted again."""
        base = scratch_path(spark, "heartbeat-stream")
        stream.publish_load(derived.inventory(spark, sf_dir), f"{base}/feed")
        clock = (AS_OF, "2001-08-01 01:00:00", NEXT_DAY)
        for k in range(len(clock)):
            if k:
                stream.publish_heartbeat(spark, f"{base}/feed")
            feed = stream.read_changes(spark, f"{base}/feed")
            stream.stream_alerts(feed, f"{base}/history", f"{base}/checkpoint", clock.__getitem__, lag=None).awaitTermination()
        logged = spark.read.parquet(f"{base}/history")
        return logged.select("batch_id", "sku_id", "location", "alert_type", "priority", "quantity_on_hand")

    _add("stream_alert_log_heartbeat", heartbeats)


for _register in (
    _register_items,
    _register_rollups,
    _register_windows,
    _register_projection_and_trends,
    _register_lists,
    _register_questions,
    _register_cleaning,
    _register_jobs,
    _register_streams,
):
    _register()
