"""Readers of materialised derived tables: columns, order and row cap of each list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import constants as K
from larder import schema
from larder.operators.ranking import by_severity, ranked

# Columns each reader returns.
HEALTH_COLUMNS = (
    "sku_id", "sku_name", "category", "location", "warehouse_id", "abc_class", "quantity_on_hand",
    "available_stock", "reorder_point", "safety_stock", "lead_time_days", "avg_daily_sales",
    "forecast_next_30d", "days_until_stockout", "stock_status", "risk_score", "unit_cost_usd",
    "total_inventory_value_usd", "supplier_name",
)
ALERT_COLUMNS = (
    "sku_id", "sku_name", "category", "location", "abc_class", "quantity_on_hand", "reorder_point",
    "safety_stock", "avg_daily_sales", "alert_type", "priority", "days_until_stockout",
    "lead_time_days", "supplier_name", "supplier_id", "unit_cost_usd",
    "total_inventory_value_usd", "days_since_last_received",
)
REORDER_COLUMNS = (
    "sku_id", "sku_name", "category", "location", "warehouse_id", "abc_class", "quantity_on_hand",
    "available_stock", "reorder_point", "safety_stock", "lead_time_days", "avg_daily_sales",
    "forecast_next_30d", "recommended_order_qty", "economic_order_qty", "priority_score",
    "unit_cost_usd", "estimated_order_value_usd", "supplier_name", "supplier_id",
    "supplier_ontime_pct", "days_of_inventory", "order_frequency_per_month",
)
LOCATION_COLUMNS = (
    "location", "warehouse_id", "total_skus", "total_categories", "total_units", "total_value_usd",
    "out_of_stock_count", "critical_count", "low_stock_count", "healthy_count", "health_score",
    "avg_days_coverage", "avg_supplier_performance", "avg_forecast_accuracy", "items_needing_reorder",
)
HEATMAP_COLUMNS = (
    "location", "category", "total_skus", "out_of_stock_skus", "critical_skus", "low_stock_skus",
    "healthy_skus", "total_units", "total_value_usd", "avg_days_coverage", "avg_risk_score",
    "overall_status",
)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _columns(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return schema.require(table, columns).select(*columns)


def health_list(table: DataFrame, limit: int | None = None) -> DataFrame:
    return ranked(_columns(table, HEALTH_COLUMNS), limit, F.desc_nulls_last("risk_score"), F.asc_nulls_last("abc_class"), F.asc_nulls_last("category"))


def alert_list(table: DataFrame, limit: int | None = None) -> DataFrame:
    return ranked(_columns(table, ALERT_COLUMNS), limit, *by_severity())


def reorder_list(table: DataFrame, limit: int | None = None) -> DataFrame:
    return ranked(_columns(table, REORDER_COLUMNS), limit, F.desc("priority_score"), F.desc_nulls_last("estimated_order_value_usd"))


def location_list(table: DataFrame) -> DataFrame:
    return _columns(table, LOCATION_COLUMNS).orderBy(F.asc_nulls_last("health_score"), "location", "warehouse_id")


def heatmap_list(table: DataFrame) -> DataFrame:
    return _columns(table, HEATMAP_COLUMNS).orderBy(F.desc_nulls_last("avg_risk_score"), "location", "category")


def read_stock_health(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return health_list(open_table(spark, path), limit)


def read_active_alerts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return alert_list(open_table(spark, path), limit)


def read_reorder(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return reorder_list(open_table(spark, path), limit)


def read_location(spark: SparkSession, path: str) -> DataFrame:
    return location_list(open_table(spark, path))


def read_heatmap(spark: SparkSession, path: str) -> DataFrame:
    return heatmap_list(open_table(spark, path))


def preview(df: DataFrame, n: int = 20, *order: Column) -> tuple[DataFrame, Column]:
    """First rows of a result, and how many more there are as a scalar column."""
    head = ranked(df, n, *order)
    more = df.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n)).scalar()
    return head, more
