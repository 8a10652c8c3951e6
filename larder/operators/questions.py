"""Named business questions over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions.numeric import as_double, count_when, ratio, round_to
from larder.operators.ranking import ranked


def critical_by_risk(health: DataFrame, k: int = 100) -> DataFrame:
    columns = ("sku_name", "location", "category", "quantity_on_hand", "stock_status", "risk_score")
    rows = health.where(F.col("stock_status") == K.CRITICAL).select(*columns)
    return ranked(rows, k, F.desc_nulls_last("risk_score"))


def value_by_location(health: DataFrame) -> DataFrame:
    return health.groupBy("location").agg(as_double(F.sum("total_inventory_value_usd")).alias("total_value"))


def alerts_by_location(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("location").agg(
        F.count(F.lit(1)).alias("alert_count"),
        count_when(F.col("priority") == K.PRIORITIES[0]).alias("critical_alerts"),
    )


def out_within_three_days(health: DataFrame, k: int = 100) -> DataFrame:
    columns = ("sku_name", "location", "category", "quantity_on_hand", "days_until_stockout", "stock_status")
    days = F.col("days_until_stockout")
    rows = health.where((days > 0) & (days <= K.COVER_DAYS_URGENT)).select(*columns)
    return ranked(rows, k, F.asc("days_until_stockout"))


def urgent_reorders(reorders: DataFrame, k: int = 50) -> DataFrame:
    rows = reorders.where(F.col("priority_score") >= K.URGENT_SCORE).select(
        "sku_name", "location", "category", "quantity_on_hand", "recommended_order_qty", "priority_score",
        F.col("estimated_order_value_usd").alias("order_value"),
    )
    return ranked(rows, k, F.desc("priority_score"))


def top_items_by_value(health: DataFrame, k: int = 5) -> DataFrame:
    columns = ("total_inventory_value_usd", "sku_id", "sku_name", "location", "category", "quantity_on_hand")
    return ranked(health.select(*columns), k, F.desc_nulls_last("total_inventory_value_usd"))


def critical_value(health: DataFrame) -> DataFrame:
    return health.where(F.col("stock_status") == K.CRITICAL).agg(
        F.count(F.lit(1)).alias("critical_items"),
        F.coalesce(as_double(F.sum("total_inventory_value_usd")), F.lit(0.0)).alias("critical_value"),
    )


def best_suppliers(health: DataFrame, k: int | None = None) -> DataFrame:
    means = health.groupBy("supplier_name").agg(
        round_to(ratio(F.sum("supplier_ontime_pct"), F.count("supplier_ontime_pct")), 1).alias("avg_ontime_pct")
    )
    return ranked(means, k, F.desc_nulls_last("avg_ontime_pct"))


def class_a_low(health: DataFrame) -> DataFrame:
    short = F.col("stock_status").isin(K.OUT_OF_STOCK, K.CRITICAL, K.LOW)
    return health.where((F.col("abc_class") == "A") & short).select(
        "sku_id", "sku_name", "location", "quantity_on_hand", "reorder_point", "stock_status"
    )


def categories_needing_attention(heatmap: DataFrame) -> DataFrame:
    """Categories by how many of their cells are not healthy, worst first."""
    cells = heatmap.groupBy("category").agg(
        count_when(F.col("overall_status") != K.HEALTHY).alias("troubled_locations"),
        F.sum("critical_skus").alias("critical_skus"),
    )
    return cells.orderBy(F.desc("troubled_locations"), F.desc("critical_skus"), "category")


def supplier_ontime_list(inventory: DataFrame) -> DataFrame:
    rows = inventory.where(F.col("supplier_name").isNotNull()).select("supplier_name", "supplier_ontime_pct")
    return rows.distinct().orderBy(F.desc("supplier_ontime_pct"), "supplier_name")
