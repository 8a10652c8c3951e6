"""Jobs that refresh derived tables, try out stock levels and log daily figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schema
from larder.operators import items, rollups
from larder.operators.summaries import daily_insight_row
from larder.sources import sinks

# How stale each derived table may get.
TARGET_LAG = {
    "stock_health": "5 minutes",
    "active_alerts": "10 minutes",
    "reorder_recommendations": "30 minutes",
    "location_performance": "1 hour",
    "category_heatmap": "15 minutes",
}


def derived_tables(as_of: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "stock_health": items.stock_health,
        "active_alerts": lambda inventory: items.active_alerts(inventory, as_of),
        "reorder_recommendations": items.reorder_recommendations,
        "location_performance": rollups.location_performance,
        "category_heatmap": rollups.category_heatmap,
    }


def refresh(inventory: DataFrame, name: str, path: str, as_of: str) -> None:
    """Recompute one derived table and replace its files."""
    sinks.materialize(derived_tables(as_of)[name](inventory), path)


def chosen_items(inventory: DataFrame, category: str, n: int) -> DataFrame:
    """First ``n`` items of a category by id."""
    ids = inventory.where(F.col("category") == category).select("sku_id").distinct()
    return ids.orderBy("sku_id").limit(n)


def apply_stock_override(inventory: DataFrame, chosen: DataFrame, quantity: Column, as_of: str) -> DataFrame:
    """What-if: set the on-hand stock of the chosen items and date the audit to now.

    ``chosen`` comes from a limit, so Spark knows its size and broadcasts it by itself.
    """
    ids = chosen.select(F.col("sku_id").alias("_sku")).distinct()
    joined = inventory.join(ids, F.col("sku_id") == F.col("_sku"), "left")
    hit = F.col("_sku").isNotNull()
    new = {
        "quantity_on_hand": quantity.cast("decimal(18,2)"),
        "audit_date": F.to_date(F.lit(as_of)),
    }
    return joined.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in inventory.columns]
    )


def append_daily_insight(spark: SparkSession, inventory: DataFrame, log_path: str, as_of: str) -> None:
    """Add today's figures; a second run on the same day replaces the first."""
    row = schema.conform(daily_insight_row(inventory, as_of), schema.DAILY_INSIGHTS)
    (
        row.withColumn("log_date", F.col("insight_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date")
        .parquet(log_path)
    )
