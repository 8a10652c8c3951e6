"""Snapshot series and the trend figures over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.functions.numeric import as_double, exact_sum, mean, ratio, round_to
from larder.operators.windows import latest_by_location_category, latest_snapshot


def snapshot_history(inventory: DataFrame) -> DataFrame:
    """Dated stock per item, from the real audit rows."""
    return inventory.where(P.is_active()).select(
        F.col("audit_date").alias("snapshot_date"),
        "sku_id",
        F.col("sku_name").alias("item_name"),
        F.col("warehouse_location").alias("location"),
        "category",
        as_double("quantity_on_hand").alias("current_stock"),
        as_double("avg_daily_sales").alias("consumption"),
        as_double("reorder_point").alias("reorder_point"),
        as_double("safety_stock").alias("safety_stock"),
    )


def trend_by_category(snapshots: DataFrame, measure: str, as_of: str, days: int = K.HISTORY_DAYS) -> DataFrame:
    """Daily total of ``current_stock`` or ``consumption`` per category."""
    recent = snapshots.where(P.within_days("snapshot_date", as_of, days))
    return recent.groupBy("snapshot_date", "category").agg(exact_sum(F.col(measure), 2).alias(measure))


def stock_by_location(snapshots: DataFrame) -> DataFrame:
    totals = snapshots.groupBy("location").agg(exact_sum(F.col("current_stock"), 2).alias("current_stock"))
    return totals.orderBy(F.asc("current_stock"), "location")


def status_by_location(snapshots: DataFrame) -> DataFrame:
    latest = latest_by_location_category(snapshots).withColumn("stock_status", M.trend_status())
    return latest.groupBy("location", "stock_status").agg(F.count(F.lit(1)).alias("item_count"))


def _level() -> Column:
    """Stock in percent of the reorder point, as a decimal: sums do not depend on row order."""
    return (ratio(F.col("current_stock"), F.col("reorder_point")) * 100).cast("decimal(28,6)")


def item_snapshot_stats(snapshots: DataFrame, item: str | None = None) -> DataFrame:
    """Stock, level and trouble spots per item in the latest snapshot."""
    latest = latest_snapshot(snapshots)
    if item is not None:
        latest = latest.where(F.col("item_name") == item)
    return latest.groupBy("item_name").agg(
        F.sum("current_stock").alias("total_stock"),
        round_to(mean(_level()), 1).alias("avg_stock_pct"),
        F.count_if(F.col("current_stock") <= F.col("safety_stock")).alias("critical_locations"),
    )


def item_stock_by_location(snapshots: DataFrame, item: str | None = None) -> DataFrame:
    latest = latest_snapshot(snapshots)
    if item is not None:
        latest = latest.where(F.col("item_name") == item)
    return latest.select("item_name", "location", "current_stock", "reorder_point")


def trend_summary(snapshots: DataFrame) -> DataFrame:
    """Items, places, level and needs of the latest snapshot in one row.

    Rows fold to one cell per item and place. An item counts at its first place alone, so
    both distinct counts come from sums over the places and no row is copied.
    """
    below = F.col("current_stock") < F.col("reorder_point") * K.RESTOCK_SHARE
    cells = latest_snapshot(snapshots).groupBy("item_name", "location").agg(
        F.sum(_level()).alias("level"), F.count(_level()).alias("levels"), F.count_if(below).alias("needy")
    )
    first_place = F.row_number().over(Window.partitionBy("item_name").orderBy("location")) == 1
    places = cells.withColumn("first", first_place & F.col("item_name").isNotNull()).groupBy("location").agg(
        F.count_if("first").alias("items"), *[F.sum(n).alias(n) for n in ("level", "levels", "needy")]
    )
    return places.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("unique_items"),
        F.count("location").alias("locations"),
        round_to(ratio(F.sum("level"), F.sum("levels")), 1).alias("avg_stock_pct"),
        F.coalesce(F.sum("needy"), F.lit(0)).alias("items_needing_restock"),
    )
