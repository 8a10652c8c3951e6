"""Row-level derived tables: one output row per qualifying inventory row.

Each is a filter plus one projection, so it needs no shuffle, prunes the scan to the
columns named here and pushes the filters down. None of them sorts: order is a matter
for whoever reads (see ``ranking``), not for a table of this size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M
from larder.functions import predicates as P

# bookkeeping of a change row, kept when present (see streaming)
CARRIED = ("change_weight",)
_ITEM = ("sku_id", "sku_name", "category", "location")
_STOCK = ("quantity_on_hand", "quantity_reserved", "quantity_committed")


def _table(rows: DataFrame, stamp: tuple[str, str | None], *columns: str | tuple[str, Column]) -> DataFrame:
    """Project names and (name, builder) pairs; add the run time when one is given."""
    built = [
        F.col("warehouse_location").alias("location")
        if column == "location"
        else F.col(column)
        if isinstance(column, str)
        else column[1].alias(column[0])
        for column in columns
    ]
    built += [F.col(name) for name in CARRIED if name in rows.columns]
    name, at = stamp
    if at is not None:
        built.append(F.lit(at).cast("timestamp_ntz").alias(name))
    return rows.select(*built)


def stock_health_matrix(inventory: DataFrame, stamped_at: str | None = None) -> DataFrame:
    return _table(
        inventory.where(P.is_active()),
        ("last_updated", stamped_at),
        *_ITEM,
        "warehouse_id",
        "abc_class",
        *_STOCK,
        ("available_stock", M.available_stock()),
        "reorder_point",
        "safety_stock",
        "lead_time_days",
        "avg_daily_sales",
        "forecast_next_30d",
        "days_of_inventory",
        ("days_until_stockout", M.days_until_stockout()),
        ("stock_status", M.stock_status()),
        ("stock_level_pct", M.stock_level_pct()),
        ("risk_score", M.risk_score()),
        "unit_cost_usd",
        "total_inventory_value_usd",
        "inventory_status",
        "supplier_name",
        "supplier_id",
        "expiry_date",
        "stock_age_days",
    )


def stock_health(inventory: DataFrame, stamped_at: str | None = None) -> DataFrame:
    return _table(
        inventory.where(P.is_active()),
        ("last_updated", stamped_at),
        *_ITEM,
        "warehouse_id",
        "abc_class",
        *_STOCK,
        ("available_stock", M.available_stock()),
        "reorder_point",
        "safety_stock",
        "lead_time_days",
        "avg_daily_sales",
        "forecast_next_30d",
        ("days_until_stockout", M.days_until_stockout(no_demand=K.NO_DEMAND_DAYS)),
        ("stock_status", M.stock_status()),
        ("risk_score", M.risk_score()),
        "unit_cost_usd",
        "total_inventory_value_usd",
        "supplier_name",
        "supplier_id",
        "supplier_ontime_pct",
    )


def critical_items(inventory: DataFrame, stamped_at: str | None = None) -> DataFrame:
    return _table(
        inventory.where(P.needs_attention() & P.is_active()),
        ("last_updated", stamped_at),
        *_ITEM,
        "abc_class",
        "quantity_on_hand",
        "reorder_point",
        "safety_stock",
        "avg_daily_sales",
        ("days_until_stockout", M.days_until_stockout(no_demand=K.NO_DEMAND_DAYS)),
        ("urgency_level", M.urgency_level()),
        ("stock_status", M.stock_status_basic(above_reorder=K.MODERATE)),
        "lead_time_days",
        "supplier_name",
        "supplier_id",
        "supplier_ontime_pct",
        "unit_cost_usd",
    )


def active_alerts(inventory: DataFrame, as_of: str, stamped: bool = False) -> DataFrame:
    return _table(
        inventory.where(P.needs_attention() & P.is_active()),
        ("alert_generated_at", as_of if stamped else None),
        *_ITEM,
        "abc_class",
        "quantity_on_hand",
        "reorder_point",
        "safety_stock",
        "avg_daily_sales",
        ("alert_type", M.alert_type()),
        ("priority", M.alert_priority()),
        ("days_until_stockout", M.days_until_stockout()),
        "lead_time_days",
        "supplier_name",
        "supplier_id",
        "unit_cost_usd",
        "total_inventory_value_usd",
        ("days_since_last_received", M.days_since("received_date", as_of)),
    )


def reorder_recommendations(inventory: DataFrame, stamped_at: str | None = None) -> DataFrame:
    return _table(
        inventory.where(P.needs_reorder() & P.is_active()),
        ("recommendation_generated_at", stamped_at),
        *_ITEM,
        "warehouse_id",
        "abc_class",
        *_STOCK,
        ("available_stock", M.available_stock()),
        "reorder_point",
        "safety_stock",
        "lead_time_days",
        "avg_daily_sales",
        "forecast_next_30d",
        ("recommended_order_qty", M.recommended_order_qty()),
        ("economic_order_qty", M.economic_order_qty()),
        ("priority_score", M.priority_score()),
        "unit_cost_usd",
        ("estimated_order_value_usd", M.estimated_order_value()),
        "supplier_name",
        "supplier_id",
        "supplier_ontime_pct",
        "days_of_inventory",
        "order_frequency_per_month",
    )


def inventory_context(inventory: DataFrame) -> DataFrame:
    """Compact per-item facts; here the days count on-hand stock, not available stock."""
    return _table(
        inventory.where(P.is_active()),
        ("", None),
        "sku_id",
        "sku_name",
        "category",
        "warehouse_location",
        "abc_class",
        "quantity_on_hand",
        "reorder_point",
        "safety_stock",
        "avg_daily_sales",
        ("days_until_stockout", M.days_until_stockout(M.on_hand(), K.NO_DEMAND_DAYS)),
        ("stock_status", M.stock_status_basic(above_reorder=K.HEALTHY)),
        "unit_cost_usd",
        "total_inventory_value_usd",
        "supplier_name",
        "supplier_ontime_pct",
        "lead_time_days",
    )


def item_scatter(health: DataFrame, color_by: str = "days_until_stockout") -> DataFrame:
    """Chart rows: position, size and colour. Days are capped; any other metric is the risk."""
    color = M.display_days() if color_by == "days_until_stockout" else F.col("risk_score")
    return health.select(
        "location",
        "category",
        "sku_name",
        "quantity_on_hand",
        "days_until_stockout",
        "stock_status",
        "risk_score",
        color.alias("color_value"),
    )
