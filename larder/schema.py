"""Table contracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXT, _DATE, _INT, _DOUBLE = T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType()
_MONEY, _PCT, _DAYS = T.DecimalType(18, 2), T.DecimalType(5, 2), T.DecimalType(10, 2)
_RAW_QTY = T.DecimalType(10, 2)
_TS, _FLAG = T.TimestampNTZType(), T.BooleanType()

# Column names and types of the stock-count file and of the typed table.
_STOCK_COLUMNS = [
    ("sku_id", _TEXT, _TEXT),
    ("sku_name", _TEXT, _TEXT),
    ("category", _TEXT, _TEXT),
    ("abc_class", _TEXT, _TEXT),
    ("supplier_id", _TEXT, _TEXT),
    ("supplier_name", _TEXT, _TEXT),
    ("warehouse_id", _TEXT, _TEXT),
    ("warehouse_location", _TEXT, _TEXT),
    ("batch_id", _TEXT, _TEXT),
    ("received_date", _TEXT, _DATE),
    ("last_purchase_date", _TEXT, _DATE),
    ("expiry_date", _TEXT, _DATE),
    ("audit_date", _TEXT, _DATE),
    ("stock_age_days", _INT, _INT),
    ("quantity_on_hand", _RAW_QTY, _MONEY),
    ("quantity_reserved", _RAW_QTY, _MONEY),
    ("quantity_committed", _RAW_QTY, _MONEY),
    ("damaged_qty", _RAW_QTY, _MONEY),
    ("returns_qty", _RAW_QTY, _MONEY),
    ("avg_daily_sales", _TEXT, _MONEY),
    ("forecast_next_30d", _TEXT, _INT),
    ("days_of_inventory", _TEXT, _MONEY),
    ("sku_churn_rate", _TEXT, _MONEY),
    ("order_frequency_per_month", _TEXT, _MONEY),
    ("reorder_point", _RAW_QTY, _MONEY),
    ("safety_stock", _RAW_QTY, _MONEY),
    ("lead_time_days", _INT, _INT),
    ("unit_cost_usd", _TEXT, _MONEY),
    ("last_purchase_price_usd", _TEXT, _MONEY),
    ("total_inventory_value_usd", _TEXT, _MONEY),
    ("supplier_ontime_pct", _TEXT, _PCT),
    ("fifo_fefo", _TEXT, _TEXT),
    ("inventory_status", _TEXT, _TEXT),
    ("count_variance", _RAW_QTY, _MONEY),
    ("audit_variance_pct", _TEXT, _PCT),
    ("demand_forecast_accuracy_pct", _TEXT, _PCT),
    ("notes", _TEXT, _TEXT),
]

# The file reader keeps every field as text, so that a malformed number reaches the
# tolerant cleaning rules instead of becoming NULL (or an error) inside the parser.
RAW_TEXT = T.StructType([T.StructField(name, _TEXT) for name, _, _ in _STOCK_COLUMNS])
RAW = T.StructType([T.StructField(name, raw) for name, raw, _ in _STOCK_COLUMNS])
INVENTORY = T.StructType([T.StructField(name, clean) for name, _, clean in _STOCK_COLUMNS])

ALERT_HISTORY = T.StructType(
    [
        T.StructField("alert_id", T.LongType()),
        T.StructField("alert_timestamp", _TS),
        T.StructField("sku_id", _TEXT),
        T.StructField("sku_name", _TEXT),
        T.StructField("category", _TEXT),
        T.StructField("location", _TEXT),
        T.StructField("warehouse_id", _TEXT),
        T.StructField("abc_class", _TEXT),
        T.StructField("alert_type", _TEXT),
        T.StructField("priority", _TEXT),
        T.StructField("quantity_on_hand", _MONEY),
        T.StructField("reorder_point", _MONEY),
        T.StructField("safety_stock", _MONEY),
        T.StructField("days_until_stockout", _DAYS),
        T.StructField("resolved", _FLAG),
        T.StructField("resolved_timestamp", _TS),
        T.StructField("resolved_by", _TEXT),
        T.StructField("resolution_notes", _TEXT),
        T.StructField("supplier_name", _TEXT),
        T.StructField("supplier_id", _TEXT),
        T.StructField("lead_time_days", _INT),
        T.StructField("unit_cost_usd", _MONEY),
        T.StructField("estimated_impact_usd", _MONEY),
    ]
)

REORDER_LOG = T.StructType(
    [
        T.StructField("action_id", T.LongType()),
        T.StructField("action_timestamp", _TS),
        T.StructField("sku_id", _TEXT),
        T.StructField("sku_name", _TEXT),
        T.StructField("category", _TEXT),
        T.StructField("location", _TEXT),
        T.StructField("recommended_qty", _MONEY),
        T.StructField("economic_order_qty", _MONEY),
        T.StructField("ordered_qty", _MONEY),
        T.StructField("priority_score", _INT),
        T.StructField("unit_cost_usd", _MONEY),
        T.StructField("total_order_value_usd", _MONEY),
        T.StructField("status", _TEXT),
        T.StructField("order_date", _DATE),
        T.StructField("expected_delivery_date", _DATE),
        T.StructField("actual_delivery_date", _DATE),
        T.StructField("supplier_name", _TEXT),
        T.StructField("supplier_id", _TEXT),
        T.StructField("created_by", _TEXT),
        T.StructField("notes", _TEXT),
    ]
)

EXPORT_LOG = T.StructType(
    [
        T.StructField("export_id", T.LongType()),
        T.StructField("export_timestamp", _TS),
        T.StructField("export_type", _TEXT),
        T.StructField("record_count", T.LongType()),
        T.StructField("exported_by", _TEXT),
        T.StructField("file_format", _TEXT),
        T.StructField("filters_applied", _TEXT),
        T.StructField("notes", _TEXT),
    ]
)

DAILY_INSIGHTS = T.StructType(
    [
        T.StructField("insight_date", _DATE),
        T.StructField("critical_count", T.LongType()),
        T.StructField("total_value", _DOUBLE),
        T.StructField("top_categories", _TEXT),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("snapshot_date", _DATE),
        T.StructField("sku_id", _TEXT),
        T.StructField("item_name", _TEXT),
        T.StructField("location", _TEXT),
        T.StructField("category", _TEXT),
        T.StructField("current_stock", _DOUBLE),
        T.StructField("consumption", _DOUBLE),
        T.StructField("reorder_point", _DOUBLE),
        T.StructField("safety_stock", _DOUBLE),
    ]
)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail while the plan is built when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a contract's order and types; absent columns become NULL."""
    from pyspark.sql import functions as F

    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
