"""Raw stock counts to the typed inventory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import schema
from larder.functions import cleaning as C

KEY = ("sku_id", "batch_id")

# which rule cleans which column
_RULES = {
    C.identifier: ("sku_id", "supplier_id", "warehouse_id", "batch_id"),
    C.trimmed: ("sku_name", "supplier_name", "warehouse_location"),
    C.title_case: ("category", "inventory_status"),
    C.abc_class: ("abc_class",),
    C.iso_date: ("received_date", "last_purchase_date", "expiry_date", "audit_date"),
    C.whole: ("stock_age_days",),
    C.quantity: (
        "quantity_on_hand",
        "quantity_reserved",
        "quantity_committed",
        "damaged_qty",
        "returns_qty",
        "avg_daily_sales",
        "days_of_inventory",
        "sku_churn_rate",
        "order_frequency_per_month",
        "reorder_point",
        "safety_stock",
    ),
    C.money: ("unit_cost_usd", "last_purchase_price_usd", "total_inventory_value_usd"),
    C.percent: ("supplier_ontime_pct", "audit_variance_pct", "demand_forecast_accuracy_pct"),
    C.signed_quantity: ("count_variance",),
    C.whole_floored: ("lead_time_days",),
    C.stock_policy: ("fifo_fefo",),
    C.note: ("notes",),
}


def _cleaned() -> dict[str, Column]:
    built = {name: rule(name) for rule, names in _RULES.items() for name in names}
    built["forecast_next_30d"] = C.whole_floored("forecast_next_30d", strip=",")
    return built


def _has_key() -> Column:
    first, second = (F.col(name).isNotNull() for name in KEY)
    return first & second


def clean_inventory(raw: DataFrame) -> DataFrame:
    """One projection over the keyed rows; a narrow plan without any shuffle."""
    columns = schema.INVENTORY.fieldNames()
    built = _cleaned()
    keyed = schema.require(raw, columns).where(_has_key())
    return keyed.select(*[built[name].alias(name) for name in columns])


def rejected_rows(raw: DataFrame) -> DataFrame:
    """The rows ``clean_inventory`` leaves out, as they came, with the reason."""
    reason = F.when(F.col("sku_id").isNull(), "no sku_id").otherwise("no batch_id")
    return raw.where(~_has_key()).withColumn("reject_reason", reason)
