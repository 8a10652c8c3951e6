from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder import schema
from larder.session import build_session
from larder.sources import derived

SMALL = "/root/testdata/sf0.001"
AS_OF = derived.AS_OF


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inventory(spark):
    """The derived inventory at the smallest scale, written once."""
    from larder.session import scratch_path

    path = scratch_path(spark, "inventory")
    derived.inventory(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


# An unremarkable row; tests change what they are about.
BASE_ROW = {
    "sku_id": "S1", "sku_name": "item", "category": "Tools", "abc_class": "A", "supplier_id": "P1",
    "supplier_name": "supplier", "warehouse_id": "W1", "warehouse_location": "North", "batch_id": "B1",
    "received_date": datetime.date(2001, 7, 1), "last_purchase_date": datetime.date(2001, 6, 1),
    "expiry_date": datetime.date(2002, 1, 1), "audit_date": datetime.date(2001, 7, 31), "stock_age_days": 10,
    "quantity_on_hand": 100, "quantity_reserved": 0, "quantity_committed": 0, "damaged_qty": 0, "returns_qty": 0,
    "avg_daily_sales": 10, "forecast_next_30d": 300, "days_of_inventory": 10, "sku_churn_rate": 1,
    "order_frequency_per_month": 2, "reorder_point": 70, "safety_stock": 20, "lead_time_days": 5,
    "unit_cost_usd": 3, "last_purchase_price_usd": 2, "total_inventory_value_usd": 300, "supplier_ontime_pct": 90,
    "fifo_fefo": "FIFO", "inventory_status": "In Stock", "count_variance": 0, "audit_variance_pct": 0,
    "demand_forecast_accuracy_pct": 80, "notes": None,
}


@pytest.fixture(scope="session")
def rows(spark):
    """Inventory frame from changes to the base row."""
    decimals = {f.name for f in schema.INVENTORY.fields if f.dataType.typeName() == "decimal"}

    def build(*changes: dict):
        data = []
        for change in changes or ({},):
            row = BASE_ROW | change
            data.append(tuple(
                Decimal(str(row[n])) if n in decimals and row[n] is not None else row[n]
                for n in schema.INVENTORY.fieldNames()
            ))
        return spark.createDataFrame(data, schema.INVENTORY)

    return build


@pytest.fixture(scope="session")
def value_of(rows):
    """A metric of one changed row."""

    def compute(column, **change):
        return rows(change).select(F.lit(None) if column is None else column).first()[0]

    return compute
