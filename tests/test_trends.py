"""Counts and means of the latest snapshot against plain Python."""

from __future__ import annotations

import datetime

from larder.operators import trends
from tests.test_plans import plan

DAY = datetime.date(2001, 7, 31)
COLUMNS = (
    "item_name string, location string, snapshot_date date, category string, "
    "current_stock decimal(18,2), reorder_point decimal(18,2), safety_stock decimal(18,2)"
)


def _snapshots(spark, rows):
    from decimal import Decimal

    data = [(i, p, d, "Tools", Decimal(s), Decimal(r), Decimal(1)) for i, p, d, s, r in rows]
    return spark.createDataFrame(data, COLUMNS)


def test_summary_counts_each_item_and_place_once(spark):
    before = DAY - datetime.timedelta(1)
    rows = [
        ("a", "North", DAY, 5, 10), ("a", "South", DAY, 20, 10), ("a", "South", DAY, 20, 10), ("b", "South", DAY, 1, 0),
        (None, "West", DAY, 30, 10), ("c", None, DAY, 10, 10), ("gone", "East", before, 1, 10),
    ]
    row = trends.trend_summary(_snapshots(spark, rows)).first()
    # a reorder point of 0 has no level
    assert (row.unique_items, row.locations) == (3, 3)
    assert row.avg_stock_pct == round((50 + 200 + 200 + 300 + 100) / 5, 1)


def test_summary_of_nothing(spark):
    row = trends.trend_summary(_snapshots(spark, [])).first()
    assert tuple(row) == (0, 0, None, 0)


def test_summary_copies_no_rows(spark):
    assert "Expand" not in plan(trends.trend_summary(_snapshots(spark, [("a", "North", DAY, 5, 10)])))
