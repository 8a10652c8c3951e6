"""Distinct counts next to sums against plain sets, with nulls, repeated rows and empty tables."""

from __future__ import annotations

import random

import pytest

from larder.operators import items, rollups, summaries

NAMES = [None, "a", "b", "c"]


@pytest.fixture(scope="module")
def stock(rows):
    rng = random.Random(5)
    made = [
        {
            "sku_id": rng.choice([None, *(f"S{k}" for k in range(9))]),
            "warehouse_location": rng.choice(NAMES), "category": rng.choice(NAMES), "warehouse_id": rng.choice(NAMES),
            "abc_class": rng.choice("ABC"), "quantity_on_hand": rng.choice([0, 15, 60, 100]),
        }
        for _ in range(120)
    ]
    return rows(*made, *made[:30]), made + made[:30]


def test_table_size_counts_null_as_a_value(stock):
    df, made = stock
    got = rollups.overview_counts(df).first()
    wanted = [len(made), *[len({r[c] for r in made}) for c in ("warehouse_location", "category", "sku_id")]]
    assert list(got) == wanted


def test_derived_table_sizes(stock):
    df, made = stock
    got = {r["table_name"]: r["row_count"] for r in rollups.table_row_counts(df).collect()}
    assert got["stock_health"] == len(made)
    assert got["location_performance"] == len({(r["warehouse_location"], r["warehouse_id"]) for r in made})
    assert got["category_heatmap"] == len({(r["warehouse_location"], r["category"]) for r in made})
    assert got["active_alerts"] == items.active_alerts(df, "2001-08-01 00:00:00").count()


def test_overview_leaves_null_out_of_distinct_counts(stock):
    df, made = stock
    got = summaries.inventory_summary(items.stock_health(df)).first()
    for alias, column in (("total_items", "sku_id"), ("total_locations", "warehouse_location"), ("total_categories", "category")):
        assert got[alias] == len({r[column] for r in made} - {None}), alias


def test_insight_equals_its_parts(stock):
    df, _ = stock
    health = items.stock_health(df)
    got = summaries.insight_context(df).first().asDict(recursive=True)
    assert got["overview"] == summaries.inventory_summary(health).first().asDict()
    assert got["reorders"] == summaries.reorder_stats(items.reorder_recommendations(df)).first().asDict()
    for part, table, key in (
        ("abc_classes", summaries.abc_summary(health), "abc_class"),
        ("locations", summaries.location_breakdown(health), "location"),
        ("categories", summaries.category_breakdown(health), "category"),
    ):
        wanted = [r.asDict() for r in table.collect()]
        wanted.sort(key=lambda r: (-r.get("critical", 0), r[key] is None, r[key] or ""))
        assert got[part] == wanted, part
    assert len(got["top_items"]) == 10


def test_empty_tables(rows):
    empty = rows().limit(0)
    assert list(rollups.overview_counts(empty).first()) == [0, 0, 0, 0]
    assert {r["row_count"] for r in rollups.table_row_counts(empty).collect()} == {0}
    got = summaries.insight_context(empty).first().asDict(recursive=True)
    assert got["overview"] == summaries.inventory_summary(items.stock_health(empty)).first().asDict()
    assert got["reorders"] == {"items_to_reorder": 0, "urgent_items": 0, "total_order_value": 0.0}
    assert [got[p] for p in ("abc_classes", "locations", "categories", "top_items")] == [[], [], [], []]
    assert {s["count"] for s in got["statuses"]} == {0}
