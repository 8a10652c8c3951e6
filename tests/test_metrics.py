"""Metric builders at their boundaries."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.functions.numeric import ratio, round_to


def each(rows, column, *changes):
    return [r[0] for r in rows(*[c | {"sku_name": f"{i:03d}"} for i, c in enumerate(changes)]).orderBy("sku_name").select(column()).collect()]


def test_round_to_agrees_with_decimal_rounding(spark):
    numbers = [f"{n}.{t}5" for n in range(0, 60) for t in range(10)] + ["1.025", "0.285", "2.675", "64.5", "1.005", "1000000.015"]
    numbers += [f"-{n}" for n in numbers]
    df = spark.createDataFrame([(n, float(n)) for n in numbers], "t string, v double")
    for digits in (0, 1, 2):
        unit = Decimal(1).scaleb(-digits)
        for row in df.select("t", round_to(F.col("v"), digits).alias("r")).collect():
            assert row.r == float(Decimal(row.t).quantize(unit, ROUND_HALF_UP)), (row.t, digits)


def test_round_to_at_any_size(spark):
    cases = [(5e11, 2), (4e13, 2), (1e17, 2), (1e9 + 0.1234567891, 10), (9.3e8, 10), (-5e11, 2), (123456789012.345, 2)]
    for value, digits in cases:
        got = spark.createDataFrame([(value,)], "v double").select(round_to(F.col("v"), digits)).first()[0]
        assert got == float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)), (value, digits)


def test_round_to_keeps_null_and_has_no_negative_zero(spark):
    got = spark.sql("SELECT CAST(NULL AS DOUBLE) AS v UNION ALL SELECT CAST(-0.2 AS DOUBLE)").select(round_to(F.col("v"))).collect()
    assert sorted(str(r[0]) for r in got) == ["0.0", "None"]


def test_ratio_guards_zero(spark):
    row = spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("z"), ratio(F.lit(3), F.lit(2)).alias("q")).first()
    assert (row.z, row.q) == (None, 1.5)


def test_status_boundaries(rows):
    levels = [-1, 0, 0.01, 20, 20.01, 70, 70.01, 105, 105.01]
    changes = [{"quantity_on_hand": q} for q in levels]
    assert each(rows, M.stock_status, *changes) == [
        "OUT_OF_STOCK", "OUT_OF_STOCK", "CRITICAL", "CRITICAL", "LOW", "LOW", "MODERATE", "MODERATE", "HEALTHY",
    ]
    assert each(rows, lambda: M.stock_status_basic(K.MODERATE), *changes)[-2:] == ["MODERATE", "MODERATE"]
    assert each(rows, lambda: M.stock_status_basic(K.HEALTHY), *changes)[-2:] == ["HEALTHY", "HEALTHY"]


def test_days_until_stockout(value_of):
    reserved = {"quantity_reserved": 5, "quantity_committed": 6}
    assert value_of(M.days_until_stockout(), **reserved) == 8.9
    assert value_of(M.days_until_stockout(M.on_hand()), **reserved) == 10.0
    assert value_of(M.days_until_stockout(), avg_daily_sales=0) is None
    assert value_of(M.days_until_stockout(no_demand=999), avg_daily_sales=0) == 999.0
    assert value_of(M.days_until_stockout(), quantity_on_hand=0, quantity_reserved=1, avg_daily_sales=4) == -0.3


def test_risk_score(value_of):
    assert value_of(M.risk_score(), quantity_on_hand=0) == 100.0
    assert value_of(M.risk_score()) == 0.0
    assert value_of(M.risk_score(), quantity_on_hand=35, quantity_reserved=5) == 70.0
    assert value_of(M.risk_score(), quantity_on_hand=400) == -300.0
    assert value_of(M.risk_score(), quantity_on_hand=5, quantity_reserved=50) == 100.0
    assert value_of(M.risk_score(), lead_time_days=0) is None
    assert [value_of(M.risk_score(), avg_daily_sales=0, quantity_on_hand=q) for q in (20, 70, 71)] == [90.0, 70.0, 20.0]


def test_risk_step_and_level(rows, value_of):
    assert each(rows, M.risk_step, *[{"quantity_on_hand": q} for q in (0, 20, 70, 71)]) == [100, 90, 70, 20]
    assert value_of(M.stock_level_pct(), quantity_on_hand=35) == 50.0
    assert value_of(M.stock_level_pct(), reorder_point=0) == 100.0


def test_alert_type_and_priority(rows):
    changes = [
        {"quantity_on_hand": 0}, {"quantity_on_hand": 20}, {"quantity_on_hand": 70},
        {"quantity_on_hand": 90, "avg_daily_sales": 30}, {"quantity_on_hand": 91, "avg_daily_sales": 30},
        {"quantity_on_hand": 90, "avg_daily_sales": 90}, {"quantity_on_hand": 90, "avg_daily_sales": 12},
        {"quantity_on_hand": 90, "avg_daily_sales": 0},
    ]
    assert each(rows, M.alert_type, *changes) == [
        "STOCKOUT", "CRITICAL", "LOW_STOCK", "URGENT", "WARNING", "URGENT", "WARNING", "WARNING",
    ]
    assert each(rows, M.alert_priority, *changes) == [
        "CRITICAL", "HIGH", "MEDIUM", "HIGH", "MEDIUM", "CRITICAL", "LOW", "LOW",
    ]
    assert each(rows, M.urgency_level, *changes) == [
        "IMMEDIATE", "URGENT", "MEDIUM", "URGENT", "LOW", "URGENT", "LOW", "LOW",
    ]


def test_worked_order_quantity(value_of):
    # fixed value: the worked example of the order formula
    example = {"safety_stock": 50, "avg_daily_sales": 10, "lead_time_days": 7, "quantity_on_hand": 30, "reorder_point": 70}
    assert value_of(M.recommended_order_qty(), **example) == 125.0
    assert value_of(M.recommended_order_qty(), **(example | {"quantity_on_hand": 71})) == 0.0
    assert value_of(M.recommended_order_qty(), quantity_on_hand=70, avg_daily_sales=0) == 0.0


def test_order_values_differ_in_clamp_and_rounding(value_of):
    surplus = {"quantity_on_hand": 70, "avg_daily_sales": 0, "safety_stock": 20}
    assert value_of(M.estimated_order_value(), **surplus) == -150.0
    assert value_of(M.total_order_value(), **surplus) == 0.0
    part = {"quantity_on_hand": 20, "avg_daily_sales": 0.25, "lead_time_days": 1, "safety_stock": 30, "unit_cost_usd": 2}
    assert value_of(M.estimated_order_value(), **part) == 20.75
    assert value_of(M.total_order_value(), **part) == 20.0


def test_economic_order_qty(value_of):
    assert value_of(M.economic_order_qty(), avg_daily_sales=6, unit_cost_usd=1) == 60.0
    assert value_of(M.economic_order_qty(), avg_daily_sales=0) == 70.0
    assert value_of(M.economic_order_qty(), unit_cost_usd=0) is None


def test_priority_score(rows, value_of):
    changes = [{"quantity_on_hand": q} for q in (0, 10, 20, 52.5, 70, 71)]
    assert each(rows, M.priority_score, *changes) == [10, 9, 8, 7, 6, 5]
    # fixed value: the worked example of the score
    assert value_of(M.priority_score(), safety_stock=50, reorder_point=100, quantity_on_hand=45) == 8


def test_small_builders(value_of):
    assert value_of(M.stockout_impact()) == 150.0
    assert value_of(M.days_since("received_date", "2001-08-01 00:00:00")) == 31
    assert value_of(M.item_value()) == 300.0
    assert value_of(M.available_stock(), quantity_reserved=3, quantity_committed=4) == Decimal("93.00")


def test_display_days(spark):
    df = spark.createDataFrame([(999.0,), (12.5,), (None,)], "days_until_stockout double")
    assert [r[0] for r in df.select(M.display_days()).collect()] == [60.0, 12.5, None]


def test_ordinal_puts_unknown_last(spark):
    df = spark.createDataFrame([("HIGH",), ("CRITICAL",), ("LOW",), ("?",)], "p string")
    assert [r[0] for r in df.select(M.ordinal("p", K.PRIORITIES)).collect()] == [2, 1, 4, 4]


def test_withdrawn_and_unknown_states_are_dropped(rows):
    states = ["Discontinued", "Obsolete", None, "In Stock", "Expiring"]
    df = rows(*[{"inventory_status": s} for s in states]).where(P.is_active())
    assert sorted(r.inventory_status for r in df.collect()) == ["Expiring", "In Stock"]


def test_needs_attention_includes_seven_days_of_cover(rows):
    df = rows({"quantity_on_hand": 210, "avg_daily_sales": 30}, {"quantity_on_hand": 211, "avg_daily_sales": 30}, {"quantity_on_hand": 70, "avg_daily_sales": 0})
    assert sorted(float(r.quantity_on_hand) for r in df.where(P.needs_attention()).collect()) == [70.0, 210.0]


def test_name_search_is_literal_and_skips_null(spark):
    df = spark.createDataFrame([("Small Ring",), ("a.b",), ("axb",), (None,)], "n string")
    assert [r.n for r in df.where(P.name_contains("n", "RING")).collect()] == ["Small Ring"]
    assert [r.n for r in df.where(P.name_contains("n", "a.b")).collect()] == ["a.b"]


@pytest.mark.parametrize(("sold", "expected"), [(10, 100.0), (0, 100.0)])
def test_projection_of_expected_demand(rows, sold, expected):
    from larder.operators import items, projection

    row = projection.stock_projection(items.stock_health(rows({"avg_daily_sales": sold}))).first()
    assert row.current_stock == expected
    assert row.predicted_consumption == (sold or 1)
    assert row.predicted_stock == max(0, 100 - 14 * (sold or 1))
    assert row.stockout_risk == ("MODERATE RISK" if sold else "LOW RISK")
    assert 60 <= row.model_accuracy <= 95
