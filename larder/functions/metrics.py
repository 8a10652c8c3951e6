"""Per-row stock metrics over the typed inventory columns.

Every builder returns a Column and touches no DataFrame, so one table can use many of
them in a single projection and Catalyst shares the common parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions.numeric import as_double, ladder, ratio, round_to

def on_hand() -> Column:
    return F.col("quantity_on_hand")


def reorder_point() -> Column:
    return F.col("reorder_point")


def safety_stock() -> Column:
    return F.col("safety_stock")


def daily_sales() -> Column:
    return F.col("avg_daily_sales")


def lead_days() -> Column:
    return F.col("lead_time_days")


def unit_cost() -> Column:
    return F.col("unit_cost_usd")


def is_empty() -> Column:
    return on_hand() <= 0


def at_safety() -> Column:
    return on_hand() <= safety_stock()


def at_reorder() -> Column:
    return on_hand() <= reorder_point()


def has_demand() -> Column:
    return daily_sales() > 0


def available_stock() -> Column:
    return (on_hand() - F.col("quantity_reserved") - F.col("quantity_committed")).cast("decimal(18,2)")


def covered_at_most(days: int) -> Column:
    """On-hand stock lasts at most ``days``; written without a division so it stays exact."""
    return has_demand() & (on_hand() <= daily_sales() * F.lit(days))


def days_until_stockout(stock: Column | None = None, no_demand: int | None = None) -> Column:
    stock = available_stock() if stock is None else stock
    return F.when(has_demand(), round_to(ratio(stock, daily_sales()), 1)).otherwise(
        F.lit(no_demand).cast("double")
    )


def stock_status() -> Column:
    return ladder(
        (is_empty(), K.OUT_OF_STOCK),
        (at_safety(), K.CRITICAL),
        (at_reorder(), K.LOW),
        (on_hand() <= reorder_point() * F.lit(K.MODERATE_FACTOR), K.MODERATE),
        default=K.HEALTHY,
    )


def stock_status_basic(above_reorder: str) -> Column:
    """Four-way status; whatever lies above the reorder point gets one label."""
    return ladder(
        (is_empty(), K.OUT_OF_STOCK),
        (at_safety(), K.CRITICAL),
        (at_reorder(), K.LOW),
        default=above_reorder,
    )


def half_reorder_status() -> Column:
    """Three-way status by the reorder point alone, both bounds exclusive."""
    return ladder(
        (on_hand() < reorder_point() * F.lit(K.HALF_REORDER), K.CRITICAL),
        (on_hand() < reorder_point(), K.LOW),
        default=K.HEALTHY,
    )


def trend_status(stock: str = "current_stock") -> Column:
    """Three-way status of a snapshot row."""
    return ladder(
        (F.col(stock) <= safety_stock(), K.CRITICAL),
        (F.col(stock) <= reorder_point(), K.LOW),
        default=K.HEALTHY,
    )


def stock_level_pct() -> Column:
    return F.when(reorder_point() > 0, round_to(ratio(on_hand(), reorder_point()) * 100, 1)).otherwise(F.lit(100.0))


def risk_score() -> Column:
    """100 when empty; otherwise the uncovered share of twice the lead-time demand.

    Not clamped below: well stocked items go negative. A zero lead time leaves the
    score unknown, and ``least`` must not turn that NULL into 100.
    """
    demand = as_double(daily_sales()) * as_double(lead_days()) * 2
    uncovered = round_to((1 - ratio(on_hand() - F.col("quantity_reserved"), demand)) * 100)
    full, high, raised, calm = (F.lit(float(step)) for step in K.RISK_STEPS)
    return ladder(
        (is_empty(), full),
        (has_demand(), F.when(uncovered.isNotNull(), F.least(F.lit(100.0), uncovered))),
        (at_safety(), high),
        (at_reorder(), raised),
        default=calm,
    )


def risk_step() -> Column:
    full, high, raised, calm = K.RISK_STEPS
    return ladder((is_empty(), full), (at_safety(), high), (at_reorder(), raised), default=calm)


def alert_type() -> Column:
    stockout, critical, low, urgent, warning = K.ALERT_TYPES
    return ladder(
        (is_empty(), stockout),
        (at_safety(), critical),
        (at_reorder(), low),
        (covered_at_most(K.COVER_DAYS_URGENT), urgent),
        default=warning,
    )


def alert_priority() -> Column:
    critical, high, medium, low = K.PRIORITIES
    return ladder(
        (is_empty() | covered_at_most(K.COVER_DAYS_IMMEDIATE), critical),
        (at_safety() | covered_at_most(K.COVER_DAYS_URGENT), high),
        (at_reorder() | covered_at_most(K.COVER_DAYS_ATTENTION), medium),
        default=low,
    )


def urgency_level() -> Column:
    immediate, urgent, high, medium, low = K.URGENCIES
    return ladder(
        (is_empty(), immediate),
        (covered_at_most(K.COVER_DAYS_URGENT), urgent),
        (at_safety(), high),
        (at_reorder(), medium),
        default=low,
    )


def _shortfall() -> Column:
    """Units missing against safety stock plus buffered lead-time demand; may be negative."""
    buffered = as_double(daily_sales()) * as_double(lead_days()) * K.LEAD_BUFFER
    return as_double(safety_stock()) + buffered - as_double(available_stock())


def recommended_order_qty() -> Column:
    units = round_to(_shortfall())
    return F.when(at_reorder(), F.when(units.isNotNull(), F.greatest(F.lit(0.0), units))).otherwise(
        F.lit(0.0)
    )


def economic_order_qty() -> Column:
    demand = as_double(daily_sales()) * 2 * K.EOQ_DAYS * K.EOQ_ORDER_COST
    return F.when(has_demand(), round_to(F.sqrt(ratio(demand, unit_cost())))).otherwise(as_double(reorder_point()))


def priority_score() -> Column:
    empty, half_safety, safety, near, reorder, calm = K.PRIORITY_SCORES
    return ladder(
        (is_empty(), empty),
        (on_hand() <= safety_stock() * F.lit(K.PRIORITY_SAFETY_SHARE), half_safety),
        (at_safety(), safety),
        (on_hand() <= reorder_point() * F.lit(K.PRIORITY_REORDER_SHARE), near),
        (at_reorder(), reorder),
        default=calm,
    )


def estimated_order_value() -> Column:
    """Value of the raw shortfall: neither clamped at 0 nor rounded to whole units."""
    return F.when(at_reorder(), round_to(_shortfall() * as_double(unit_cost()), 2)).otherwise(F.lit(0.0))


def total_order_value() -> Column:
    """Value of the whole units that would be ordered."""
    return round_to(recommended_order_qty() * as_double(unit_cost()), 2)


def stockout_impact() -> Column:
    return round_to(as_double(daily_sales()) * as_double(lead_days()) * as_double(unit_cost()), 2)


def days_since(column: str, as_of: str) -> Column:
    return F.datediff(F.to_date(F.lit(as_of)), F.col(column))


def item_value() -> Column:
    return round_to(as_double(on_hand()) * as_double(unit_cost()), 2)


def display_days(days: str = "days_until_stockout") -> Column:
    """Days capped for a colour scale; unknown stays unknown."""
    return F.when(F.col(days).isNotNull(), F.least(F.col(days), F.lit(float(K.DISPLAY_DAYS_CAP))))


def ordinal(column: str, labels: tuple[str, ...]) -> Column:
    """Position of a label in its severity order; unknown labels come last."""
    *known, _ = labels
    return ladder(
        *[(F.col(column) == label, place) for place, label in enumerate(known, 1)],
        default=len(labels),
    )
