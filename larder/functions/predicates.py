"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M


def is_active() -> Column:
    """Not withdrawn. A NULL state makes the test unknown, so that row is dropped too."""
    return ~F.col("inventory_status").isin(*K.INACTIVE_STATES)


def needs_attention() -> Column:
    return M.at_reorder() | M.covered_at_most(K.COVER_DAYS_ATTENTION)


def needs_reorder() -> Column:
    return M.at_reorder()


def within_days(column: str, as_of: str, days: int) -> Column:
    return F.col(column) >= F.date_sub(F.to_date(F.lit(as_of)), days)


def name_contains(column: str, text: str) -> Column:
    """Case-blind literal search; a NULL name never matches."""
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lit(text.lower())), F.lit(False))


def one_of(column: str, values: Iterable[str]) -> Column:
    return F.col(column).isin(*values)


def at_risk(floor: int = K.RISK_ALERT_FLOOR) -> Column:
    return F.col("risk_score") >= floor


def slice_by(
    df: DataFrame,
    location: str | None = None,
    category: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Optional equality filters; None or "All" leaves a dimension open."""
    chosen = {"location": location, "category": category, "stock_status": status}
    for column, value in chosen.items():
        if value not in (None, "All") and column in df.columns:
            df = df.where(F.col(column) == value)
    return df
