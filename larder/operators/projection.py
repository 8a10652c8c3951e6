"""Stock projection over a horizon, and the figures drawn from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions.numeric import as_double, ladder, round_to
from larder.functions.predicates import one_of


def _stock() -> Column:
    return as_double("quantity_on_hand")


def _demand() -> Column:
    """Daily sales; an item without sales is projected at one unit a day."""
    sales = as_double("avg_daily_sales")
    return F.when(sales <= 0, F.lit(1.0)).otherwise(sales)


def _volatility() -> Column:
    low, high = K.VOLATILITY_RANGE
    return F.least(F.lit(high), F.greatest(F.lit(low), _stock() / (_demand() * 30) * K.VOLATILITY_SCALE))


def _accuracy() -> Column:
    low, high = K.ACCURACY_RANGE
    short = F.when(_stock() < as_double("safety_stock"), K.ACCURACY_LOW_STOCK_PENALTY).otherwise(0)
    raw = K.ACCURACY_BASE - _volatility() * K.ACCURACY_VOLATILITY_PENALTY - short
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), raw))


def _project(health: DataFrame, horizon: int, daily: Column) -> DataFrame:
    """Projection columns for a daily demand (expected or sampled)."""
    rows = health.withColumn("predicted_consumption", daily)
    used = F.col("predicted_consumption")
    days = F.when(used > 0, _stock() / used).otherwise(F.lit(float(K.NO_DEMAND_DAYS)))
    soon, later = K.PROJECTION_RISK_DAYS
    high, moderate, low = K.RISK_CLASSES
    return rows.select(
        F.col("sku_name").alias("item_name"),
        "sku_id",
        "location",
        "category",
        _stock().alias("current_stock"),
        F.greatest(F.lit(0.0), _stock() - used * horizon).alias("predicted_stock"),
        "predicted_consumption",
        days.alias("predicted_days_to_stockout"),
        _accuracy().alias("model_accuracy"),
        F.lit(horizon).alias("forecast_horizon_days"),
        (used * (1 - K.BAND_SHARE)).alias("confidence_interval_lower"),
        (used * (1 + K.BAND_SHARE)).alias("confidence_interval_upper"),
        ladder((days < soon, high), (days < later, moderate), default=low).alias("stockout_risk"),
        _volatility().alias("demand_volatility"),
    )


def stock_projection(health: DataFrame, horizon: int = K.HORIZON_DAYS) -> DataFrame:
    """Projection at expected demand: one narrow projection, the same on every run.

    The "95 %" band is a fixed share of demand, not a statistical interval.
    """
    return _project(health, horizon, _demand())


def projection_compare(projection: DataFrame, items: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Current against predicted stock, for chosen item names or for all.

    A few names are a filter; a long choice comes as a one-column frame, which Spark
    broadcasts only while it is small.
    """
    if isinstance(items, DataFrame):
        projection = projection.join(items, "item_name", "left_semi")
    elif items is not None:
        projection = projection.where(one_of("item_name", items))
    return projection.select("item_name", "location", "current_stock", "predicted_stock")


def forecast_risk_by(projection: DataFrame, dimension: str) -> DataFrame:
    return projection.groupBy(dimension, "stockout_risk").agg(F.count(F.lit(1)).alias("item_count"))


def forecast_summary(projection: DataFrame) -> DataFrame:
    counts = [
        F.count_if(F.col("stockout_risk") == label).alias(label.lower().replace(" ", "_"))
        for label in K.RISK_CLASSES
    ]
    return projection.agg(*counts, round_to(F.avg("model_accuracy"), 1).alias("avg_accuracy"))


def accuracy_by_category(projection: DataFrame) -> DataFrame:
    return projection.groupBy("category").agg(round_to(F.avg("model_accuracy"), 4).alias("avg_accuracy"))


def accuracy_histogram(projection: DataFrame, bins: int = K.ACCURACY_BINS) -> DataFrame:
    """Item count per equal-width accuracy bin; the top edge belongs to the last bin."""
    low, high = K.ACCURACY_RANGE
    place = F.width_bucket("model_accuracy", F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    counted = projection.groupBy(F.least(F.lit(bins), place).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("item_count")
    )
    width = (high - low) / bins
    return counted.select("bin", (low + (F.col("bin") - 1) * width).alias("bin_start"), "item_count")
