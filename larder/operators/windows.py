"""Change anomalies, demand volatility and latest-row operators.

The order within an item is (audit date, digest of the row's identifying fields, the other
columns in use): total and reproducible, where audit date alone leaves rows of one day in any order.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.functions.numeric import as_double, ladder, ratio, round_to
from larder.operators import skew

TIE_COLUMNS = ("batch_id", "supplier_id", "warehouse_location", "quantity_on_hand", "total_inventory_value_usd")


def _settled(value: Column) -> Column:
    """Ten decimals: a deviation's last bits must not decide which side of a limit it is on."""
    return round_to(value, 10)


def _recent(inventory: DataFrame, as_of: str, lookback_days: int, *columns: str) -> DataFrame:
    rows = inventory.where(P.within_days("audit_date", as_of, lookback_days))
    return rows.select("sku_id", "audit_date", skew.row_digest(*TIE_COLUMNS).alias("tie"), *columns)


def _changes(inventory: DataFrame, as_of: str, lookback_days: int, rows_per_task: int, *columns: str) -> skew.Parts:
    def step(rows: DataFrame, order: WindowSpec) -> DataFrame:
        return rows.withColumn("prev_qty", F.lag("quantity_on_hand").over(order)).withColumn(
            "qty_change", F.col("quantity_on_hand") - F.col("prev_qty")
        )

    recent = _recent(inventory, as_of, lookback_days, "quantity_on_hand", *columns)
    return skew.windowed(recent, "sku_id", "audit_date", "tie", 1, rows_per_task).compute(step)


def audit_changes(
    inventory: DataFrame,
    as_of: str,
    lookback_days: int = K.LOOKBACK_DAYS,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """On-hand stock against the item's previous audit row."""
    rows = _changes(inventory, as_of, lookback_days, rows_per_task, "warehouse_location").repeated()
    return rows.drop("tie").withColumns({"prev_qty": as_double("prev_qty"), "qty_change": as_double("qty_change")})


def _moments() -> dict[str, Column]:
    """What an item's changes add up to: exact, so that they merge to the same bits in any order."""
    change, weight = F.col("qty_change").cast("decimal(16,2)"), F.col(skew.WEIGHT)
    return {
        "_n": F.sum(weight),
        "_total": F.sum(change * weight),
        "_squares": F.sum(change * change * weight),
        "_least": F.min(change),
        "_most": F.max(change),
    }


def _mean_and_spread() -> tuple[Column, Column]:
    """Mean and sample deviation from the moments.

    The difference of squares is taken in decimals, where nothing cancels, unless it needs
    more digits than they have; changes that are all the same have no deviation.
    """
    n, total, squares = as_double("_n"), as_double("_total"), as_double("_squares")
    whole_n = F.col("_n").cast("decimal(18,0)")
    exact = F.try_subtract(F.try_multiply(whole_n, F.col("_squares")), F.try_multiply(F.col("_total"), F.col("_total")))
    scatter = F.coalesce(as_double(exact), n * squares - total * total)
    variance = F.greatest(F.lit(0.0), ratio(scatter, n * (n - 1)))
    same = F.col("_least") == F.col("_most")
    return ratio(total, n), F.when(n > 1, F.when(same, F.lit(0.0)).otherwise(F.sqrt(variance)))


def _with_item_statistics(changes: skew.Parts) -> skew.Parts:
    """Mean and sample deviation of the change per item, on every row, by one formula.

    A whole item's moments are summed where its rows already are. Those of items in slices
    combine map-side and are joined back; Spark picks the join by size and splits hot keys.
    """
    whole_item = Window.partitionBy("sku_id")
    whole = changes.whole.withColumns({name: m.over(whole_item) for name, m in _moments().items()})
    per_item = changes.cut.groupBy(F.col("sku_id").alias("_sku")).agg(*[m.alias(n) for n, m in _moments().items()])
    cut = changes.cut.join(per_item, F.col("sku_id").eqNullSafe(F.col("_sku"))).drop("_sku")
    mean, spread = _mean_and_spread()

    def described(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"mean_change": mean, "stddev_change": spread}).drop(*_moments())

    return replace(changes, whole=described(whole), cut=described(cut))


def _scored(inventory: DataFrame, as_of: str, lookback_days: int, rows_per_task: int) -> skew.Parts:
    """Every change with its item's mean, deviation and z-score."""
    changes = _changes(inventory, as_of, lookback_days, rows_per_task, "sku_name", "category", "warehouse_location")
    score = ratio(as_double("qty_change") - F.col("mean_change"), F.col("stddev_change"))
    known = changes.filtered(F.col("qty_change").isNotNull())
    return _with_item_statistics(known).with_column("z_score", _settled(score))


def change_statistics(
    inventory: DataFrame,
    as_of: str,
    lookback_days: int = K.LOOKBACK_DAYS,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """All changes, usual or not, beside the statistics of their item."""
    return _scored(inventory, as_of, lookback_days, rows_per_task).repeated().select(
        "sku_id",
        "audit_date",
        as_double("qty_change").alias("qty_change"),
        *[round_to(F.col(c), 4).alias(c) for c in ("mean_change", "stddev_change", "z_score")],
    )


def inventory_anomalies(
    inventory: DataFrame,
    as_of: str,
    lookback_days: int = K.LOOKBACK_DAYS,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Changes more than two deviations from the item's mean.

    An item whose changes never vary has no z-score and is left out.
    """
    z = F.abs("z_score")
    severe, moderate, normal = K.ANOMALY_SEVERITIES
    rise, fall = K.CHANGE_TEXT
    unusual = _scored(inventory, as_of, lookback_days, rows_per_task).filtered(z > K.Z_MODERATE)
    return unusual.repeated().select(
        "sku_id",
        "sku_name",
        "category",
        "warehouse_location",
        "audit_date",
        as_double("qty_change").alias("qty_change"),
        round_to(F.col("mean_change"), 2).alias("avg_change"),
        round_to(F.col("stddev_change"), 2).alias("stddev"),
        ladder((z > K.Z_SEVERE, severe), (z > K.Z_MODERATE, moderate), default=normal).alias("anomaly_severity"),
        F.when(F.col("qty_change") > 0, rise).otherwise(fall).alias("anomaly_type"),
        round_to(F.col("z_score"), 2).alias("z_score"),
    )


_FORECAST_GROUP = (
    "sku_id", "sku_name", "category", "warehouse_location", "abc_class",
    "quantity_on_hand", "reorder_point", "safety_stock",
)


def _trailing(inventory: DataFrame, as_of: str, lookback_days: int, rows_per_task: int, *columns: str) -> skew.Parts:
    def step(rows: DataFrame, order: WindowSpec) -> DataFrame:
        trailing = order.rowsBetween(1 - K.TRAILING_ROWS, Window.currentRow)
        sales = as_double("avg_daily_sales")
        return rows.withColumns(
            {"moving_avg_30d": F.avg(sales).over(trailing), "demand_volatility": F.stddev_samp(sales).over(trailing)}
        )

    recent = _recent(inventory, as_of, lookback_days, *columns)
    return skew.windowed(recent, "sku_id", "audit_date", "tie", K.TRAILING_ROWS - 1, rows_per_task).compute(step)


def trailing_demand(
    inventory: DataFrame,
    as_of: str,
    lookback_days: int = K.LOOKBACK_DAYS,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Mean and deviation of daily sales over the last 30 audit rows of the item."""
    rows = _trailing(inventory, as_of, lookback_days, rows_per_task, "avg_daily_sales", "warehouse_location").repeated()
    return rows.drop("tie").withColumns(
        {
            "avg_daily_sales": as_double("avg_daily_sales"),
            "moving_avg_30d": round_to(F.col("moving_avg_30d"), 4),
            "demand_volatility": round_to(F.col("demand_volatility"), 4),
        }
    )


def demand_forecast(
    inventory: DataFrame,
    as_of: str,
    lookback_days: int = K.LOOKBACK_DAYS,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Demand, volatility, confidence and advice per item, place and stock level.

    The grouping has three keys that are not shown, so equal rows can appear; the final
    ``distinct`` folds them.
    """
    rows = _trailing(
        inventory, as_of, lookback_days, rows_per_task,
        *_FORECAST_GROUP[1:], "avg_daily_sales", "forecast_next_30d",
    ).weighted()
    grouped = rows.groupBy(*_FORECAST_GROUP).agg(
        skew.weighted_mean("avg_daily_sales").alias("demand"),
        skew.weighted_mean("demand_volatility").alias("spread"),
        F.max("forecast_next_30d").alias("forecast_30d"),
    )
    variation = _settled(ratio(F.col("spread"), F.col("demand")))
    high, medium, low = K.CONFIDENCES
    risk = K.RISK_CLASSES
    advice = K.DEMAND_ADVICE
    return grouped.select(
        *_FORECAST_GROUP[:5],
        round_to(F.col("demand"), 2).alias("avg_daily_demand"),
        round_to(F.col("spread"), 2).alias("volatility"),
        "forecast_30d",
        ladder(
            (variation < K.CV_HIGH_CONFIDENCE, high), (variation < K.CV_MEDIUM_CONFIDENCE, medium), default=low
        ).alias("forecast_confidence"),
        ladder((M.at_safety(), risk[0]), (M.at_reorder(), risk[1]), default=risk[2]).alias("stockout_risk"),
        ladder((M.at_safety(), advice[0]), (M.at_reorder(), advice[1]), default=advice[2]).alias("recommendation"),
    ).distinct()


def latest_by_location_category(snapshots: DataFrame) -> DataFrame:
    """The last snapshot row of every location and category.

    ``max`` of a struct combines map-side, so no group is ever sorted or gathered.
    """
    rest = [n for n in snapshots.columns if n not in ("location", "category", "snapshot_date")]
    last = F.max(F.struct("snapshot_date", *rest)).alias("last")
    return snapshots.groupBy("location", "category").agg(last).select("location", "category", "last.*")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    newest = snapshots.agg(F.max("snapshot_date")).scalar()
    return snapshots.where(F.col("snapshot_date") == newest)
