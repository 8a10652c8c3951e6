"""Scorecards by location, category and class over the typed inventory.

A distinct count next to other measures is computed in two levels: first one row per
(group, sku) with summed measures, which combines map-side, then the groups. Several
conditional distinct counts thus cost one shuffle of pre-aggregated rows; stating them
as ``count(distinct case ...)`` would make Spark copy every row once per count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.functions.numeric import as_double, count_when, ladder, ratio, round_to
from larder.operators.distinct import is_first


def located(inventory: DataFrame) -> DataFrame:
    """Active rows with their location under its short name."""
    return inventory.where(P.is_active()).withColumn("location", F.col("warehouse_location"))


def _between_safety_and_reorder() -> Column:
    return (M.on_hand() > M.safety_stock()) & M.at_reorder()


def _above_zero_at_safety() -> Column:
    return (M.on_hand() > 0) & M.at_safety()


def _above_reorder() -> Column:
    return M.on_hand() > M.reorder_point()


def _band_tests() -> dict[str, Column]:
    """Bands of on-hand stock: four that exclude each other, two that are cumulative."""
    return {
        "empty_rows": M.is_empty(),
        "critical_rows": _above_zero_at_safety(),
        "low_rows": _between_safety_and_reorder(),
        "healthy_rows": _above_reorder(),
        "safety_rows": M.at_safety(),
        "reorder_rows": M.at_reorder(),
    }


def _counters(weight: Column | None) -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """Row count, conditional row count and sum; with a weight each row counts that often."""
    if weight is None:
        return F.count(F.lit(1)), count_when, F.sum
    return (
        F.sum(weight),
        lambda condition: F.sum(F.when(condition, weight).otherwise(F.lit(0))),
        lambda column: F.sum(column * weight),
    )


def _agg(df: DataFrame, keys: tuple[str, ...], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[column.alias(name) for name, column in measures.items()])


def _mean_of_parts(column: str) -> Column:
    return ratio(F.sum(f"{column}__sum"), F.sum(f"{column}__n"))


def _health(critical_rows: Column, skus: Column) -> Column:
    """100 less the share of critical rows per distinct item; below 0 when rows outnumber items."""
    return round_to((1 - ratio(critical_rows, skus)) * 100, 1)


def location_category_summary(inventory: DataFrame) -> DataFrame:
    bands = _band_tests()
    return (
        located(inventory)
        .groupBy("location", "category")
        .agg(
            # a single distinct count needs no rewrite: Spark runs it in two levels itself
            F.count_distinct("sku_id").alias("total_skus"),
            as_double(F.sum("quantity_on_hand")).alias("total_stock"),
            as_double(F.sum(M.available_stock())).alias("available_stock"),
            round_to(ratio(F.sum("days_of_inventory"), F.count("days_of_inventory")), 1).alias("avg_days_inventory"),
            count_when(bands["empty_rows"]).alias("out_of_stock_count"),
            count_when(bands["critical_rows"]).alias("critical_count"),
            count_when(bands["low_rows"]).alias("low_count"),
            count_when(bands["healthy_rows"]).alias("healthy_count"),
            round_to(ratio(F.sum(M.risk_step()), F.count(F.lit(1))), 1).alias("avg_risk_score"),
            as_double(F.sum("total_inventory_value_usd")).alias("total_value_usd"),
        )
    )


LOCATION_KEYS = ("location", "warehouse_id", "category", "sku_id")
_LOCATION_MEANS = ("days_of_inventory", "supplier_ontime_pct", "demand_forecast_accuracy_pct")


def location_cells(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row per (location, warehouse, category, sku) with summed measures."""
    count_rows, rows_where, summed = _counters(weight)
    return _agg(
        rows,
        LOCATION_KEYS,
        {
            "rows": count_rows,
            "units": summed(M.on_hand()),
            "value": summed(F.col("total_inventory_value_usd")),
        }
        | {name: rows_where(condition) for name, condition in _band_tests().items()}
        | {f"{c}__sum": summed(F.col(c)) for c in _LOCATION_MEANS}
        | {f"{c}__n": rows_where(F.col(c).isNotNull()) for c in _LOCATION_MEANS},
    )


def _location_measures() -> dict[str, Column]:
    return {
        "total_skus": F.count("sku_id"),
        "total_units": as_double(F.sum("units")),
        "total_value_usd": as_double(F.sum("value")),
        "avg_days_coverage": round_to(_mean_of_parts("days_of_inventory"), 1),
        "health_score": _health(F.sum("safety_rows"), F.count("sku_id")),
        "avg_forecast_accuracy": round_to(_mean_of_parts("demand_forecast_accuracy_pct"), 1),
    }


def _by_location(cells: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """``measures`` per (location, warehouse) over one row per item, and the number of categories.

    Two distinct counts side by side would make Spark copy every cell. Items are counted on a level of
    their own, categories on the small set of a location's categories, and the two are joined.
    """
    keys = LOCATION_KEYS[:2]
    per_item = add_cells(cells.drop("category"), (*keys, "sku_id"))
    places = _agg(per_item, keys, measures)
    categories = cells.select(*keys, "category").distinct().groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count("category").alias("total_categories")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    first, *rest = [c for c in places.columns if c not in keys]
    return places.join(categories, same).select(*keys, first, "total_categories", *rest)


def warehouse_performance(inventory: DataFrame) -> DataFrame:
    """Issue counts are cumulative here: a critical item also counts as low."""
    return _by_location(
        location_cells(located(inventory)),
        _location_measures()
        | {
            "out_of_stock_items": F.sum("empty_rows"),
            "critical_items": F.sum("safety_rows"),
            "low_stock_items": F.sum("reorder_rows"),
            "avg_supplier_ontime_pct": round_to(_mean_of_parts("supplier_ontime_pct"), 1),
        },
    )


def location_from_cells(cells: DataFrame) -> DataFrame:
    """Issue counts exclude each other here."""
    return _by_location(
        cells.where(F.col("rows") > 0),
        _location_measures()
        | {
            "out_of_stock_count": F.sum("empty_rows"),
            "critical_count": F.sum("critical_rows"),
            "low_stock_count": F.sum("low_rows"),
            "healthy_count": F.sum("healthy_rows"),
            "avg_supplier_performance": round_to(_mean_of_parts("supplier_ontime_pct"), 1),
            "items_needing_reorder": F.sum("reorder_rows"),
        },
    )


def location_performance(inventory: DataFrame) -> DataFrame:
    return location_from_cells(location_cells(located(inventory)))


def abc_analysis(inventory: DataFrame) -> DataFrame:
    return (
        located(inventory)
        .groupBy("location", "abc_class", "category")
        .agg(
            F.count_distinct("sku_id").alias("sku_count"),
            as_double(F.sum("total_inventory_value_usd")).alias("total_value_usd"),
            as_double(F.sum("quantity_on_hand")).alias("total_units"),
            count_when(M.at_safety()).alias("critical_count"),
            count_when(M.at_reorder()).alias("low_stock_count"),
        )
        .withColumn("critical_pct", round_to(ratio(F.col("critical_count") * 100, F.col("sku_count")), 1))
    )


HEATMAP_KEYS = ("location", "category", "sku_id")


def heatmap_cells(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row per (location, category, sku) with row counts per stock band.

    Counts rather than flags: they add up, so the cells of a change batch (rows weighted
    +1 and -1) can be added to earlier cells instead of reading the table again.
    """
    count_rows, rows_where, summed = _counters(weight)
    return _agg(
        rows,
        HEATMAP_KEYS,
        {
            "rows": count_rows,
            "units": summed(M.on_hand()),
            "value": summed(F.col("total_inventory_value_usd")),
            "days": summed(F.col("days_of_inventory")),
            "days_rows": rows_where(F.col("days_of_inventory").isNotNull()),
            "risk": summed(M.risk_step()),
        }
        | {name: rows_where(condition) for name, condition in _band_tests().items()},
    )


def heatmap_from_cells(cells: DataFrame) -> DataFrame:
    def skus_with(column: str) -> Column:
        return count_when(F.col(column) > 0)

    out, crit, low = skus_with("empty_rows"), skus_with("safety_rows"), skus_with("reorder_rows")
    skus = F.count(F.lit(1))
    return (
        cells.where(F.col("rows") > 0)
        .groupBy("location", "category")
        .agg(
            skus.alias("total_skus"),
            out.alias("out_of_stock_skus"),
            skus_with("critical_rows").alias("critical_skus"),
            skus_with("low_rows").alias("low_stock_skus"),
            skus_with("healthy_rows").alias("healthy_skus"),
            as_double(F.sum("units")).alias("total_units"),
            as_double(F.sum("value")).alias("total_value_usd"),
            round_to(ratio(F.sum("days"), F.sum("days_rows")), 1).alias("avg_days_coverage"),
            round_to(ratio(F.sum("risk"), F.sum("rows")), 1).alias("avg_risk_score"),
            ladder(
                (out > 0, K.OUT_OF_STOCK),
                (crit > skus * F.lit(K.CRITICAL_SHARE), K.CRITICAL),
                (low > skus * F.lit(K.LOW_SHARE), K.LOW),
                default=K.HEALTHY,
            ).alias("overall_status"),
        )
    )


def add_cells(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sum cells of several batches."""
    measures = [c for c in cells.columns if c not in keys]
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def category_heatmap(inventory: DataFrame) -> DataFrame:
    """Risk per location and category; four conditional distinct counts in two levels."""
    return heatmap_from_cells(heatmap_cells(located(inventory)))


def overview_counts(inventory: DataFrame) -> DataFrame:
    """Table size and number of distinct values, NULL counting as a value."""
    places = ("warehouse_location", "category")
    cells = inventory.groupBy(*places, "sku_id").agg(F.count(F.lit(1)).alias("rows"))
    folded = cells.withColumn("item", is_first(["sku_id"], *places)).groupBy(*places).agg(
        F.sum("rows").alias("rows"), F.count_if("item").alias("items")
    )
    marked = folded.withColumns({
        "first_location": is_first(["warehouse_location"], "category"),
        "first_category": is_first(["category"], "warehouse_location"),
    })
    return marked.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"),
        F.count_if("first_location").alias("total_locations"),
        F.count_if("first_category").alias("total_categories"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("total_skus"),
    )


def table_row_counts(inventory: DataFrame) -> DataFrame:
    """Row counts of the five derived tables, in one scan instead of five."""
    cells = (
        located(inventory)
        .groupBy("location", "warehouse_id", "category")
        .agg(
            F.count(F.lit(1)).alias("health"),
            count_when(P.needs_attention()).alias("alerts"),
            count_when(P.needs_reorder()).alias("reorders"),
        )
    )
    marked = cells.withColumns({
        "first_place": is_first(("location", "warehouse_id"), "category"),
        "first_cell": is_first(("location", "category"), "warehouse_id"),
    })
    counts = marked.agg(
        F.struct(F.lit("stock_health").alias("t"), F.coalesce(F.sum("health"), F.lit(0)).alias("n")).alias("a"),
        F.struct(F.lit("active_alerts").alias("t"), F.coalesce(F.sum("alerts"), F.lit(0)).alias("n")).alias("b"),
        F.struct(F.lit("reorder_recommendations").alias("t"), F.coalesce(F.sum("reorders"), F.lit(0)).alias("n")).alias("c"),
        F.struct(F.lit("location_performance").alias("t"), F.count_if("first_place").alias("n")).alias("d"),
        F.struct(F.lit("category_heatmap").alias("t"), F.count_if("first_cell").alias("n")).alias("e"),
    )
    return counts.select(F.inline(F.array("a", "b", "c", "d", "e")).alias("table_name", "row_count"))


def check_counts(inventory: DataFrame) -> DataFrame:
    urgent = M.alert_priority().isin(*K.PRIORITIES[:2])
    return inventory.agg(
        count_when(P.is_active() & (M.stock_status() == K.CRITICAL)).alias("critical_items"),
        count_when(P.is_active() & P.needs_attention() & urgent).alias("critical_alerts"),
        F.count(F.lit(1)).alias("total_records"),
    )


def mean_days_all(inventory: DataFrame) -> DataFrame:
    """Cover of every row, withdrawn ones included, with the no-demand stand-in."""
    cover = F.when(M.has_demand(), ratio(M.on_hand(), M.daily_sales())).otherwise(F.lit(float(K.NO_DEMAND_DAYS)))
    return inventory.agg(
        count_when(M.at_safety()).alias("critical_items"),
        F.count(F.lit(1)).alias("total_items"),
        round_to(F.avg(cover), 1).alias("avg_days_until_stockout"),
    )


def duplicate_keys(inventory: DataFrame) -> DataFrame:
    """Keys that break the declared uniqueness of (sku_id, batch_id)."""
    return (
        inventory.groupBy("sku_id", "batch_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
