"""Ordered lists and readers' top rows.

Every list ends its sort key with all its columns, so a cut through equal ranks always
keeps the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.operators.skew import top_k
from larder.session import scratch_path


def ranked(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """The first ``k`` rows in order, or all of them."""
    keys = [*order, *[F.asc_nulls_last(name) for name in df.columns]]
    return df.orderBy(*keys) if k is None else top_k(df, keys, k)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with their ``position`` in order, from 0, by a distributed sort.

    The sorted rows are written. A row's number is its place in its sorted part and the size of the parts
    before; the sizes are one row per part.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ordered")
    keys = [*order, *[F.asc_nulls_last(name) for name in df.columns]]
    placed = df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    position = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(before, "_part").withColumn("position", position).drop("_at", "_part", "_before")


def joined_text(numbered_rows: DataFrame, entry: str, alias: str, size: int = 100) -> DataFrame:
    """(part, text): the entries in order, joined, so many to a part."""
    part = F.floor(F.col("position") / size).alias("part")
    entries = F.sort_array(F.collect_list(F.struct("position", entry)))
    return numbered_rows.groupBy(part).agg(F.array_join(F.transform(entries, lambda e: e[entry]), ", ").alias(alias))


def top_critical_items(health: DataFrame, k: int = 10) -> DataFrame:
    columns = (
        "sku_name", "location", "category", "abc_class", "quantity_on_hand", "reorder_point",
        "days_until_stockout", "risk_score", "unit_cost_usd",
    )
    return ranked(health.select(*columns), k, F.desc_nulls_last("risk_score")).withColumn("total_value", M.item_value())


def top_reorders(reorders: DataFrame, k: int = 10) -> DataFrame:
    columns = (
        "sku_name", "location", "quantity_on_hand", "reorder_point", "recommended_order_qty",
        "priority_score", "estimated_order_value_usd",
    )
    return ranked(reorders.select(*columns), k, F.desc("priority_score"))


def reorders_in_table_order(reorders: DataFrame, k: int | None = None) -> DataFrame:
    """All recommendations as their table keeps them: priority, class, order value."""
    order = (F.desc("priority_score"), F.asc_nulls_last("abc_class"), F.desc_nulls_last("estimated_order_value_usd"))
    return ranked(reorders, k, *order)


def worst_locations(performance: DataFrame, k: int | None = None) -> DataFrame:
    columns = ("location", "total_skus", "critical_count", "low_stock_count", "health_score", "items_needing_reorder")
    return ranked(performance.select(*columns), k, F.asc_nulls_last("health_score"))


def top_heatmap_cells(heatmap: DataFrame, k: int = 20) -> DataFrame:
    columns = ("location", "category", "total_skus", "critical_skus", "avg_risk_score", "overall_status")
    return ranked(heatmap.select(*columns), k, F.desc_nulls_last("avg_risk_score"))


def by_severity() -> list[Column]:
    return [M.ordinal("priority", K.PRIORITIES).asc(), F.asc_nulls_last("days_until_stockout")]


def first_alerts(alerts: DataFrame, k: int = 20) -> DataFrame:
    columns = (
        "sku_name", "location", "category", "abc_class", "priority", "quantity_on_hand",
        "reorder_point", "safety_stock", "days_until_stockout",
    )
    return ranked(alerts.select(*columns), k, *by_severity())


def reorder_list(reorders: DataFrame, k: int = 100) -> DataFrame:
    columns = (
        "sku_id", "sku_name", "category", "location", "quantity_on_hand", "reorder_point",
        "recommended_order_qty", "priority_score", "unit_cost_usd", "supplier_name",
    )
    return ranked(reorders.select(*columns, "estimated_order_value_usd"), k, F.desc("priority_score"), F.desc_nulls_last("estimated_order_value_usd"))


def high_risk_forecasts(projection: DataFrame, search: str | None = None, k: int = 10) -> DataFrame:
    rows = projection.where(F.col("stockout_risk") == K.RISK_CLASSES[0])
    if search:
        rows = rows.where(P.name_contains("item_name", search))
    return ranked(rows, k, F.asc("predicted_days_to_stockout"))


def top_anomalies(anomalies: DataFrame, k: int = 20) -> DataFrame:
    return ranked(anomalies, k, F.abs("z_score").desc())


def top_forecasts(forecast: DataFrame, k: int = 20) -> DataFrame:
    risky = forecast.where(F.col("stockout_risk").isin(*K.RISK_CLASSES[:2]))
    return ranked(risky, k, F.desc_nulls_last("volatility"))


def recent_insights(insights: DataFrame, k: int = 7) -> DataFrame:
    return ranked(insights, k, F.desc("insight_date"))


def picker(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values for a selection list."""
    return df.select(column).distinct().orderBy(column)
