"""Writers: derived tables, the reorder export with its audit row, backups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schema
from larder.operators.ranking import ranked

OPEN_FILES = 64
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"

# Headings of the exported reorder list.
EXPORT_HEADINGS = {
    "sku_id": "SKU_ID",
    "sku_name": "SKU_NAME",
    "category": "CATEGORY",
    "location": "LOCATION",
    "abc_class": "ABC_CLASS",
    "quantity_on_hand": "Current Stock",
    "reorder_point": "Reorder Point",
    "safety_stock": "Safety Stock",
    "recommended_order_qty": "Recommended Qty",
    "economic_order_qty": "Economic Order Qty",
    "priority_score": "Priority (1-10)",
    "lead_time_days": "Lead Time (Days)",
    "avg_daily_sales": "Avg Daily Usage",
    "unit_cost_usd": "Unit Cost (USD)",
    "estimated_order_value_usd": "Order Value (USD)",
    "supplier_name": "Supplier",
    "supplier_id": "Supplier ID",
    "supplier_ontime_pct": "Supplier On-Time %",
}


# Headings of the list as shown on screen; other columns keep their names.
SHOWN_HEADINGS = {
    "sku_id": "SKU ID",
    "sku_name": "Item Name",
    "category": "Category",
    "location": "Location",
    "quantity_on_hand": "Current Stock",
    "reorder_point": "Reorder Point",
    "recommended_order_qty": "Recommended Qty",
    "unit_cost_usd": "Unit Cost (USD)",
    "supplier_name": "Supplier",
    "priority_score": "Priority Score",
}


def shown_list(reorders: DataFrame, include_all: bool = True, first: int = 100) -> DataFrame:
    """The reorder list with its on-screen headings, whole or its first rows."""
    if not include_all:
        reorders = ranked(reorders, first, F.desc("priority_score"), F.desc_nulls_last("estimated_order_value_usd"))
    return reorders.withColumnsRenamed(SHOWN_HEADINGS)


def laid_out(df: DataFrame, partition_by: str | None, clustered_by: tuple[str, ...]) -> DataFrame:
    """Rows placed for writing.

    Rows of one partition value (or cluster) are brought together first; otherwise every
    task would leave a small file in every partition. The rebalance hint lets the
    adaptive planner split a value that holds much of the table over several tasks and
    merge small ones. ``clustered_by`` also sorts within the tasks, so that files cover
    narrow ranges and a filter on those columns skips the others.
    """
    together = [*([partition_by] if partition_by else []), *clustered_by]
    if together:
        df = df.hint("rebalance", *[F.col(name) for name in together])
    return df.sortWithinPartitions(*together) if clustered_by else df


def materialize(
    df: DataFrame, path: str, partition_by: str | None = "location", clustered_by: tuple[str, ...] = (), gather: bool = True
) -> None:
    """Replace a derived table; without ``gather`` rows are written by the tasks that hold them, a file per value.

    A task then keeps up to OPEN_FILES files open, instead of sorting its rows by their value first; only with more values
    does it sort.
    """
    writer = (laid_out(df, partition_by, clustered_by) if gather else df).write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_OPEN)
    conf.set(_OPEN, before if gather else str(OPEN_FILES))
    try:
        writer.parquet(path)
    finally:
        conf.set(_OPEN, before)


def export_order() -> list[Column]:
    return [F.desc("Priority (1-10)"), F.desc_nulls_last("Order Value (USD)")]


def export_frame(reorders: DataFrame, location: str | None = None) -> DataFrame:
    """The reorder list under its export headings, optionally for one location."""
    if location not in (None, "All"):
        reorders = reorders.where(F.col("location") == location)
    return reorders.select(*[F.col(name).alias(heading) for name, heading in EXPORT_HEADINGS.items()])


def export_reorder(reorders: DataFrame, path: str, location: str | None = None) -> None:
    """CSV parts in list order; a distributed sort, so part files follow one another.

    All columns take part in the order: equal scores then spread over several tasks.
    """
    rows = export_frame(reorders, location)
    ordered = rows.orderBy(*export_order(), *[F.col(f"`{name}`") for name in rows.columns])
    ordered.write.mode("overwrite").option("header", "true").csv(path)


def export_log_row(
    spark: SparkSession,
    export_type: str,
    records: DataFrame,
    at: str,
    exported_by: str = "user",
    file_format: str = "CSV",
    filters: dict[str, str | None] | None = None,
) -> DataFrame:
    """One audit row; the record count is computed by Spark with the row."""
    filter_text = json.dumps(filters or {}, sort_keys=True)
    row = records.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.xxhash64(F.lit(export_type), F.lit(at), F.lit(exported_by), F.lit(filter_text)).alias("export_id"),
        F.lit(at).cast("timestamp_ntz").alias("export_timestamp"),
        F.lit(export_type).alias("export_type"),
        "record_count",
        F.lit(exported_by).alias("exported_by"),
        F.lit(file_format).alias("file_format"),
        F.lit(filter_text).alias("filters_applied"),
    )
    return schema.conform(row, schema.EXPORT_LOG)


def log_export(row: DataFrame, log_path: str) -> None:
    row.write.mode("append").parquet(log_path)


def export_filters(log: DataFrame) -> DataFrame:
    """The filter text parsed into a VARIANT."""
    return log.withColumn("filters_applied", F.parse_json("filters_applied"))


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, backup_path: str, table_path: str) -> DataFrame:
    """Put the saved rows back in place of the current ones."""
    saved = spark.read.parquet(backup_path)
    saved.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(table_path)
    return spark.read.schema(saved.schema).parquet(table_path)
