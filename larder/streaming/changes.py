"""Change rows as a stream, and the tables and the alert log kept current from it.

A change row is a full inventory row with a weight: +copies when it enters the table,
-copies when it leaves. A row of weight 0 is a heartbeat: it changes nothing but lets a
batch run, so that what depends on the time moves on. Every micro-batch writes under its own batch number with
overwrite, so a batch that runs again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larder import schema
from larder.functions import predicates as P
from larder.operators import rollups
from larder.plans.changes import inventory_changes
from larder.plans.jobs import TARGET_LAG, derived_tables
from larder.plans.logs import new_alerts, recent_days
from larder.sources import sinks
from larder.streaming import state
from larder.streaming.state import WEIGHT

LOGGED_ALERTS = T.StructType([*schema.ALERT_HISTORY.fields, T.StructField("batch_id", T.LongType())])
CHANGE_ROWS = T.StructType([*schema.INVENTORY.fields, T.StructField(WEIGHT, T.LongType())])

#: With more locations than these the rows of one are brought together before they are written.
FEW_PLACES = 64

#: The inventory rows a row-level table is made of; none of the filters depends on the day.
KEPT = {
    "stock_health": lambda: P.is_active(),
    "active_alerts": lambda: P.needs_attention() & P.is_active(),
    "reorder_recommendations": lambda: P.needs_reorder() & P.is_active(),
}


def weigh(changes: DataFrame) -> DataFrame:
    """Change frame to weighted rows."""
    signed = F.when(F.col("change_action") == "INSERT", F.col("copies")).otherwise(-F.col("copies"))
    return changes.select(*schema.INVENTORY.fieldNames(), signed.alias(WEIGHT))


def publish_load(inventory: DataFrame, feed_path: str) -> None:
    """First load of the feed: every row enters once."""
    rows = inventory.select(*schema.INVENTORY.fieldNames(), F.lit(1).cast("long").alias(WEIGHT))
    rows.write.mode("append").option("compression", "zstd").parquet(feed_path)


def loaded(spark: SparkSession, feed_path: str) -> DataFrame:
    """The inventory as the feed's files hold it before any change; files that come later are not seen."""
    return spark.read.schema(CHANGE_ROWS).parquet(feed_path).drop(WEIGHT)


def publish_changes(old: DataFrame, new: DataFrame, feed_path: str) -> None:
    weigh(inventory_changes(old, new)).write.mode("append").option("compression", "zstd").parquet(feed_path)


def publish_heartbeat(spark: SparkSession, feed_path: str) -> None:
    """A batch for the stream although nothing has changed."""
    spark.createDataFrame([(*[None] * len(schema.INVENTORY.fields), 0)], CHANGE_ROWS).write.mode("append").parquet(feed_path)


def with_heartbeat(changes: DataFrame) -> DataFrame:
    """The change stream with a heartbeat every second: each trigger then finds something to run for."""
    beats = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.INVENTORY.fields]
    return changes.unionByName(beats.select(*nothing, F.lit(0).cast("long").alias(WEIGHT)))


def read_changes(spark: SparkSession, feed_path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHANGE_ROWS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(feed_path)


def _start(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, lag: str | None
) -> StreamingQuery:
    """Run the step per micro-batch: at the given lag, or once over what is there."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=lag) if lag else writer.trigger(availableNow=True)
    return writer.start()


@dataclass(frozen=True)
class Rollup:
    """How a scorecard is kept as additive cells."""

    cells: Callable[..., DataFrame]
    keys: tuple[str, ...]
    table: Callable[[DataFrame], DataFrame]


ROLLUPS = {
    "category_heatmap": Rollup(rollups.heatmap_cells, rollups.HEATMAP_KEYS, rollups.heatmap_from_cells),
    "location_performance": Rollup(rollups.location_cells, rollups.LOCATION_KEYS, rollups.location_from_cells),
}


def stream_rollup(
    stream: DataFrame, name: str, cells_path: str, table_path: str, checkpoint: str, lag: str | None = None
) -> StreamingQuery:
    """Keep a scorecard current without reading the inventory again.

    A batch is reduced to cells per item that carry signed row counts, written beside the
    cells of earlier batches, and the table is made from their sum. A count that returns
    to 0 means the item has left its band. The work grows with the batch and the number
    of cells, not with the inventory rows. Each batch publishes its own version of the
    table, so readers never meet a half-replaced one (see ``current_table``).
    """
    rollup = ROLLUPS[name]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cells = rollup.cells(rollups.located(batch.where(F.col(WEIGHT) != 0)), F.col(WEIGHT))
        cells.write.mode("overwrite").parquet(f"{cells_path}/batch_id={batch_id}")
        known = spark.read.parquet(cells_path).drop("batch_id")
        table = rollup.table(rollups.add_cells(known, rollup.keys))
        table.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    return _start(stream, step, checkpoint, lag)


def current_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest published version; only its folder is read."""
    versions = spark.read.parquet(table_path)
    newest = versions.agg(F.max("batch_id")).scalar()
    return versions.where(F.col("batch_id") == newest).drop("batch_id")


def compact_cells(spark: SparkSession, name: str, cells_path: str, new_path: str, up_to_batch: int) -> None:
    """Fold the cells of finished batches into one, at a new path."""
    done = spark.read.parquet(cells_path).where(F.col("batch_id") <= up_to_batch).drop("batch_id")
    folded = rollups.add_cells(done, ROLLUPS[name].keys).where(F.col("rows") != 0)
    folded.write.mode("errorifexists").parquet(f"{new_path}/batch_id={up_to_batch}")


def stream_items(stream: DataFrame, name: str, state_path: str, checkpoint: str, lag: str | None = None) -> StreamingQuery:
    """Keep the inventory rows behind a row-level table, net of what has left.

    What depends on the day isn't kept: ``current_items`` works it out for the day it is asked for, so a row
    that entered on one day and leaves on another is gone.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        state.absorb(batch.where(KEPT[name]()), state_path, batch_id)

    return _start(stream, step, checkpoint, lag)


def current_items(spark: SparkSession, name: str, state_path: str, as_of: str) -> DataFrame:
    """A row-level table as of a moment, from the rows kept for it."""
    return derived_tables(as_of)[name](state.current(spark, state_path, CHANGE_ROWS))


def publish_items(spark: SparkSession, name: str, state_path: str, as_of: str, table_path: str) -> None:
    """Write the table as of a moment where the table readers look for it.

    With few locations each task writes its own rows of each; nothing is shuffled for the layout.
    """
    scattered = state.has_few(spark, state_path, CHANGE_ROWS, "warehouse_location", FEW_PLACES)
    sinks.materialize(current_items(spark, name, state_path, as_of), table_path, gather=not scattered)


def stream_refresh(
    stream: DataFrame, name: str, state_path: str, table_path: str, checkpoint: str, lag: str | None = ""
) -> StreamingQuery:
    """Keep one of the five derived tables current, by default at its target lag.

    ``lag=None`` takes in what is there and stops. Scorecards publish versions at ``table_path``; row-level
    tables are read with ``current_items`` or written with ``publish_items``.
    """
    lag = TARGET_LAG[name] if lag == "" else lag
    if name in ROLLUPS:
        return stream_rollup(stream, name, state_path, table_path, checkpoint, lag)
    return stream_items(stream, name, state_path, checkpoint, lag)


def stream_alerts(
    stream: DataFrame,
    history_path: str,
    checkpoint: str,
    clock: Callable[[int], str],
    lag: str | None = TARGET_LAG["active_alerts"],
    stock_path: str | None = None,
) -> StreamingQuery:
    """Log alerts for the stock of each batch, quiet for 24 hours per item and location.

    The rows that need attention after the batch are the stock, so an item that stays critical is alerted
    again when a day has passed, and one that has left is not. Only they are kept, at ``stock_path``, beside
    the log unless named. With heartbeats (``with_heartbeat``, ``publish_heartbeat``) batches also run while
    nothing changes.

    The log itself is the other state: each batch is checked against the alerts of earlier
    batches, so a resolved alert re-arms its item, which dropping duplicates within a
    watermark could not do. Only the log of today and yesterday is opened. ``clock``
    gives the time of a batch and must give the same time when the batch runs again.
    """

    stock = stock_path or f"{history_path.rstrip('/')}-stock"

    def step(batch: DataFrame, batch_id: int) -> None:
        as_of, spark = clock(batch_id), batch.sparkSession
        log = recent_days(spark, history_path, LOGGED_ALERTS, as_of, 1)
        history = log.where(F.col("batch_id") < batch_id)
        state.absorb(batch.where(KEPT["active_alerts"]()), stock, batch_id)
        alerts = new_alerts(state.after_batch(spark, stock, CHANGE_ROWS, batch_id), history, as_of)
        alerts.write.mode("overwrite").parquet(f"{history_path}/log_date={as_of[:10]}/batch_id={batch_id}")

    return _start(stream, step, checkpoint, lag)
