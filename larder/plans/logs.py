"""Alert and reorder logs: new rows with quiet periods, state changes, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder import constants as K
from larder import schema
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.plans.changes import may_be_among


def _instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _before(as_of: str, **span: int) -> Column:
    return _instant(as_of) - F.make_dt_interval(
        F.lit(span.get("days", 0)), F.lit(span.get("hours", 0)), F.lit(0), F.lit(0)
    )


def _run_id(as_of: str) -> Column:
    """Row id that any task can make: a hash of what the row stands for and of the run."""
    parts = ("sku_id", "warehouse_location", "batch_id", "quantity_on_hand", "audit_date")
    return F.xxhash64(*[F.col(p) for p in parts], F.lit(as_of))


def _not_quiet(rows: DataFrame, quiet: DataFrame) -> DataFrame:
    """Drop rows whose item and location already have a log entry.

    The log is read as it was before the run, so several batches of one item all pass;
    a NULL location equals nothing and passes too. The log side is reduced to its
    distinct keys. A bitmap of their digests tells most rows apart where they lie: rows that
    aren't in it pass. Of the others only the distinct keys are compared with the log, and
    the few that were taken for one of its keys pass too, so no whole rows are sent to meet the log.
    """
    at = ("sku_id", "warehouse_location")
    keyed = F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()
    digest = F.xxhash64(*at)
    keys = quiet.select(F.col("sku_id").alias(at[0]), F.col("location").alias(at[1])).where(keyed).distinct()
    held = keys.select(digest.alias("_held"))
    unkeyed = rows.where(~keyed)
    apart = may_be_among(rows.where(keyed), digest, held, "left_anti")
    met = may_be_among(rows.where(keyed), digest, held)
    mistaken = met.select(*at).distinct().join(keys, [*at], "left_anti")
    some = may_be_among(met, digest, mistaken.select(digest.alias("_mistaken")))
    return unkeyed.unionByName(apart).unionByName(some.join(mistaken, [*at], "left_semi"))


def new_alerts(inventory: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """Alerts due at ``as_of`` that no open alert of the last 24 hours covers."""
    due = inventory.where(P.needs_attention() & P.is_active())
    recent = F.col("alert_timestamp") >= _before(as_of, hours=K.ALERT_QUIET_HOURS)
    open_recent = history.where((F.col("resolved") == F.lit(False)) & recent)
    rows = _not_quiet(due, open_recent).select(
        _run_id(as_of).alias("alert_id"),
        _instant(as_of).alias("alert_timestamp"),
        "sku_id",
        "sku_name",
        "category",
        F.col("warehouse_location").alias("location"),
        "warehouse_id",
        "abc_class",
        M.alert_type().alias("alert_type"),
        M.alert_priority().alias("priority"),
        "quantity_on_hand",
        "reorder_point",
        "safety_stock",
        M.days_until_stockout().alias("days_until_stockout"),
        F.lit(False).alias("resolved"),
        "supplier_name",
        "supplier_id",
        "lead_time_days",
        "unit_cost_usd",
        M.stockout_impact().alias("estimated_impact_usd"),
    )
    return schema.conform(rows, schema.ALERT_HISTORY)


def new_reorders(inventory: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Reorder actions due at ``as_of`` that no pending action of the last 7 days covers."""
    due = inventory.where(P.needs_reorder() & P.is_active())
    recent = F.col("action_timestamp") >= _before(as_of, days=K.REORDER_QUIET_DAYS)
    pending = log.where((F.col("status") == K.REORDER_STATES[0]) & recent)
    rows = _not_quiet(due, pending).select(
        _run_id(as_of).alias("action_id"),
        _instant(as_of).alias("action_timestamp"),
        "sku_id",
        "sku_name",
        "category",
        F.col("warehouse_location").alias("location"),
        M.recommended_order_qty().alias("recommended_qty"),
        M.economic_order_qty().alias("economic_order_qty"),
        M.priority_score().alias("priority_score"),
        "unit_cost_usd",
        M.total_order_value().alias("total_order_value_usd"),
        F.lit(K.REORDER_STATES[0]).alias("status"),
        "supplier_name",
        "supplier_id",
        F.lit("SYSTEM").alias("created_by"),
    )
    return schema.conform(rows, schema.REORDER_LOG)


def open_log(spark: SparkSession, path: str, contract: StructType) -> DataFrame:
    """A log that may not exist before its first run."""
    try:
        return spark.read.schema(contract).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], contract)


def _append(rows: DataFrame, path: str, stamp: str) -> int:
    """Append by day and count on the way, without a second pass."""
    counted = Observation()
    (
        rows.observe(counted, F.count(F.lit(1)).alias("rows"))
        .withColumn("log_date", F.to_date(stamp))
        .write.mode("append")
        .partitionBy("log_date")
        .parquet(path)
    )
    return counted.get["rows"]


def recent_days(spark: SparkSession, path: str, contract: StructType, as_of: str, days: int) -> DataFrame:
    """The log of the last days only: other days are neither listed nor read."""
    last = datetime.fromisoformat(as_of).date()
    wanted = ",".join(str(last - timedelta(days=back)) for back in range(days + 1))
    return open_log(spark, f"{path}/log_date={{{wanted}}}", contract)


def generate_alerts(spark: SparkSession, inventory: DataFrame, history_path: str, as_of: str) -> int:
    """Append the due alerts; run again for the same moment it adds nothing."""
    history = recent_days(spark, history_path, schema.ALERT_HISTORY, as_of, 1)
    return _append(new_alerts(inventory, history, as_of), history_path, "alert_timestamp")


def generate_reorders(spark: SparkSession, inventory: DataFrame, log_path: str, as_of: str) -> int:
    log = recent_days(spark, log_path, schema.REORDER_LOG, as_of, K.REORDER_QUIET_DAYS)
    return _append(new_reorders(inventory, log, as_of), log_path, "action_timestamp")


def due_for_purge(as_of: str, days: int = K.ALERT_KEEP_DAYS) -> Column:
    """Resolved more than ``days`` ago; an unknown resolution time is not."""
    return F.col("resolved") & (F.col("resolved_timestamp") < _before(as_of, days=days))


def keep_after_purge(history: DataFrame, as_of: str, days: int = K.ALERT_KEEP_DAYS) -> DataFrame:
    """Drop alerts resolved more than ``days`` ago; an unknown resolution time is kept."""
    return history.where(~F.coalesce(due_for_purge(as_of, days), F.lit(False)))


def rewrite_log(rows: DataFrame, new_path: str, stamp: str) -> None:
    """Write a log's next version beside the current one.

    Parquet cannot delete or update in place, and a job must not overwrite what it is
    reading: a lost executor would then find its input gone. Readers move to the new
    path once it is complete. Rows of one day come together first, so a day has few files;
    a day that holds much is split over tasks.
    """
    dated = rows.withColumn("log_date", F.to_date(stamp)).hint("rebalance", "log_date")
    dated.write.mode("errorifexists").partitionBy("log_date").parquet(new_path)


def purge_resolved(spark: SparkSession, path: str, new_path: str, as_of: str, days: int = K.ALERT_KEEP_DAYS) -> None:
    history = open_log(spark, path, schema.ALERT_HISTORY)
    rewrite_log(keep_after_purge(history, as_of, days), new_path, "alert_timestamp")


def _one_per_key(changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Repeated updates of one key fold to the greatest, so no log row can multiply."""
    rest = [c for c in changes.columns if c not in keys]
    folded = F.max(F.struct(*rest)).alias("_change") if rest else F.first(F.struct(F.lit(1).alias("_"))).alias("_change")
    return changes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(folded)


def _match(keys: tuple[str, ...]) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return match


def _join_changes(log: DataFrame, changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return log.join(_one_per_key(changes, keys), _match(keys), "left")


def resolve_alerts(
    history: DataFrame, resolutions: DataFrame, as_of: str, keys: tuple[str, ...] = ("alert_id",)
) -> DataFrame:
    """Close the open alerts named in ``resolutions`` (keys, resolved_by, resolution_notes)."""
    hit = F.col("_change").isNotNull() & (F.col("resolved") == F.lit(False))
    new = {
        "resolved": F.lit(True),
        "resolved_timestamp": _instant(as_of),
        "resolved_by": F.col("_change.resolved_by"),
        "resolution_notes": F.col("_change.resolution_notes"),
    }
    joined = _join_changes(history, resolutions, keys)
    return joined.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in history.columns]
    )


def _last_moves(moves: DataFrame, keys: tuple[str, ...], sequence: str | None) -> DataFrame:
    """(keys, _first, _other): the least and the greatest status of each key's last moves, in any order of arrival."""
    at = F.col(sequence) if sequence else F.lit(0)
    dated = moves.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], at.alias("_at")).agg(
        F.min("status").alias("_first"), F.max("status").alias("_other")
    )
    last = dated.groupBy(*[f"_{k}" for k in keys]).agg(F.max(F.struct("_at", "_first", "_other")).alias("_last"))
    return last.select(*[f"_{k}" for k in keys], "_last._first", "_last._other")


def clashing_moves(moves: DataFrame, keys: tuple[str, ...] = ("action_id",), sequence: str | None = None) -> DataFrame:
    """Keys that are moved to different statuses at once: (keys, first_status, other_status). They aren't moved."""
    clashes = _last_moves(moves, keys, sequence).where(F.col("_first") != F.col("_other"))
    return clashes.select(
        *[F.col(f"_{k}").alias(k) for k in keys], F.col("_first").alias("first_status"), F.col("_other").alias("other_status")
    )


def move_reorders(
    log: DataFrame, moves: DataFrame, as_of: str, keys: tuple[str, ...] = ("action_id",), sequence: str | None = None
) -> DataFrame:
    """Set the status named in ``moves`` (keys, status); stamp the order or delivery day.

    With a ``sequence``, a column of ``moves`` such as a number or a time, a key's last move counts. Moves that
    nothing tells apart and that disagree are left alone; ``clashing_moves`` lists them.
    """
    to = F.when(F.col("_first") == F.col("_other"), F.col("_first"))
    today = F.to_date(F.lit(as_of))
    _, ordered, delivered, _ = K.REORDER_STATES
    new = {
        "status": F.coalesce(to, "status"),
        "order_date": F.when(to == ordered, today).otherwise(F.col("order_date")),
        "actual_delivery_date": F.when(to == delivered, today).otherwise(F.col("actual_delivery_date")),
    }
    joined = log.join(_last_moves(moves, keys, sequence), _match(keys), "left")
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in log.columns])
