"""Tables kept in day folders, and a manifest that names the folders that count.

Parquet cannot delete in place, and a job must not overwrite what it reads. A purge therefore writes new folders
for the days that hold due rows, and a new manifest; the folders of all other days stay as they are, with the same
files. Whoever holds an older manifest still finds its folders, so a purge that is lost half-way has changed
nothing: run it again with a new root. Folders that no manifest names are the owner's to delete.

A manifest has one row per day and folder, so its rows pass through the driver: a few thousand for ten years.
Days are written by ``logs.rewrite_log`` or the appending jobs, as ``log_date=<day>``; rows without a day have a
folder of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import constants as K
from larder import schema
from larder.plans import logs

MANIFEST = T.StructType([T.StructField("day", T.DateType()), T.StructField("folder", T.StringType())])
#: Fixed value: Spark's folder name for a partition without a value.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _folders(days: DataFrame, root: str) -> DataFrame:
    """A manifest of the ``day`` column's values, all below ``root``."""
    name = F.coalesce(F.col("day").cast("string"), F.lit(NO_DAY))
    return days.distinct().select("day", F.concat(F.lit(f"{root.rstrip('/')}/log_date="), name).alias("folder"))


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    """The days below one root; an empty or new root has none. Lists the root and reads no column of the files."""
    day = T.StructType([T.StructField("log_date", T.DateType())])
    return _folders(logs.open_log(spark, root, day).select(F.col("log_date").alias("day")), root)


def write_days(rows: DataFrame, root: str, stamp: str) -> DataFrame:
    """Write stored rows by the day of ``stamp`` and return their manifest, from that column alone: nothing is listed."""
    logs.rewrite_log(rows, root, stamp)
    return _folders(rows.select(F.to_date(stamp).alias("day")), root)


def save_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("errorifexists").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def newest(manifest: DataFrame) -> DataFrame:
    """The folders of the last day."""
    last = manifest.groupBy("day").agg(F.collect_set("folder").alias("folders")).where(F.col("day").isNotNull())
    return last.orderBy(F.desc("day")).limit(1).select("day", F.explode("folders").alias("folder"))


def _open(spark: SparkSession, folders: Iterable[str], contract: T.StructType) -> DataFrame:
    paths = sorted(set(folders))
    return spark.read.schema(contract).parquet(*paths) if paths else spark.createDataFrame([], contract)


def open_days(spark: SparkSession, manifest: DataFrame, contract: T.StructType) -> DataFrame:
    """All rows of the folders named, in one scan; no other folder is listed or read."""
    return _open(spark, (r.folder for r in manifest.collect()), contract)


def purge_resolved(
    spark: SparkSession, manifest: DataFrame, new_root: str, as_of: str, days: int = K.ALERT_KEEP_DAYS
) -> DataFrame:
    """Drop alerts resolved more than ``days`` ago and return the next manifest.

    Only days with due rows are written again, below ``new_root``. Which days these are comes from three columns,
    with the test pushed to the files. A day that keeps no row leaves the manifest. Save the manifest to keep it.
    """
    contract = schema.ALERT_HISTORY
    live = manifest.collect()
    day = F.to_date("alert_timestamp").alias("day")
    due = _open(spark, (r.folder for r in live), contract).where(logs.due_for_purge(as_of, days))
    touched = {r.day for r in due.select(day).distinct().collect()}
    stale = [r.folder for r in live if r.day in touched]
    rest = spark.createDataFrame([tuple(r) for r in live if r.day not in touched], MANIFEST)
    if not stale:
        return rest
    kept = logs.keep_after_purge(_open(spark, stale, contract), as_of, days)
    return rest.unionByName(write_days(kept, new_root, "alert_timestamp"))
