"""The rows a stream of weighted changes adds up to, kept in files that a batch can add to.

A batch writes its rows under its own number as they come, without a shuffle, and a list of the versions that
count from then on. There are never more than FILES + 1 of them: beyond that the batch folds the later ones into its
own, or all of them once the later ones hold a quarter as many rows as the first. A fold adds equal rows up.
Versions that no longer count stay until the folder is dropped: a batch that runs again finds what it found before.

The list says how many rows of a version leave. Where none does, the rows are read as they lie; else only
those that may equal one that leaves are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.plans.changes import repeated, standing
from larder.plans.logs import open_log

WEIGHT = "change_weight"
BUCKETS = 64  #: files of a small fold at most
BUCKET_ROWS = 1 << 18  #: a larger one has a file for so many rows
FILES = 4
FOLD = 4  #: the first version is left alone while it has so many times the rows of the others
LIVE = T.StructType([T.StructField(name, T.LongType()) for name in ("version", "rows", "leaving")])


def _columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != WEIGHT]


def net(weighted: DataFrame) -> DataFrame:
    """Equal rows added up; those that cancel are gone."""
    columns = _columns(weighted)
    return weighted.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def _live(spark: SparkSession, path: str, batch_id: int) -> list[tuple[int, int, int]]:
    """(version, rows, leaving) that count after a batch, oldest first: at most FILES + 1 of them."""
    if batch_id < 0:
        return []
    return sorted(tuple(r) for r in open_log(spark, f"{path}/live/batch_id={batch_id}", LIVE).collect())


def live_files(spark: SparkSession, path: str, batch_id: int) -> dict[int, list[tuple[int, int]]]:
    """(version, rows) after a batch, oldest first, under the one number 0."""
    held = [(version, rows) for version, rows, _ in _live(spark, path, batch_id)]
    return {0: held} if held else {}


def _read(spark: SparkSession, path: str, fields: T.StructType, versions: list[int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(*[f"{path}/rows/version={v}" for v in versions])


def absorb(batch: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Add a batch of weighted rows. Run again with the same number it replaces what it wrote.

    ``buckets`` bounds the files of a fold that isn't large.
    """
    spark, fields = batch.sparkSession, batch.schema
    before, fold = _live(spark, path, batch_id - 1), []
    if len(before) >= FILES:
        fold = before if before[0][1] < FOLD * sum(n for _, n, _ in before[1:]) else before[1:]
    rows = batch.where(F.col(WEIGHT) != 0)
    if fold:
        files = max(buckets, sum(n for _, n, _ in fold) // BUCKET_ROWS)
        rows = net(rows.union(_read(spark, path, fields, [v for v, _, _ in fold]))).coalesce(files)
    folder = f"{path}/rows/version={batch_id}"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(folder)

    written = spark.read.schema(fields).parquet(folder)
    here, leaving = written.agg(F.count(F.lit(1)), F.count_if(F.col(WEIGHT) < 0)).first()
    live = [v for v in before if v not in fold] + ([(batch_id, here, leaving)] if here else [])
    spark.createDataFrame(live, LIVE).coalesce(1).write.mode("overwrite").parquet(f"{path}/live/batch_id={batch_id}")


def after_batch(spark: SparkSession, path: str, fields: T.StructType, batch_id: int) -> DataFrame:
    """The rows after a batch, each as often as it is there. Only versions that count are listed and read."""
    live = _live(spark, path, batch_id)
    weighted = _read(spark, path, fields, [v for v, _, _ in live])
    with_leaving = [v for v, _, leaving in live if leaving]
    if not with_leaving:
        return repeated(weighted.where(F.col(WEIGHT) > 0), WEIGHT)
    return standing(weighted, WEIGHT, _read(spark, path, fields, with_leaving).where(F.col(WEIGHT) < 0))


def _newest(spark: SparkSession, path: str) -> int:
    return int(spark.read.parquet(f"{path}/live").agg(F.max("batch_id")).first()[0])


def current(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """The rows after the last batch. A new checkpoint needs a new path: batches are counted from 0 again."""
    return after_batch(spark, path, fields, _newest(spark, path))


def has_few(spark: SparkSession, path: str, fields: T.StructType, column: str, most: int) -> bool:
    """Whether a column of the rows kept has no more than ``most`` values; reads that column alone."""
    versions = [v for v, _, _ in _live(spark, path, _newest(spark, path))]
    return _read(spark, path, fields, versions).select(column).distinct().limit(most + 1).count() <= most
