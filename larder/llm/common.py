"""Helpers shared by the text operators: null-safe inputs, row keys, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larder.session import scratch_path

#: ASCII white space, the only white space that normalisation and word splitting look at.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def settled(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of `docs`, with the same rows at the same places each time they are read.

    A scan is that already. Behind a shuffle rows may come in another order when fewer columns are asked
    for or a task runs again, so such a frame is written first.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    return written(texts, "texts") if "Exchange" in plan else texts


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): `row` names the input row, so repeated and null ids stay apart.

    The number follows from the row's place in the scan; a task that runs again gives the same one.
    """
    return docs.select("doc_id", whole_text().alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text"
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and all executors reach, with its scheme."""
    folder = scratch_path(spark, "text")
    return folder if "://" in folder else f"file://{folder}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again.

    Later steps start from files, so a lost executor costs the tasks it held and not the whole
    lineage, and a frame that is used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    # Spark deletes the shuffle files of finished jobs once the driver's garbage is collected
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(schema: str):
    """The Arrow schema of a DDL string; to be called on the driver."""
    return to_arrow_schema(StructType.fromDDL(schema))


def per_batch(function: Callable, schema: str, rows: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A transformation that applies `function(record batch) -> dict of columns` to Arrow batches.

    With `rows`, to parts of so many rows, where a function's own arrays are much larger than the batch.
    """

    def apply(df: DataFrame) -> DataFrame:
        arrow = arrow_schema(schema)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for start in range(0, batch.num_rows, rows or batch.num_rows):
                    columns = function(batch.slice(start, rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
                    )

        return df.mapInArrow(run, schema)

    return apply


#: Places of a bitmap of keys: 8 MB, whatever the number of keys.
PLACES = 1 << 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PLACES)) + 1


def bitmap(places: DataFrame) -> DataFrame:
    """(bucket, bits) of a frame's column `place`, 1 to PLACES: at most PLACES / 32,768 rows of 4 KB."""
    return places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )


def marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`df` with a column `_maybe`: true for each row whose key is among those of `ids`, and for few others.

    The keys' bits come from a bitmap of a fixed size, so rows are told apart where they are read and the plan
    is the same for any number of keys. With far more keys than PLACES all rows are marked; an exact join of
    the marked rows tells them apart.
    """
    bits = bitmap(ids.select(_place(F.col(key)).alias("place"))).select(F.col("bucket").alias("_bucket"), "bits")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = df.withColumn("_place", _place(F.col(key))).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    hit = there.join(F.broadcast(bits), "_bucket", "left").withColumn(
        "_maybe", F.col("bits").isNotNull() & (F.getbit(F.coalesce(byte, F.lit(0)), (at % 8).cast("int")) == 1)
    )
    return hit.drop("_bucket", "_place", "bits")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id is not among those of `ids` (null equals null)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"))
    gone = ids.select(F.col("doc_id").alias("key"))
    rows = marked(packed, "key", gone)
    there = gone.select(F.col("key").alias("gone")).distinct().hint("merge")
    some = rows.where("_maybe").join(there, F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return rows.where(~F.col("_maybe")).select("row.*").union(some.select("row.*"))


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id is among those of `ids` (null equals null)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"))
    wanted = ids.select(F.col("doc_id").alias("key"))
    there = wanted.select(F.col("key").alias("wanted")).distinct().hint("merge")
    some = marked(packed, "key", wanted).where("_maybe")
    return some.join(there, F.col("key").eqNullSafe(F.col("wanted")), "left_semi").select("row.*")
