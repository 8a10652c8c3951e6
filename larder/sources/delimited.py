"""The stock-count file: tab separated, one header line, optional double quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schema
from larder.functions.cleaning import null_tokens

# The file format.
FORMAT = {"sep": "\t", "header": "true", "quote": '"', "enforceSchema": "true", "mode": "PERMISSIVE"}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every field as text, null tokens nulled; the schema is declared, never inferred."""
    lines = spark.read.options(**FORMAT).schema(schema.RAW_TEXT).csv(path)
    return lines.select(*[null_tokens(name).alias(name) for name in lines.columns])


def with_load_time(df: DataFrame, loaded_at: str) -> DataFrame:
    return df.withColumn("upload_timestamp", F.lit(loaded_at).cast("timestamp_ntz"))


def write_raw(df: DataFrame, path: str) -> None:
    """Write raw columns in the same format (NULL as the token ``NULL``), a compressed file per task."""
    text = df.select(*[F.col(n).cast("string").alias(n) for n in schema.RAW_TEXT.fieldNames()])
    text.write.mode("overwrite").options(sep="\t", header="true", quote='"', nullValue="NULL", compression="gzip", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
