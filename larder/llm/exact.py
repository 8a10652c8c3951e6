"""Exact deduplication by content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import SPACE, among, marked, whole_text, without, written


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit hash (as hex) of their normalised text; the smallest doc_id of a
    group stays. Inside each group with more than one row the smallest and the largest text are
    compared byte by byte: where they differ, two texts share a hash, and the rows of that hash are
    grouped by the text itself. Copies are counted in the map tasks, so a group that holds a third of
    all rows sends one row per task.

    Null text counts as empty; empty texts form one group. Rows that repeat the smallest id all
    stay (`kept` compares ids). A null id is kept only where all ids of its group are null.
    Other columns are ignored. An empty table gives an empty result.
    """
    text = normalised(whole_text())
    rows = docs.select(
        "doc_id", content_hash(text).alias("hash"), F.sha2(text, 256).alias("text_sha256")
    )
    groups = rows.groupBy("hash").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("copies"))
    # the join key is another form of the hash: both sides are then dealt out anew, and Spark may split a hot hash
    shared = groups.where("copies > 1").select(F.encode("hash", "utf-8").alias("key"), "smallest", "copies")
    shared = written(shared, "shared")

    # only texts of a group may differ from another; few others come along, and do no harm
    texts = marked(docs.select(F.encode(content_hash(text), "utf-8").alias("key"), "doc_id", text.alias("text")), "key", shared)
    texts = texts.where("_maybe").select("key", "doc_id", "text")
    clashes = (
        texts.groupBy(F.decode("key", "utf-8").alias("hash"))
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .where("low <> high")
        .select("hash")
    )
    clashes = written(clashes, "clashes")

    by_hash = rows.withColumn("key", F.encode("hash", "utf-8")).join(shared, "key", "left")
    if clashes.isEmpty():  # nothing to tell apart: the texts need not be read again
        return _decided(by_hash)
    by_hash = by_hash.join(clashes, "hash", "left_anti").select("doc_id", "text_sha256", "smallest", "copies")
    clashing = (
        texts.withColumn("hash", F.decode("key", "utf-8"))
        .join(clashes, "hash", "left_semi")
        .select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    )
    by_text = clashing.groupBy("text").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("copies"))
    by_bytes = clashing.join(by_text, "text").select("doc_id", "text_sha256", "smallest", "copies")

    return _decided(by_hash.unionByName(by_bytes))


def _decided(grouped: DataFrame) -> DataFrame:
    keep = F.coalesce("smallest", "doc_id")
    return grouped.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept.

    Of rows that repeat both the id and the text one stays.
    """
    decided = written(exact_groups(docs).select("doc_id", "kept", "text_sha256"), "decided")
    gone = decided.where(~F.col("kept")).select("doc_id")
    twice = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice = written(twice, "twice")
    if twice.isEmpty():  # each id names one row
        return without(docs, gone)
    repeated = among(docs, twice)
    packed = repeated.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("key"),
        F.sha2(normalised(whole_text()), 256).alias("digest"),
    )
    keep = decided.where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("kept_digest"))
    same = F.col("key").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("kept_digest"))
    nth = F.row_number().over(Window.partitionBy("key", "digest").orderBy(F.xxhash64("row")))
    once = packed.join(keep, same, "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
    return without(docs, gone.union(twice)).union(once)
