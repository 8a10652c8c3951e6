"""Difference between two states of a table, as change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("sku_id", "batch_id")
BUCKETS = 1024  #: of row digests; as many rows are broadcast at most
PIECE = 1 << 15
PART = 1 << 15  #: places of one part of the bitmap of digests
PARTS = 1 << 14  #: 4 KB each, so 64 MB at most


def _places(digest: Column) -> tuple[Column, list[Column]]:
    """A digest's part of the bitmap and its two places there."""
    # no remainders: these may be null to the planner, which then filters by the digest and makes it once more
    return digest.bitwiseAND(PARTS - 1), [F.shiftright(digest, by).bitwiseAND(PART - 1) for by in (20, 40)]


def may_be_among(df: DataFrame, digest: Column, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose digest is in ``wanted``, one column, and few others; all the rest with ``left_anti``.

    Rows are told apart where they are read, so those that nothing is to be done for are not sent anywhere.
    Digests are dealt out by their part of the bitmap first: each part is made once, not once a task. A digest
    has two places; with a twelfth as many digests as places one other row in fifty is taken for one of them.
    A part is looked up as 64-bit words, which are read where they lie.
    """
    part, places = _places(F.col(wanted.columns[0]))
    dealt = wanted.select(part.alias("_of"), F.explode(F.array(*places)).alias("_bit")).repartition("_of")
    bits = dealt.groupBy("_of").agg(F.bitmap_construct_agg("_bit").alias("_bits"))

    def word(k: Column) -> Column:
        return F.conv(F.hex(F.substring("_bits", k * 8 + 1, F.lit(8))), 16, -10).cast("long")

    words = bits.select("_of", F.transform(F.sequence(F.lit(0), F.lit(PART // 64 - 1)), word).alias("_words"))
    part, places = _places(digest)
    names = [f"_place{k}" for k in range(len(places))]
    there = df.withColumns({"_part": part, **{n: p.cast("int") for n, p in zip(names, places, strict=True)}})
    hit = F.lit(True)
    for at in map(F.col, names):
        # a word's first byte is its highest one
        bit = 56 - at.bitwiseAND(56) + at.bitwiseAND(7)
        hit = hit & (F.getbit(F.get("_words", F.shiftright(at, 6)), bit) == 1)
    return there.join(F.broadcast(words), (F.col("_part") == F.col("_of")) & hit, how).drop("_part", *names)


def _digested(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Rows with two 64-bit digests of their columns, which tell NULLs apart, and a bucket."""
    marked = [*columns, *[F.isnull(c) for c in columns]]
    rows = df.select("*", F.xxhash64(*marked).alias("_d"), F.xxhash64(F.lit(1), *marked).alias("_e"))
    return rows.withColumn("_b", F.coalesce(F.pmod("_d", F.lit(buckets)).cast("int"), F.lit(0)))  # never null to the planner


def _stacked(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both states with weights. Digests come after the union, which gives both the same types."""
    columns = old.columns
    weighed = old.withColumn("_w", F.lit(-1).cast("long")).unionByName(new.select(*columns).withColumn("_w", F.lit(1).cast("long")))
    return _digested(weighed, columns, BUCKETS)


def _changed_buckets(stacked: DataFrame) -> DataFrame:
    """Buckets whose rows differ as a whole: digests are added up with their weights, in any order."""
    sums = [F.sum(F.col(c).cast("decimal(20,0)") * F.col("_w")).alias(c) for c in ("_d", "_e")]
    totals = stacked.groupBy("_b").agg(F.sum("_w").alias("_w"), *sums)
    return totals.where((F.col("_w") != 0) | (F.col("_d") != 0) | (F.col("_e") != 0)).select("_b")


def _difference(stacked: DataFrame, columns: list[str], key: tuple[str, ...]) -> DataFrame:
    net = stacked.groupBy("_d", "_e").agg(F.sum("_w").alias("_net")).where(F.col("_net") != 0)
    some = may_be_among(stacked.select(*columns, "_d", "_e"), F.col("_d"), net.select("_d"))
    found = some.select(F.struct(*columns).alias("_row"), "_d", "_e").join(net, ["_d", "_e"])
    net = found.groupBy("_d", "_e").agg(F.first("_row").alias("_row"), F.first("_net").alias("_net"))
    # rows stay where their digests brought them: keys are compared, and updates marked, by narrow rows
    keyed = net.select("_d", "_e", "_net", *[F.col("_row")[k].alias(f"_{k}") for k in key])
    both = (
        keyed.groupBy(*[F.col(f"_{k}").alias(f"_of_{k}") for k in key])
        .agg(F.min("_net").alias("_low"), F.max("_net").alias("_high"))
        .where((F.col("_low") < 0) & (F.col("_high") > 0))
    )
    same_key = F.lit(True)
    for k in key:
        same_key = same_key & F.col(f"_{k}").eqNullSafe(F.col(f"_of_{k}"))
    updates = keyed.join(both, same_key, "left_semi").select("_d", "_e", F.lit(True).alias("_both"))
    return net.join(updates, ["_d", "_e"], "left").select(
        *[F.col("_row")[c].alias(c) for c in columns],
        F.when(F.col("_net") > 0, "INSERT").otherwise("DELETE").alias("change_action"),
        F.coalesce("_both", F.lit(False)).alias("is_update"),
        F.abs("_net").alias("copies"),
    )


def inventory_changes(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows to take out of ``old`` and to put in to reach ``new``, with copy counts.

    A multiset difference by 128-bit row digests. Buckets of digests are compared as sums first; of those that
    differ, (digests, weight) are added up, map-side too, so that neither a key with very many rows nor a pile
    of equal rows gathers anywhere; only rows that changed are fetched, and a bitmap of their digests tells them
    apart where they lie. Repeated keys never multiply as they would in a full outer join. ``is_update`` marks rows whose key leaves and enters at once.
    """
    stacked = _stacked(old, new)
    touched = stacked.join(F.broadcast(_changed_buckets(stacked)), "_b", "left_semi")
    return _difference(touched, old.columns, key)


def has_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: does the table differ at all? Sums per bucket tell."""
    return _changed_buckets(_stacked(old, new)).agg((F.count(F.lit(1)) > 0).alias("has_data"))


def write_state(df: DataFrame, path: str, buckets: int = 64) -> None:
    """A state with its digests, laid out by their buckets. States to be compared need the same column types and buckets."""
    rows = _digested(df, df.columns, buckets).hint("rebalance", F.col("_b"))
    rows.write.mode("errorifexists").partitionBy("_b").parquet(path)


def state_changes(spark: SparkSession, old_path: str, new_path: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """``inventory_changes`` of two written states: digests are read whole, rows only of buckets that differ."""
    old, new = spark.read.parquet(old_path), spark.read.parquet(new_path)
    columns = [c for c in old.columns if c not in ("_d", "_e", "_b")]
    stacked = old.withColumn("_w", F.lit(-1).cast("long")).unionByName(new.withColumn("_w", F.lit(1).cast("long")))
    buckets = [r["_b"] for r in _changed_buckets(stacked).collect()]  # a number per folder at most
    return _difference(stacked.where(F.col("_b").isin(buckets)), columns, key)


def repeated(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as its count says, without the count; in pieces, so that no large array is made."""
    names, n = [c for c in df.columns if c != count], F.col(count)
    pieces = df.select(*names, count, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / PIECE))).alias("_piece"))
    size = F.least(F.lit(PIECE).cast("long"), n - F.col("_piece") * PIECE)
    return pieces.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_i")).drop("_i")


def standing(weighted: DataFrame, weight: str, leaving: DataFrame) -> DataFrame:
    """The rows that weights add up to, each as often as it is there; ``leaving`` holds the rows of negative weight.

    Only rows that may equal one of those are added up. All others stand as they are, wherever they lie.
    """
    columns = [c for c in weighted.columns if c != weight]
    digest = F.xxhash64(*columns)
    gone = leaving.select(digest.alias("_gone"))
    met = may_be_among(weighted, digest, gone).groupBy(*columns).agg(F.sum(weight).alias(weight))
    apart = may_be_among(weighted, digest, gone, "left_anti").select(*columns, weight)
    return repeated(apart.unionByName(met).where(F.col(weight) > 0), weight)


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Bring ``old`` up to date with a change frame; the inverse of ``inventory_changes``."""
    columns = old.columns
    signed = F.when(F.col("change_action") == "INSERT", F.col("copies")).otherwise(-F.col("copies"))
    weighed = old.withColumn("_w", F.lit(1).cast("long")).unionByName(changes.select(*columns, signed.alias("_w")))
    net = weighed.groupBy(*columns).agg(F.sum("_w").alias("_net")).where(F.col("_net") > 0)
    return repeated(net, "_net")
