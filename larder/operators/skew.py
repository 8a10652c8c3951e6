"""Ways to keep one hot key, or a pile of equal rows, from landing in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.functions.numeric import ratio

# One task sorts and buffers this many narrow rows without trouble.
ROWS_PER_TASK = 4_000_000

# Keys are counted by hash bucket, so what is known about hot keys has at most this many
# rows of two numbers (some 12 MB), whatever the table: the bound behind the broadcast.
KEY_BUCKETS = 1 << 20

SLICE, LEAD_IN, COPY, WEIGHT = "_slice", "_lead_in", "_copy", "_weight"
_BUCKET, _DIGITS = "_bucket", "_digits"

# Copies that are laid out from one array at a time
_COPIES_AT_ONCE = 4096


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Buckets of keys with more rows than one task should take, and how finely to cut them.

    The count combines map-side over one narrow column; NULL is a key like any other. The
    hexadecimal ``_digits`` are enough even if all rows of the bucket are of one key and day.
    """
    counted = df.groupBy(_bucket(key).alias(_BUCKET)).agg(F.count(F.lit(1)).alias("_rows"))
    digits = F.ceil(F.log(16.0, F.col("_rows") / rows_per_task))
    return counted.where(F.col("_rows") > rows_per_task).select(
        _BUCKET, F.greatest(F.lit(1), digits).cast("int").alias(_DIGITS)
    )


def row_digest(*columns: str) -> Column:
    """A total, reproducible order among rows of one day; equal only for equal rows."""
    return F.md5(F.concat_ws("|", *[F.col(name).cast("string") for name in columns]))


@dataclass(frozen=True)
class Parts:
    """Rows for a trailing window: items left ``whole``, and hot ones ``cut`` into slices.

    Both have a ``_weight``, the number of original rows a row stands for. They stay two
    frames, so that the plan of whole items is the plain window by key.
    """

    whole: DataFrame
    cut: DataFrame
    whole_order: WindowSpec
    cut_order: WindowSpec

    def compute(self, step: Callable[[DataFrame, WindowSpec], DataFrame]) -> Parts:
        """Window columns on both; afterwards the rows that only led in a slice are gone."""
        cut = step(self.cut, self.cut_order).where(~F.col(LEAD_IN)).drop(LEAD_IN, SLICE, COPY)
        return replace(self, whole=step(self.whole, self.whole_order), cut=cut)

    def filtered(self, condition: Column) -> Parts:
        return replace(self, whole=self.whole.where(condition), cut=self.cut.where(condition))

    def with_column(self, name: str, value: Column) -> Parts:
        return replace(self, whole=self.whole.withColumn(name, value), cut=self.cut.withColumn(name, value))

    def weighted(self) -> DataFrame:
        return self.whole.unionByName(self.cut)

    def repeated(self) -> DataFrame:
        """One output row per original row."""
        return self.whole.drop(WEIGHT).unionByName(repeat_by_weight(self.cut))


def windowed(
    df: DataFrame,
    key: str,
    day: str,
    tie: str,
    before: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> Parts:
    """Rows prepared for a window that looks back at most ``before`` rows within ``key``.

    One plan at every size: nothing runs while it is built. Which keys are cut is known from
    ``hot_buckets`` while the query runs; where there are none, the adaptive planner drops
    that branch. The rows of hot keys are

    * collapsed to distinct rows with a copy count. Only ``before + 1`` copies are laid
      out: from the last of them on, every further copy sees the same window, so that
      one carries the rest as its ``_weight``;
    * cut into slices by day and by leading digits of the digest ``tie``, which follow
      the window order, so a slice is an unbroken run of rows;
    * led in by the ``before`` rows that precede each slice, marked ``_lead_in``.

    Rows of one day and digest are ordered by all their columns: equal rows alone share a place.
    """
    names = df.columns
    rest = [n for n in names if n not in (key, day, tie)]
    order = [F.col(day), F.col(tie), *[F.col(n) for n in rest]]
    graded = df.withColumn(_BUCKET, _bucket(key))
    hot = F.broadcast(hot_buckets(df, key, rows_per_task))

    whole = graded.join(hot, _BUCKET, "left_anti").select(*names, F.lit(1).cast("long").alias(WEIGHT))
    distinct = graded.join(hot, _BUCKET).groupBy(*names, _DIGITS).agg(F.count(F.lit(1)).alias("_n"))
    laid_out = F.least(F.col("_n"), F.lit(before + 1)).cast("int")
    sliced = distinct.select(
        *names,
        F.concat_ws("/", F.col(day).cast("string"), F.col(tie).substr(F.lit(1), F.col(_DIGITS))).alias(SLICE),
        F.explode(F.sequence(F.lit(1), laid_out)).alias(COPY),
        "_n",
    ).select(
        *names,
        SLICE,
        COPY,
        F.when(F.col(COPY) == before + 1, F.col("_n") - before).otherwise(F.lit(1)).cast("long").alias(WEIGHT),
        F.lit(False).alias(LEAD_IN),
    )

    cut_order = [*order, F.col(COPY)]
    newest_first = Window.partitionBy(key, SLICE).orderBy(*[c.desc() for c in cut_order])
    row = F.struct(day, tie, *rest, COPY)
    ends = (
        sliced.withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= before)
        .groupBy(key, SLICE)
        .agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    )
    earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(-before, -1)
    gathered = F.flatten(F.collect_list("_rows").over(earlier))
    last_rows = F.when(F.size(gathered) > before, F.slice(gathered, -before, before)).otherwise(gathered)
    lead_in = (
        ends.select(key, SLICE, last_rows.alias("_rows"))
        .select(key, SLICE, F.explode("_rows").alias("_row"))
        .select(
            *[F.col(key) if name == key else F.col("_row")[name].alias(name) for name in names],
            SLICE,
            F.col("_row")[COPY].alias(COPY),
            F.lit(0).cast("long").alias(WEIGHT),
            F.lit(True).alias(LEAD_IN),
        )
    )
    return Parts(
        whole,
        sliced.unionByName(lead_in),
        Window.partitionBy(key).orderBy(*order),
        Window.partitionBy(key, SLICE).orderBy(*cut_order),
    )


def repeat_by_weight(df: DataFrame) -> DataFrame:
    """Undo the copy count: one output row per original row.

    In two steps, runs of copies and then the copies of a run, so that the array for a pile
    of equal rows is shorter than the pile by that factor.
    """
    names = [n for n in df.columns if n != WEIGHT]
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col(WEIGHT) - 1) / _COPIES_AT_ONCE))
    left = F.col(WEIGHT) - F.col("_run") * _COPIES_AT_ONCE
    copies = F.sequence(F.lit(1).cast("long"), F.least(left, F.lit(_COPIES_AT_ONCE)))
    return (
        df.select(*names, WEIGHT, F.explode(runs).alias("_run"))
        .select(*names, F.explode(copies).alias(COPY))
        .select(*names)
    )


def weighted_mean(name: str) -> Column:
    """Mean over the original rows that have the column."""
    value, weight = F.col(name), F.col(WEIGHT)
    return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Ordered limit that stays parallel for a long list.

    Spark merges an ordered limit in one task, which receives up to ``k`` rows from each
    map task. Here the rows first pass through lanes, each of which keeps its own best
    ``k``; where the session lets a window prune to ``k`` rows
    (``spark.sql.optimizer.windowGroupLimitThreshold``), the map tasks do so before that
    shuffle. Which lane a row takes does not affect the result.
    """
    lanes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    best = (
        df.withColumn("_lane", F.spark_partition_id() % lanes)
        .withColumn("_place", F.row_number().over(Window.partitionBy("_lane").orderBy(*order)))
        .where(F.col("_place") <= k)
        .select(*names)
    )
    return best.orderBy(*order).limit(k)


def amount_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """How often each amount occurs per group; combines map-side."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("unit", F.floor(value))


def exact_median(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median of a two-decimal amount per group, as DOUBLE, from its counts.

    ``median`` would hold every distinct amount of a group in one task. Here a running
    count over whole units finds the unit that holds the middle, and only the (at most
    100) amounts inside that unit are looked at.
    """
    by_unit = Window.partitionBy(group).orderBy("unit")
    middle_low, middle_high = F.floor((F.col("size") + 1) / 2), F.ceil((F.col("size") + 1) / 2)
    holds_middle = (F.col("upto") - F.col("n") < middle_high) & (F.col("upto") >= middle_low)
    units = (
        counts.groupBy(group, "unit")
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(by_unit.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("size", F.sum("n").over(Window.partitionBy(group)))
        .where(holds_middle)
        .select(F.col(group).alias("_g"), F.col("unit").alias("_u"), (F.col("upto") - F.col("n")).alias("below"), "size")
    )
    # null-safe on both columns: no filter is inferred for one side, so both sides stay
    # the same plan and Spark reuses the shuffled counts
    same_unit = F.col(group).eqNullSafe(F.col("_g")) & F.col("unit").eqNullSafe(F.col("_u"))
    by_amount = Window.partitionBy(group, "unit").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(units, same_unit)
        .withColumn("upto", F.col("below") + F.sum("n").over(by_amount))
        .where(holds_middle)
        .groupBy(group)
        .agg(((F.min(value).cast("double") + F.max(value).cast("double")) / 2).alias("median"))
    )
