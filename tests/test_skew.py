"""Hot keys and piles of equal rows: the cut-up windows against plain ones and brute force."""

from __future__ import annotations

import datetime
import hashlib
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.operators import skew, windows

AS_OF = "2001-08-01 00:00:00"
DAY = datetime.date(2001, 7, 1)


def _skewed(rows):
    """One item with most rows, one day of it with most of those, and piles of equal rows."""
    changes = [{"sku_id": "COLD", "batch_id": f"C{i}", "audit_date": DAY + datetime.timedelta(i), "quantity_on_hand": 5 * i % 7} for i in range(9)]
    for i in range(160):
        day = DAY + datetime.timedelta(0 if i % 3 else i % 11)
        changes.append({
            "sku_id": "HOT", "batch_id": f"H{i}", "audit_date": day, "quantity_on_hand": (i * 37) % 50,
            "avg_daily_sales": (i * 13) % 17, "warehouse_location": f"L{i % 3}",
        })
    changes += [{"sku_id": "HOT", "batch_id": "PILE", "audit_date": DAY, "quantity_on_hand": 400, "avg_daily_sales": 3}] * 70
    changes += [{"sku_id": "HOT", "batch_id": "PAIR", "audit_date": DAY + datetime.timedelta(3), "quantity_on_hand": 2}] * 2
    changes += [{"sku_id": "HOT", "batch_id": "THIRTY", "audit_date": DAY + datetime.timedelta(4), "quantity_on_hand": 9}] * 30
    changes += [{"sku_id": "HOT", "batch_id": "LAST", "audit_date": DAY + datetime.timedelta(20), "quantity_on_hand": 900}]
    return rows(*changes)


@pytest.fixture(scope="module")
def skewed(spark, rows):
    from larder.session import scratch_path

    path = scratch_path(spark, "skewed")
    _skewed(rows).write.parquet(path)
    return spark.read.parquet(path)


def _rows(df, digits=9):
    return Counter(
        tuple(round(v, digits) if isinstance(v, float) else v for v in row) for row in df.collect()
    )


def _ordered(df):
    """Rows of each item in window order, in plain Python."""
    items = {}
    for row in df.collect():
        text = "|".join(str(row[c]) for c in windows.TIE_COLUMNS)
        items.setdefault(row.sku_id, []).append((row.audit_date, hashlib.md5(text.encode()).hexdigest(), row))
    return {sku: [r for _, _, r in sorted(rows, key=lambda t: t[:2])] for sku, rows in items.items()}


@pytest.mark.parametrize("rows_per_task", [5, 40, 10_000])
def test_audit_changes_match_brute_force(skewed, rows_per_task):
    expected = Counter()
    for sku, items in _ordered(skewed).items():
        for before, row in zip([None, *items], items):
            prev = None if before is None else float(before.quantity_on_hand)
            change = None if before is None else float(row.quantity_on_hand) - prev
            expected[(sku, row.audit_date, row.quantity_on_hand, row.warehouse_location, prev, change)] += 1
    assert _rows(windows.audit_changes(skewed, AS_OF, 90, rows_per_task)) == expected


@pytest.mark.parametrize("rows_per_task", [5, 40, 10_000])
def test_trailing_demand_matches_brute_force(skewed, rows_per_task):
    expected = Counter()
    for sku, items in _ordered(skewed).items():
        sales = [float(r.avg_daily_sales) for r in items]
        for i, row in enumerate(items):
            last = sales[max(0, i - 29): i + 1]
            spread = round(statistics.stdev(last), 4) if len(last) > 1 else None
            expected[(sku, row.audit_date, sales[i], row.warehouse_location, round(statistics.fmean(last), 4), spread)] += 1
    got = windows.trailing_demand(skewed, AS_OF, 90, rows_per_task)
    assert _rows(got, 4) == expected


@pytest.mark.parametrize("rows_per_task", [5, 40])
@pytest.mark.parametrize("table", [windows.inventory_anomalies, windows.demand_forecast])
def test_cut_tables_equal_plain_tables(skewed, table, rows_per_task):
    plain = _rows(table(skewed, AS_OF, 90), 6)
    assert plain
    assert _rows(table(skewed, AS_OF, 90, rows_per_task), 6) == plain


def test_only_frequent_keys_are_hot(skewed):
    def items_of(hot):
        named = skewed.withColumn(skew._BUCKET, skew._bucket("sku_id")).join(hot, skew._BUCKET)
        return {(r.sku_id, r._digits) for r in named.select("sku_id", skew._DIGITS).collect()}

    assert items_of(skew.hot_buckets(skewed, "sku_id", 100)) == {("HOT", 1)}
    assert items_of(skew.hot_buckets(skewed, "sku_id", 10)) == {("HOT", 2)}
    assert items_of(skew.hot_buckets(skewed, "sku_id", 10_000)) == set()


def test_slices_of_a_hot_item_stay_small(skewed):
    recent = windows._recent(skewed, AS_OF, 90, "quantity_on_hand")
    parts = skew.windowed(recent, "sku_id", "audit_date", "tie", 1, 20)
    sizes = parts.cut.groupBy("sku_id", skew.SLICE).count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * 20
    assert {r.sku_id for r in parts.whole.collect()} == {"COLD"}
    assert parts.compute(lambda rows, order: rows).weighted().agg(F.sum(skew.WEIGHT)).first()[0] == skewed.count()


@pytest.fixture(scope="module")
def unnamed(spark, skewed):
    """The hot item without its name, a pile of rows of one tie that differ elsewhere, and a steady item."""
    from larder.session import scratch_path

    sku = F.when(F.col("sku_id") != "HOT", F.col("sku_id"))
    alike = skewed.where("batch_id = 'PILE'").limit(1).crossJoin(spark.range(40))
    # the same identifying fields, other sales
    alike = alike.withColumn("avg_daily_sales", F.col("id").cast("decimal(18,2)")).select(skewed.columns)
    steady = skewed.where("batch_id = 'LAST'").crossJoin(spark.range(12).toDF("n"))
    steady = steady.withColumns({
        "sku_id": F.lit("STEADY"),
        "audit_date": F.expr("date_add(audit_date, -cast(n as int))"),
        "quantity_on_hand": (F.col("n") * 0 + 900 - F.col("n") * 3).cast(skewed.schema["quantity_on_hand"].dataType),
    }).select(skewed.columns)
    path = scratch_path(spark, "unnamed")
    skewed.unionByName(alike.to(skewed.schema)).withColumn("sku_id", sku).unionByName(steady.to(skewed.schema)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "table", [windows.audit_changes, windows.change_statistics, windows.trailing_demand, windows.demand_forecast]
)
def test_items_without_a_name_are_cut_too(unnamed, table):
    plain = _rows(table(unnamed, AS_OF, 90), 4)
    assert sum(plain.values()) and any(row[0] is None for row in plain)
    assert _rows(table(unnamed, AS_OF, 90, 8), 4) == plain


@pytest.mark.parametrize("rows_per_task", [5, 10_000])
def test_statistics_match_brute_force(unnamed, rows_per_task):
    expected = Counter()
    for sku, items in _ordered(unnamed).items():
        pairs = [(b.audit_date, float(b.quantity_on_hand) - float(a.quantity_on_hand)) for a, b in zip(items, items[1:])]
        changes = [c for _, c in pairs]
        mean, spread = statistics.fmean(changes), statistics.stdev(changes) if len(changes) > 1 else None
        for day, change in pairs:
            score = round((change - mean) / spread, 4) if spread else None
            expected[(sku, day, change, round(mean, 4), None if spread is None else round(spread, 4), score)] += 1
    got = _rows(windows.change_statistics(unnamed, AS_OF, 90, rows_per_task), 4)
    assert got == expected
    assert any(row[0] == "STEADY" and row[4] == 0.0 and row[5] is None for row in got)


@pytest.mark.parametrize(
    "table",
    [windows.audit_changes, windows.inventory_anomalies, windows.trailing_demand, windows.demand_forecast],
)
def test_building_a_window_query_starts_no_job(spark, skewed, table):
    group = f"building {table.__name__}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        table(skewed, AS_OF, 90, 5)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_large_piles_come_back_from_short_runs(spark):
    df = spark.createDataFrame([("a", 1), ("b", 4096), ("c", 4097), ("d", 20_001)], f"k string, {skew.WEIGHT} bigint")
    got = {r.k: r["count"] for r in skew.repeat_by_weight(df).groupBy("k").count().collect()}
    assert got == {"a": 1, "b": 4096, "c": 4097, "d": 20_001}


@pytest.mark.parametrize("k", [3, 10, 1500])
def test_top_k_lanes_equal_sort(spark, k):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("a"), "id")
    order = [F.desc("a"), F.asc("id")]
    got = [tuple(r) for r in skew.top_k(df, order, k).collect()]
    assert got == sorted(((r.a, r.id) for r in df.collect()), key=lambda r: (-r[0], r[1]))[:k]


def test_long_top_k_prunes_before_its_shuffle(spark):
    df = spark.range(0, 5000, 1, 7)
    plan = skew.top_k(df, [F.desc("id")], 1500)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_exact_median(spark):
    amounts = {"A": ["1.00"], "B": ["1.10", "1.90"], "C": ["2.00", "2.00", "7.25", "9.99"], "D": ["0.01", "5.00", "5.01"]}
    data = [(k, v) for k, vs in amounts.items() for v in vs] + [("C", None)]
    df = spark.createDataFrame(data, "g string, v string").select("g", F.col("v").cast("decimal(18,2)").alias("v"))
    got = {r.g: r.median for r in skew.exact_median(skew.amount_counts(df, "g", "v"), "g", "v").collect()}
    assert got == pytest.approx({k: statistics.median(float(v) for v in vs) for k, vs in amounts.items()})
