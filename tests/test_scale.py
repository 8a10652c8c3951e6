"""Steps that must not send whole tables: what the plans shuffle, and right rows all the same."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrameWriter

from larder.plans import changes, logs
from larder.sources import delimited, sinks
from larder.streaming import state

FIELDS = "name string, n long, change_weight long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_state_without_leaving_rows_is_read_as_it_lies(spark, tmp_path):
    path, schema = str(tmp_path), spark.createDataFrame([], FIELDS).schema
    state.absorb(spark.createDataFrame([("a", 1, 2), ("a", 1, 1), (None, None, 1), ("b", 1, 0)], FIELDS), path, 0)
    now = state.current(spark, path, schema)
    assert "Exchange" not in plan(now)
    assert Counter(map(tuple, now.collect())) == {("a", 1): 3, (None, None): 1}
    state.absorb(spark.createDataFrame([("a", 1, -2), (None, None, -1), ("c", None, 1)], FIELDS), path, 1)
    now = state.current(spark, path, schema)
    assert Counter(map(tuple, now.collect())) == {("a", 1): 1, ("c", None): 1}
    assert "LeftAnti" in plan(now)  # rows that nothing leaves of go past the sum
    assert state.has_few(spark, path, schema, "name", 3) and not state.has_few(spark, path, schema, "name", 2)


def test_difference_fetches_only_rows_that_may_have_changed(spark):
    old = spark.range(200).selectExpr("cast(id as string) sku_id", "'x' batch_id", "id % 5 n")
    new = old.where("sku_id <> '7'")
    diff = changes.inventory_changes(old, new)
    assert [(r["sku_id"], r["change_action"], r["copies"]) for r in diff.collect()] == [("7", "DELETE", 1)]
    assert "bitmap_construct_agg" in plan(changes.inventory_changes(old, new))


def test_raw_files_are_compressed(spark, tmp_path):
    names = delimited.schema.RAW_TEXT.fieldNames()
    delimited.write_raw(spark.createDataFrame([tuple(names)], delimited.schema.RAW_TEXT), str(tmp_path / "out"))
    assert list(Path(tmp_path / "out").glob("*.gz")) and delimited.read_raw(spark, str(tmp_path / "out")).count() == 1


def test_digests_are_made_once_and_changed_rows_sent_once(spark, tmp_path):
    old = [("a", None, 1), ("a", None, 2), (None, None, 1), ("c", "1", 1), ("d", "1", 1), ("d", "1", 1)]
    new = [("a", None, 1), ("a", None, 3), (None, None, 2), ("c", "1", 1), ("d", "1", 1), ("e", "1", 7)]
    fields = "sku_id string, batch_id string, n long"
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/{name}")
    diff = changes.inventory_changes(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("old", "new")])
    got = {(*tuple(r)[:3], r["change_action"], r["is_update"], r["copies"]) for r in diff.collect()}
    assert got == {
        ("a", None, 2, "DELETE", True, 1), ("a", None, 3, "INSERT", True, 1), (None, None, 1, "DELETE", True, 1),
        (None, None, 2, "INSERT", True, 1), ("d", "1", 1, "DELETE", False, 1), ("e", "1", 7, "INSERT", False, 1),
    }
    lines = plan(diff).splitlines()
    assert not any("Filter" in line and "xxhash64" in line for line in lines)
    # whole rows are dealt by their digests alone, not by their keys too
    assert "struct(sku_id" in plan(diff) and not any("Exchange hashpartitioning(sku_id" in line for line in lines)


def test_bitmap_keeps_what_is_wanted_and_little_else(spark):
    df = spark.range(20000).selectExpr("id", "xxhash64(id) h")
    wanted = df.where("id % 4 = 0").select("h")
    kept = {r["id"] for r in changes.may_be_among(df, df["h"], wanted).collect()}
    rest = {r["id"] for r in changes.may_be_among(df, df["h"], wanted, "left_anti").collect()}
    assert set(range(0, 20000, 4)) <= kept and len(kept) < 5010 and kept | rest == set(range(20000)) and not kept & rest
    assert "_words" in plan(changes.may_be_among(df, df["h"], wanted))


def test_whole_alert_rows_are_not_sent_to_meet_the_log(spark, rows):
    stock = rows(*[{"quantity_on_hand": 5, "sku_id": k, "warehouse_location": at, "batch_id": b} for k, at, b in (
        ("S1", "North", "1"), ("S1", "North", "2"), ("S1", "South", "1"), ("S2", "North", "1"), (None, "North", "1"), ("S1", None, "1"),
    )])
    first = logs.new_alerts(stock.where("batch_id = '2'"), stock.sparkSession.createDataFrame([], logs.schema.ALERT_HISTORY), "2001-08-01 00:00:00")
    assert first.count() == 1
    unnamed = first.withColumn("location", first["location"].substr(9, 1)).withColumn("sku_id", first["sku_id"].substr(9, 1))
    due = logs.new_alerts(stock, first.union(first).union(unnamed), "2001-08-01 05:00:00")
    got = Counter((r["sku_id"], r["location"]) for r in due.collect())
    assert got == {("S1", "South"): 1, ("S2", "North"): 1, (None, "North"): 1, ("S1", None): 1}
    assert "bitmap_construct_agg" in plan(due)


def test_scattered_tables_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet

    def watched(self, *args, **kwargs):
        seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    df = spark.range(100).selectExpr("id", "concat('L', id % 80) location")  # more values than files kept open
    for gather in (False, True):
        sinks.materialize(df, f"{tmp_path}/{gather}", gather=gather)
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{gather}").select("id", "location").collect())) == sorted(map(tuple, df.collect()))
    assert seen == [sinks.OPEN_FILES, 0] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
