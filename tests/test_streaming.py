"""Streams fed from files equal the batch results, also when a batch runs again."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from larder.operators import rollups
from larder.plans.registry import later_state
from larder.streaming import changes as stream

AS_OF = "2001-08-01 00:00:00"


def _same(left, right):
    columns = sorted(left.columns)
    return Counter(map(tuple, left.select(*columns).collect())) == Counter(map(tuple, right.select(*columns).collect()))


def test_heatmap_stream_follows_inserts_updates_and_deletes(spark, inventory, tmp_path):
    base = str(tmp_path)
    later = later_state(inventory)

    def run():
        feed = stream.read_changes(spark, f"{base}/feed")
        stream.stream_rollup(feed, "category_heatmap", f"{base}/cells", f"{base}/map", f"{base}/ck").awaitTermination()

    stream.publish_load(inventory, f"{base}/feed")
    run()
    assert _same(stream.current_table(spark, f"{base}/map"), rollups.category_heatmap(inventory))
    stream.publish_changes(inventory, later, f"{base}/feed")
    run()
    assert _same(stream.current_table(spark, f"{base}/map"), rollups.category_heatmap(later))

    stream.compact_cells(spark, "category_heatmap", f"{base}/cells", f"{base}/compact", up_to_batch=1)
    folded = spark.read.parquet(f"{base}/compact").drop("batch_id")
    assert _same(rollups.heatmap_from_cells(folded), rollups.category_heatmap(later))


def test_many_small_batches_give_the_same_map(spark, inventory, tmp_path):
    base = str(tmp_path)
    stream.publish_load(inventory.repartition(4), f"{base}/feed")
    feed = stream.read_changes(spark, f"{base}/feed", files_per_batch=1)
    query = stream.stream_rollup(feed, "category_heatmap", f"{base}/cells", f"{base}/map", f"{base}/ck")
    query.awaitTermination()
    assert spark.read.parquet(f"{base}/cells").select("batch_id").distinct().count() >= 2
    assert _same(stream.current_table(spark, f"{base}/map"), rollups.category_heatmap(inventory))


def test_alert_batch_that_runs_again_replaces_itself(spark, rows, tmp_path):
    base = str(tmp_path)

    def run(checkpoint):
        feed = stream.read_changes(spark, f"{base}/feed")
        stream.stream_alerts(feed, f"{base}/history", f"{base}/{checkpoint}", lambda _: AS_OF, lag=None).awaitTermination()
        return spark.read.parquet(f"{base}/history").groupBy("batch_id").count().orderBy("batch_id").collect()

    stream.publish_load(rows({"quantity_on_hand": 5}, {"quantity_on_hand": 5, "batch_id": "B2"}), f"{base}/feed")
    assert [tuple(r) for r in run("ck")] == [(0, 2)]
    # a lost checkpoint makes batch 0 run again
    assert [tuple(r) for r in run("other")] == [(0, 2)]
    # the next batch is checked against the alerts of the first
    stream.publish_load(rows({"quantity_on_hand": 4}, {"quantity_on_hand": 4, "sku_id": "S2"}), f"{base}/feed")
    assert [tuple(r) for r in run("other")] == [(0, 2), (1, 1)]
    latest = spark.read.parquet(f"{base}/history").where(F.col("batch_id") == 1).first()
    assert latest.sku_id == "S2"


def test_unchanged_and_removed_items_in_later_alert_batches(spark, rows, tmp_path):
    base = str(tmp_path)
    clocks = ["2001-08-01 00:00:00", "2001-08-02 01:00:00", "2001-08-03 02:00:00"]

    def run():
        feed = stream.read_changes(spark, f"{base}/feed")
        stream.stream_alerts(feed, f"{base}/history", f"{base}/ck", clocks.__getitem__, lag=None).awaitTermination()
        return sorted((r["batch_id"], r["sku_id"]) for r in spark.read.parquet(f"{base}/history").collect())

    one, other = {"quantity_on_hand": 5}, {"quantity_on_hand": 5, "sku_id": "S2"}
    stream.publish_load(rows(one), f"{base}/feed")
    assert run() == [(0, "S1")]
    stream.publish_load(rows(other), f"{base}/feed")
    assert run() == [(0, "S1"), (1, "S1"), (1, "S2")]
    stream.publish_changes(rows(one, other), rows(other), f"{base}/feed")
    assert run() == [(0, "S1"), (1, "S1"), (1, "S2"), (2, "S2")]
