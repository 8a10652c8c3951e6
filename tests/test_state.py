"""State that follows a stream of changes, over days and many batches, and the change feed behind it."""

from __future__ import annotations

import random
import time
from collections import Counter

from larder.operators import items, summaries
from larder.plans import changes, logs
from larder.sources import tables
from larder.streaming import changes as stream
from larder.streaming import state


def counted(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_rows_that_leave_on_a_later_day_are_gone(spark, inventory, tmp_path):
    base, some = str(tmp_path), inventory.orderBy("sku_id", "batch_id").limit(300)
    some.write.parquet(f"{base}/some")
    some = spark.read.schema(inventory.schema).parquet(f"{base}/some")

    def run():
        feed = stream.read_changes(spark, f"{base}/feed")
        stream.stream_refresh(feed, "active_alerts", f"{base}/state", "", f"{base}/ck", lag=None).awaitTermination()

    stream.publish_load(some, f"{base}/feed")
    run()
    for day in ("2001-08-01 00:00:00", "2001-08-05 00:00:00"):
        want = items.active_alerts(some, day)
        assert counted(stream.current_items(spark, "active_alerts", f"{base}/state", day)) == counted(want) and want.count() > 0
    stream.publish_items(spark, "active_alerts", f"{base}/state", day, f"{base}/table")
    assert tables.read_active_alerts(spark, f"{base}/table").count() == want.count()
    stream.publish_changes(some, some.limit(0), f"{base}/feed")
    run()
    assert stream.current_items(spark, "active_alerts", f"{base}/state", "2001-08-02 00:00:00").count() == 0


def test_many_batches_leave_few_files_and_the_right_rows(spark, tmp_path):
    rng, path, fields = random.Random(3), str(tmp_path), "name string, n long, change_weight long"
    held, most = Counter(), 0
    for batch_id in range(30):
        rows = []
        for _ in range(rng.choice((1, 3, 40))):
            row = (rng.choice(("a", "b", None)), rng.choice((*range(12), None)))
            weight = -1 if held[row] > 0 and rng.random() < 0.5 else rng.choice((1, 1, 2))
            held[row] += weight
            rows.append((*row, weight))
        for again in range(1 + (batch_id == 9)):  # a batch that runs again replaces itself
            state.absorb(spark.createDataFrame(rows, fields), path, batch_id, buckets=3)
        most = max(most, *map(len, state.live_files(spark, path, batch_id).values()))
    got = state.current(spark, path, spark.createDataFrame([], fields).schema)
    assert Counter(map(tuple, got.collect())) == +held
    assert 2 < most <= state.FILES + 1


def test_a_pile_of_equal_rows_comes_back_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(changes, "PIECE", 10)
    got = changes.repeated(spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "x string, n long"), "n")
    assert Counter(r["x"] for r in got.collect()) == {"a": 25, "b": 1, "c": 10}


def test_time_alone_alerts_again(spark, rows, tmp_path):
    base = str(tmp_path)
    clock = ("2001-08-01 00:00:00", "2001-08-01 05:00:00", "2001-08-02 01:00:00")

    def run():
        feed = stream.read_changes(spark, f"{base}/feed")
        stream.stream_alerts(feed, f"{base}/history", f"{base}/ck", clock.__getitem__, lag=None).awaitTermination()
        return sorted((r["batch_id"], r["sku_id"]) for r in spark.read.parquet(f"{base}/history").collect())

    stream.publish_load(rows({"quantity_on_hand": 5}, {"quantity_on_hand": 500, "sku_id": "S2"}), f"{base}/feed")
    assert run() == [(0, "S1")]
    stream.publish_heartbeat(spark, f"{base}/feed")
    assert run() == [(0, "S1")]
    stream.publish_heartbeat(spark, f"{base}/feed")
    assert run() == [(0, "S1"), (2, "S1")]
    # only what needs attention is kept
    assert {r["sku_id"] for r in state.current(spark, f"{base}/history-stock", stream.CHANGE_ROWS).collect()} == {"S1"}


def test_heartbeats_let_batches_run_without_changes(spark, rows, tmp_path):
    base, seen = str(tmp_path), []
    stream.publish_load(rows({}), f"{base}/feed")
    beating = stream.with_heartbeat(stream.read_changes(spark, f"{base}/feed"))
    query = stream._start(beating, lambda batch, k: seen.append(batch.where("change_weight <> 0").count()), f"{base}/ck", "1 second")
    until = time.time() + 60
    while len(seen) < 3 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert len(seen) >= 3 and sum(seen) == 1


def test_changes_by_digests(spark, tmp_path):
    fields = "sku_id string, batch_id string, a string, b string, n long"
    old = [("s", "1", None, "x", k % 7) for k in range(60)] + [("t", "1", "x", None, 1), ("u", None, None, None, None)] * 2
    new = [("s", "1", None, "x", k % 7) for k in range(58)] + [("t", "1", None, "x", 1), ("u", None, None, None, None)] * 2
    left, right = (spark.createDataFrame(r, fields) for r in (old, new))
    want = Counter(new)
    want.subtract(Counter(old))
    for k, df in enumerate((left, right)):
        changes.write_state(df, f"{tmp_path}/{k}")
    written = changes.state_changes(spark, f"{tmp_path}/0", f"{tmp_path}/1")
    for diff in (changes.inventory_changes(left, right), written):
        got = {tuple(r)[:5]: r["copies"] * (1 if r["change_action"] == "INSERT" else -1) for r in diff.collect()}
        assert got == {row: n for row, n in want.items() if n}
        assert {r["sku_id"]: r["is_update"] for r in diff.collect()}["t"] is True
    assert counted(changes.apply_changes(left, written)) == counted(right)
    plan = changes.inventory_changes(left, right)._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [_d" in line]
    assert sums and all("sku_id" not in line.split("Aggregate")[1].split("],")[0] for line in sums)
    same = changes.state_changes(spark, f"{tmp_path}/0", f"{tmp_path}/0")
    assert same.count() == 0 and not changes.has_changes(left, left).first()["has_data"]
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_b" in plan  # folders of equal buckets aren't listed


def test_the_last_move_counts_whatever_the_order_of_arrival(spark):
    log = spark.createDataFrame([(k, "PENDING", None, None) for k in range(4)], "action_id long, status string, order_date date, actual_delivery_date date")
    moves = [(0, "ORDERED", 1), (0, "DELIVERED", 2), (1, "DELIVERED", 5), (1, "ORDERED", 3), (2, "ORDERED", 1), (2, "CANCELLED", 1)]
    for order in (moves, moves[::-1]):
        df = spark.createDataFrame(order, "action_id long, status string, at long")
        moved = {r["action_id"]: r for r in logs.move_reorders(log, df, "2001-08-01 00:00:00", sequence="at").collect()}
        assert [moved[k]["status"] for k in range(4)] == ["DELIVERED", "DELIVERED", "PENDING", "PENDING"]
        assert moved[0]["order_date"] is None and str(moved[0]["actual_delivery_date"]) == "2001-08-01"
        assert [tuple(r) for r in logs.clashing_moves(df, sequence="at").collect()] == [(2, "CANCELLED", "ORDERED")]
        undated = {r["action_id"]: r["status"] for r in logs.move_reorders(log, df.drop("at"), "2001-08-01").collect()}
        assert undated == dict.fromkeys(range(4), "PENDING") and logs.clashing_moves(df.drop("at")).count() == 3


def test_texts_hold_all_critical_items_in_order(spark, rows):
    stock = rows(*[{"quantity_on_hand": k % 19, "sku_name": f"n{k:03d}"} for k in range(250)], {"sku_name": None, "quantity_on_hand": 1})
    parts = [r["critical_items"] for r in summaries.critical_item_list(stock).orderBy("part").collect()]
    want = sorted((k % 19, f"n{k:03d} at North has only {k % 19}.00 units left") for k in range(250))
    assert len(parts) == 3 and ", ".join(parts) == ", ".join(e for _, e in want)
    assert [r["critical_categories"] for r in summaries.critical_categories(stock).collect()] == ["Tools"]
