"""Day folders: a purge rewrites only the days with due rows, and readers open only what counts."""

from __future__ import annotations

import datetime
from pathlib import Path

from larder import schema
from larder.plans import days, logs

AS_OF = "2001-08-01 00:00:00"
T0 = datetime.datetime(2001, 1, 1, 10)
OLD, NEW = datetime.datetime(2001, 2, 1), datetime.datetime(2001, 7, 30)


def _log(spark, root, *alerts):
    shape = "sku_id string, alert_timestamp timestamp_ntz, resolved boolean, resolved_timestamp timestamp_ntz"
    rows = schema.conform(spark.createDataFrame(list(alerts), shape), schema.ALERT_HISTORY)
    manifest = days.write_days(rows, root, "alert_timestamp")
    listed = days.manifest_of(spark, root)
    assert sorted(map(str, manifest.collect())) == sorted(map(str, listed.collect()))
    return listed


def _files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def _later(n):
    return T0 + datetime.timedelta(days=n)


def test_purge_leaves_other_days_alone(spark, tmp_path):
    root, new = str(tmp_path / "log"), str(tmp_path / "kept")
    manifest = _log(
        spark, root,
        ("gone", T0, True, OLD), ("open", T0, False, None),  # a day that keeps one of two
        ("all gone", _later(1), True, OLD), ("all gone", _later(1), True, OLD),  # repeated rows, none stays
        ("fresh", _later(2), True, NEW), ("unknown", _later(3), True, None),  # nothing due
        ("no day", None, True, OLD), ("no day, open", None, False, None),
        ("null flag", _later(4), None, OLD),
    )
    before = _files(root)
    after = days.purge_resolved(spark, manifest, new, AS_OF)
    assert _files(root) == before
    assert {Path(f).parent.name for f in _files(new)} == {"log_date=2001-01-01", f"log_date={days.NO_DAY}"}
    kept = days.open_days(spark, after, schema.ALERT_HISTORY)
    assert sorted(r.sku_id for r in kept.collect()) == ["fresh", "no day, open", "null flag", "open", "unknown"]
    whole = logs.keep_after_purge(days.open_days(spark, manifest, schema.ALERT_HISTORY), AS_OF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, kept.collect()))
    roots = {r.day: r.folder.startswith(new) for r in after.collect()}
    assert roots == {T0.date(): True, None: True, **{_later(n).date(): False for n in (2, 3, 4)}}


def test_purge_without_due_rows_writes_nothing(spark, tmp_path):
    manifest = _log(spark, str(tmp_path / "log"), ("fresh", T0, True, NEW))
    after = days.purge_resolved(spark, manifest, str(tmp_path / "kept"), AS_OF)
    assert after.collect() == manifest.collect() and not (tmp_path / "kept").exists()


def test_purge_of_everything_and_of_nothing(spark, tmp_path):
    manifest = _log(spark, str(tmp_path / "log"), ("gone", T0, True, OLD))
    after = days.purge_resolved(spark, manifest, str(tmp_path / "kept"), AS_OF)
    assert after.count() == 0
    assert days.open_days(spark, after, schema.ALERT_HISTORY).count() == 0
    again = days.purge_resolved(spark, after, str(tmp_path / "again"), AS_OF)
    assert again.count() == 0
    assert days.manifest_of(spark, str(tmp_path / "no such log")).count() == 0


def test_manifest_survives_its_file(spark, tmp_path):
    manifest = _log(spark, str(tmp_path / "log"), ("a", T0, True, OLD), ("b", None, False, None))
    days.save_manifest(manifest, str(tmp_path / "m"))
    assert sorted(map(str, days.read_manifest(spark, str(tmp_path / "m")).collect())) == sorted(map(str, manifest.collect()))


def test_newest_day_reads_one_folder(spark, tmp_path):
    manifest = _log(spark, str(tmp_path / "log"), ("old", T0, True, OLD), ("new", _later(9), False, None), ("no day", None, False, None))
    rows = days.open_days(spark, days.newest(manifest), schema.ALERT_HISTORY)
    assert [r.sku_id for r in rows.collect()] == ["new"]
    assert {Path(f).parent.name for f in rows.inputFiles()} == {"log_date=2001-01-10"}
