"""Cleaning rules on hand-made dirty rows, and the delimited file."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder import schema
from larder.functions import cleaning as C
from larder.operators import clean
from larder.sources import delimited


@pytest.mark.parametrize(
    ("rule", "dirty", "expected"),
    [
        (C.money, "$1,234.50", Decimal("1234.50")),
        (C.money, "-$5", Decimal("0.00")),
        (C.money, None, Decimal("0.00")),
        (C.percent, "1234.5%", Decimal("0.00")),
        (C.percent, "-2.5%", Decimal("-2.50")),
        (C.quantity, "-4", Decimal("0.00")),
        (C.quantity, "1,000.256", Decimal("1000.26")),
        (C.quantity, "n/a", Decimal("0.00")),
        (C.signed_quantity, "-4", Decimal("-4.00")),
        (C.whole, "12.7", 13),
        (C.whole, "-3", -3),
        (C.whole, "x", 0),
        (C.whole, "99999999999", 0),
        (C.whole_floored, "-3", 0),
        (C.iso_date, "2024-13-01", None),
        (C.iso_date, "2024-1-1", None),
        (C.iso_date, "2024-02-29", datetime.date(2024, 2, 29)),
        (C.null_tokens, "NULL", None),
        (C.null_tokens, "null", None),
        (C.null_tokens, "", None),
        (C.null_tokens, "Null", "Null"),
        (C.abc_class, None, "C"),
        (C.abc_class, " b ", "B"),
        (C.stock_policy, "lifo", "FIFO"),
        (C.stock_policy, " fefo ", "FEFO"),
        (C.stock_policy, None, "FIFO"),
        (C.note, "   ", None),
        (C.note, " x ", "x"),
        (C.title_case, "in stock", "In Stock"),
        (C.title_case, " FRESH-produce ", "Fresh-Produce"),
        (C.title_case, "food & drink/dry", "Food & Drink/Dry"),
        (C.identifier, "  sku1 ", "SKU1"),
    ],
)
def test_rule(spark, rule, dirty, expected):
    df = spark.createDataFrame([(dirty,)], "v string")
    assert df.select(rule("v")).first()[0] == expected


def _raw(spark, *changes):
    names = schema.RAW_TEXT.fieldNames()
    base = dict.fromkeys(names) | {"sku_id": "s1", "batch_id": "b1"}
    return spark.createDataFrame([tuple((base | c)[n] for n in names) for c in changes], schema.RAW_TEXT)


def test_cleaned_table_has_the_contract(spark):
    df = clean.clean_inventory(_raw(spark, {}))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema.INVENTORY]
    row = df.first()
    assert (row.sku_id, row.abc_class, row.quantity_on_hand, row.lead_time_days) == ("S1", "C", Decimal("0.00"), 0)


def test_rows_without_key_go_to_rejects(spark):
    raw = _raw(spark, {}, {"sku_id": None}, {"batch_id": None}, {"sku_id": None, "batch_id": None})
    assert clean.clean_inventory(raw).count() == 1
    assert sorted(r.reject_reason for r in clean.rejected_rows(raw).collect()) == ["no batch_id", "no sku_id", "no sku_id"]


def test_missing_column_fails_while_planning(spark):
    with pytest.raises(ValueError, match="missing columns: notes"):
        clean.clean_inventory(_raw(spark, {}).drop("notes"))


def test_raw_contract_with_decimals_is_accepted(spark):
    raw = _raw(spark, {"quantity_on_hand": "5", "lead_time_days": "3"})
    typed = schema.conform(raw, schema.RAW)
    row = clean.clean_inventory(typed).first()
    assert (row.quantity_on_hand, row.lead_time_days) == (Decimal("5.00"), 3)


def test_file_reader(spark, tmp_path):
    names = schema.RAW_TEXT.fieldNames()
    values = dict.fromkeys(names, "") | {
        "sku_id": " s9", "sku_name": '"Bolt\t5mm"', "batch_id": "b1", "unit_cost_usd": '"$1,000.00"',
        "notes": "NULL", "category": "null", "quantity_on_hand": "1,5x",
    }
    (tmp_path / "counts.tsv").write_text("\t".join(names) + "\n" + "\t".join(values[n] for n in names) + "\n")
    raw = delimited.read_raw(spark, str(tmp_path))
    first = raw.first()
    assert (first.sku_name, first.notes, first.category, first.supplier_id) == ("Bolt\t5mm", None, None, None)
    loaded = delimited.with_load_time(clean.clean_inventory(raw), "2001-08-01 00:00:00").first()
    assert (loaded.sku_id, loaded.unit_cost_usd, loaded.quantity_on_hand) == ("S9", Decimal("1000.00"), Decimal("0.00"))
    assert loaded.upload_timestamp == datetime.datetime(2001, 8, 1)


def test_written_file_reads_back(spark, tmp_path):
    raw = _raw(spark, {"sku_name": " a\tb ", "notes": 'say "x"'}, {"category": None})
    path = str(tmp_path / "out")
    delimited.write_raw(raw, path)
    key = [F.col(c) for c in ("sku_name", "notes", "category")]
    assert sorted(map(str, delimited.read_raw(spark, path).select(*key).collect())) == sorted(map(str, raw.select(*key).collect()))
