"""Lists for text hold all their items."""

from __future__ import annotations

from larder.operators import summaries


def test_critical_items_beyond_the_tenth_are_listed(rows):
    stock = rows(*[{"sku_id": f"S{k}", "sku_name": f"item {k:02}", "quantity_on_hand": 1 + k % 2} for k in range(25)], {"quantity_on_hand": 10**6})
    got = [r["entry"] for r in summaries.critical_item_entries(stock).collect()]
    assert got == [f"item {k:02} at North has only {n}.00 units left" for n in (1, 2) for k in range(n - 1, 25, 2)]
