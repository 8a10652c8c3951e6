"""Inventory tables derived from the star-schema test tables.

The texts are portable: the same statement builds the table here and, as a CTE, in the
checking database. A deployment reads its own typed table instead (see ``tables``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01 00:00:00"

# Only the needed columns, typed up front: no footer-reading job per table.
_TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_type string, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}

INVENTORY_SQL = """
WITH base AS (
  SELECT l.l_shipdate, l.l_quantity, l.l_extendedprice, p.p_name, p.p_type, p.p_retailprice, s.s_name, n.n_name, n.n_nationkey, o.o_orderdate,
    CAST(l.l_partkey AS BIGINT) AS pk, CAST(l.l_suppkey AS BIGINT) AS sk, CAST(l.l_orderkey AS BIGINT) AS ok, CAST(l.l_linenumber AS BIGINT) AS ln
  FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {nation} n ON s.s_nationkey = n.n_nationkey
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
), d AS (
  SELECT *, CAST((pk * 7 + sk * 3) % 41 AS DECIMAL(18,2)) * CAST(0.25 AS DECIMAL(3,2)) AS ads0,
    1 + (sk * 5 + pk) % 14 AS lead0
  FROM base
)
SELECT concat('SKU', CAST(pk AS STRING)) AS sku_id, p_name AS sku_name, p_type AS category,
  CASE WHEN pk % 10 < 2 THEN 'A' WHEN pk % 10 < 5 THEN 'B' ELSE 'C' END AS abc_class,
  concat('SUP', CAST(sk AS STRING)) AS supplier_id, s_name AS supplier_name,
  concat('WH', CAST(n_nationkey AS STRING)) AS warehouse_id, n_name AS warehouse_location,
  concat('B', CAST(ok AS STRING), '-', CAST(ln AS STRING)) AS batch_id,
  CAST(l_shipdate AS DATE) AS received_date,
  CAST(o_orderdate AS DATE) + CAST(-((pk + ok) % 60) AS INT) AS last_purchase_date,
  CAST(l_shipdate AS DATE) + CAST(30 + (pk * 3 + ok) % 700 AS INT) AS expiry_date,
  CAST(o_orderdate AS DATE) AS audit_date,
  CAST((ok * 5 + ln) % 400 AS INT) AS stock_age_days,
  CAST(CASE WHEN (ok * 3 + ln) % 29 = 0 THEN 0 ELSE CAST(l_quantity AS INT) + (ok + ln) % 60 END AS DECIMAL(18,2)) AS quantity_on_hand,
  CAST((ok + ln * 2) % 6 AS DECIMAL(18,2)) AS quantity_reserved,
  CAST((ok * 2 + ln) % 5 AS DECIMAL(18,2)) AS quantity_committed,
  CAST(CASE WHEN (ok + ln) % 17 = 0 THEN 2 ELSE 0 END AS DECIMAL(18,2)) AS damaged_qty,
  CAST((pk + ln) % 3 AS DECIMAL(18,2)) AS returns_qty,
  CAST(ads0 AS DECIMAL(18,2)) AS avg_daily_sales,
  CAST(CAST(ads0 * 30 AS DECIMAL(18,0)) AS INT) AS forecast_next_30d,
  CAST((ok + pk) % 90 AS DECIMAL(18,2)) AS days_of_inventory,
  CAST((pk * 3 + sk) % 20 AS DECIMAL(18,2)) AS sku_churn_rate,
  CAST(1 + (pk + sk) % 8 AS DECIMAL(18,2)) AS order_frequency_per_month,
  CAST(10 + pk % 16 + ads0 * lead0 AS DECIMAL(18,2)) AS reorder_point,
  CAST(10 + pk % 16 AS DECIMAL(18,2)) AS safety_stock,
  CAST(lead0 AS INT) AS lead_time_days,
  CAST(p_retailprice AS DECIMAL(18,2)) AS unit_cost_usd,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.95 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS last_purchase_price_usd,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS total_inventory_value_usd,
  CAST(70 + (sk * 13) % 31 AS DECIMAL(5,2)) AS supplier_ontime_pct,
  CASE WHEN pk % 2 = 0 THEN 'FIFO' ELSE 'FEFO' END AS fifo_fefo,
  CASE WHEN (ok + pk) % 23 = 0 THEN 'Discontinued' WHEN (ok + pk) % 23 = 1 THEN 'Obsolete' WHEN (ok + pk) % 211 = 2 THEN CAST(NULL AS STRING) ELSE 'In Stock' END AS inventory_status,
  CAST((ok + pk) % 11 - 5 AS DECIMAL(18,2)) AS count_variance,
  CAST((ok + sk) % 7 - 3 AS DECIMAL(5,2)) AS audit_variance_pct,
  CAST(60 + (pk * 11 + sk) % 41 AS DECIMAL(5,2)) AS demand_forecast_accuracy_pct,
  CASE WHEN (ok + ln) % 19 = 0 THEN 'recount' ELSE CAST(NULL AS STRING) END AS notes
FROM d
"""

_LINES, _ORDERS = "FROM {lineitem} l", "  JOIN {orders} o ON l.l_orderkey = o.o_orderkey\n"

# every payload column of the stock-count file as dirty text
RAW_SQL = """
SELECT concat('  ', lower(sku_id), ' ') AS sku_id, concat(' ', sku_name) AS sku_name, lower(category) AS category,
  CASE WHEN abc_class = 'C' THEN CAST(NULL AS STRING) ELSE lower(abc_class) END AS abc_class,
  concat(lower(supplier_id), ' ') AS supplier_id, concat(' ', supplier_name, ' ') AS supplier_name,
  lower(warehouse_id) AS warehouse_id, concat(warehouse_location, '  ') AS warehouse_location,
  CASE WHEN stock_age_days % 37 = 0 THEN CAST(NULL AS STRING) ELSE lower(batch_id) END AS batch_id,
  CASE WHEN stock_age_days % 31 = 0 THEN '2024-13-45' ELSE CAST(received_date AS STRING) END AS received_date,
  CAST(last_purchase_date AS STRING) AS last_purchase_date, CAST(expiry_date AS STRING) AS expiry_date,
  CASE WHEN stock_age_days % 41 = 0 THEN 'unknown' ELSE CAST(audit_date AS STRING) END AS audit_date,
  CASE WHEN stock_age_days % 43 = 0 THEN 'old' ELSE CAST(stock_age_days AS STRING) END AS stock_age_days,
  CASE WHEN stock_age_days % 29 = 0 THEN 'n/a' WHEN stock_age_days % 23 = 0 THEN concat('-', CAST(quantity_on_hand AS STRING)) ELSE CAST(quantity_on_hand AS STRING) END AS quantity_on_hand,
  CAST(quantity_reserved AS STRING) AS quantity_reserved, CAST(quantity_committed AS STRING) AS quantity_committed,
  CAST(damaged_qty AS STRING) AS damaged_qty, CAST(returns_qty AS STRING) AS returns_qty,
  CAST(avg_daily_sales AS STRING) AS avg_daily_sales,
  concat(CAST(forecast_next_30d AS STRING), '.7') AS forecast_next_30d,
  concat('1,', lpad(CAST(days_of_inventory AS STRING), 6, '0')) AS days_of_inventory,
  CAST(sku_churn_rate AS STRING) AS sku_churn_rate, CAST(order_frequency_per_month AS STRING) AS order_frequency_per_month,
  CAST(reorder_point AS STRING) AS reorder_point, CAST(safety_stock AS STRING) AS safety_stock,
  CASE WHEN stock_age_days % 19 = 0 THEN CAST(NULL AS STRING) ELSE CAST(lead_time_days AS STRING) END AS lead_time_days,
  concat('$', CAST(unit_cost_usd AS STRING)) AS unit_cost_usd, concat('$', CAST(last_purchase_price_usd AS STRING)) AS last_purchase_price_usd,
  CASE WHEN total_inventory_value_usd >= 1000 THEN concat('$', CAST(CAST(floor(total_inventory_value_usd / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(total_inventory_value_usd % 1000 AS STRING), 6, '0')) ELSE concat('$', CAST(total_inventory_value_usd AS STRING)) END AS total_inventory_value_usd,
  concat(CAST(supplier_ontime_pct AS STRING), '%') AS supplier_ontime_pct,
  CASE WHEN stock_age_days % 5 = 0 THEN 'lifo' ELSE concat(' ', lower(fifo_fefo)) END AS fifo_fefo,
  lower(inventory_status) AS inventory_status,
  CAST(count_variance AS STRING) AS count_variance, concat(CAST(audit_variance_pct AS STRING), '%') AS audit_variance_pct,
  CASE WHEN stock_age_days % 17 = 0 THEN '1234.5%' ELSE concat(CAST(demand_forecast_accuracy_pct AS STRING), '%') END AS demand_forecast_accuracy_pct,
  CASE WHEN notes IS NULL THEN '   ' ELSE concat(' ', notes) END AS notes
FROM {inventory}
"""

ALERT_HISTORY_SQL = """
SELECT DISTINCT sku_id, warehouse_location AS location,
  CASE WHEN length(batch_id) % 2 = 0 THEN TIMESTAMP '2001-07-31 12:00:00' ELSE TIMESTAMP '2001-07-29 00:00:00' END AS alert_timestamp,
  stock_age_days % 3 = 0 AS resolved,
  CASE WHEN stock_age_days % 3 = 0 THEN CASE WHEN stock_age_days % 5 = 0 THEN TIMESTAMP '2001-04-01 00:00:00' ELSE TIMESTAMP '2001-07-30 00:00:00' END END AS resolved_timestamp
FROM {inventory} WHERE stock_age_days % 4 = 0 AND inventory_status = 'In Stock'
"""

REORDER_LOG_SQL = """
SELECT DISTINCT sku_id, warehouse_location AS location,
  CASE WHEN length(batch_id) % 2 = 0 THEN TIMESTAMP '2001-07-28 12:00:00' ELSE TIMESTAMP '2001-07-01 00:00:00' END AS action_timestamp,
  CASE WHEN stock_age_days % 3 = 0 THEN 'ORDERED' ELSE 'PENDING' END AS status
FROM {inventory} WHERE stock_age_days % 4 = 0 AND inventory_status = 'In Stock'
"""

# an earlier and a later state of the stock table, and the columns they are made of
STATE_COLUMNS = ("sku_id", "batch_id", "warehouse_location", "category", "quantity_on_hand", "stock_age_days")
OLD_SQL = "SELECT sku_id, batch_id, warehouse_location, category, quantity_on_hand FROM {inventory}"
NEW_SQL = """
SELECT sku_id, batch_id, warehouse_location, category, CASE WHEN stock_age_days % 13 = 0 THEN quantity_on_hand + 5 ELSE quantity_on_hand END AS quantity_on_hand
FROM {inventory} WHERE stock_age_days % 17 <> 0
UNION ALL SELECT concat(sku_id, '-N') AS sku_id, batch_id, warehouse_location, category, quantity_on_hand FROM {inventory} WHERE stock_age_days % 19 = 0
"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {
        name: spark.read.schema(columns).parquet(f"{sf_dir}/{name}.parquet")
        for name, columns in _TABLES.items()
    }
    # the same joins, orders first: they meet the line items while these are narrow, and names come after the shuffle
    text = INVENTORY_SQL.replace(_ORDERS, "").replace(_LINES, f"{_LINES} {_ORDERS.strip()}")
    return spark.sql(text, **frames)


def from_inventory(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the texts above, over the derived inventory."""
    df = spark.sql(text, inventory=inventory(spark, sf_dir))
    stamps = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({name: df[name].cast("timestamp_ntz") for name in stamps})
