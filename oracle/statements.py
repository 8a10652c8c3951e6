"""Expected results as DuckDB statements, one per registered query that SQL can express.

All statements share three CTEs: ``inventory`` (the derived table), ``m`` (its numbers as
DOUBLE) and ``x`` (every row metric once). Rounding is spelled out so that a tie rounds
the same way in both engines.
"""

from __future__ import annotations

from larder.sources import derived, sinks, tables

DAY = "DATE '2001-08-01'"
NOW = "TIMESTAMP '2001-08-01 00:00:00'"


def rnd(value: str, digits: int = 0) -> str:
    """Half away from zero, in decimal arithmetic."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def total(value: str) -> str:
    return f"CAST(sum({value}) AS DOUBLE)"


def mean(value: str) -> str:
    return f"(CAST(sum({value}) AS DOUBLE) / CAST(nullif(count({value}), 0) AS DOUBLE))"


def tally(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_STAR = {t: t for t in ("lineitem", "part", "supplier", "nation", "orders")}
INVENTORY = derived.INVENTORY_SQL.format(**_STAR)

NUMBERS = """
SELECT *, CAST(quantity_on_hand AS DOUBLE) AS q, CAST(reorder_point AS DOUBLE) AS rp, CAST(safety_stock AS DOUBLE) AS ss,
  CAST(avg_daily_sales AS DOUBLE) AS ads, CAST(lead_time_days AS DOUBLE) AS lt, CAST(unit_cost_usd AS DOUBLE) AS cost,
  CAST(quantity_on_hand - quantity_reserved - quantity_committed AS DECIMAL(18,2)) AS available_stock,
  CAST(quantity_on_hand - quantity_reserved AS DOUBLE) AS unreserved,
  warehouse_location AS location,
  coalesce(inventory_status NOT IN ('Discontinued', 'Obsolete'), false) AS active
FROM {source}
"""

_SHORT = "(ss + ads * lt * 1.5 - CAST(available_stock AS DOUBLE))"
_RISK = rnd("(1 - unreserved / nullif(ads * lt * 2, 0)) * 100")

METRICS = f"""
SELECT *, CASE WHEN ads > 0 THEN {rnd("CAST(available_stock AS DOUBLE) / ads", 1)} END AS days,
  CASE WHEN ads > 0 THEN {rnd("q / ads", 1)} ELSE 999 END AS days_on_hand,
  CASE WHEN q <= 0 THEN 'OUT_OF_STOCK' WHEN q <= ss THEN 'CRITICAL' WHEN q <= rp THEN 'LOW' WHEN q <= rp * 1.5 THEN 'MODERATE' ELSE 'HEALTHY' END AS status,
  CASE WHEN rp > 0 THEN {rnd("q / rp * 100", 1)} ELSE 100 END AS level_pct,
  CASE WHEN q <= 0 THEN 100 WHEN ads > 0 THEN CASE WHEN lt <> 0 THEN least(CAST(100 AS DOUBLE), {_RISK}) END
    WHEN q <= ss THEN 90 WHEN q <= rp THEN 70 ELSE 20 END AS risk,
  CASE WHEN q <= 0 THEN 100 WHEN q <= ss THEN 90 WHEN q <= rp THEN 70 ELSE 20 END AS step,
  CASE WHEN q <= 0 THEN 'STOCKOUT' WHEN q <= ss THEN 'CRITICAL' WHEN q <= rp THEN 'LOW_STOCK' WHEN ads > 0 AND q / ads <= 3 THEN 'URGENT' ELSE 'WARNING' END AS alert_type,
  CASE WHEN q <= 0 OR (ads > 0 AND q / ads <= 1) THEN 'CRITICAL' WHEN q <= ss OR (ads > 0 AND q / ads <= 3) THEN 'HIGH'
    WHEN q <= rp OR (ads > 0 AND q / ads <= 7) THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN q <= 0 THEN 'IMMEDIATE' WHEN ads > 0 AND q / ads <= 3 THEN 'URGENT' WHEN q <= ss THEN 'HIGH' WHEN q <= rp THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
  (q <= rp OR (ads > 0 AND q / ads <= 7)) AS attention,
  greatest(CAST(0 AS DOUBLE), {rnd(_SHORT)}) AS order_qty,
  CASE WHEN ads > 0 THEN {rnd("sqrt(ads * 2 * 30 * 10 / nullif(cost, 0))")} ELSE rp END AS eoq,
  CASE WHEN q <= 0 THEN 10 WHEN q <= ss * 0.5 THEN 9 WHEN q <= ss THEN 8 WHEN q <= rp * 0.75 THEN 7 WHEN q <= rp THEN 6 ELSE 5 END AS score,
  {rnd(_SHORT + " * cost", 2)} AS order_value,
  {rnd(f"greatest(CAST(0 AS DOUBLE), {rnd(_SHORT)}) * cost", 2)} AS whole_order_value,
  {rnd("ads * lt * cost", 2)} AS impact
FROM m
"""

HEALTH_VIEW = """
SELECT sku_id, sku_name, category, location, warehouse_id, abc_class, quantity_on_hand, quantity_reserved, quantity_committed,
  available_stock, reorder_point, safety_stock, lead_time_days, avg_daily_sales, forecast_next_30d,
  coalesce(days, 999) AS days_until_stockout, status AS stock_status, CAST(risk AS DOUBLE) AS risk_score, unit_cost_usd,
  total_inventory_value_usd, supplier_name, supplier_id, supplier_ontime_pct
FROM x WHERE active
"""

ALERT_VIEW = """
SELECT sku_id, sku_name, category, location, abc_class, quantity_on_hand, reorder_point, safety_stock, avg_daily_sales,
  alert_type, priority, days AS days_until_stockout, lead_time_days, supplier_name, supplier_id, unit_cost_usd,
  total_inventory_value_usd, CAST(DATE '2001-08-01' - received_date AS INTEGER) AS days_since_last_received
FROM x WHERE active AND attention
"""

REORDER_VIEW = """
SELECT sku_id, sku_name, category, location, warehouse_id, abc_class, quantity_on_hand, quantity_reserved, quantity_committed,
  available_stock, reorder_point, safety_stock, lead_time_days, avg_daily_sales, forecast_next_30d,
  order_qty AS recommended_order_qty, eoq AS economic_order_qty, score AS priority_score, unit_cost_usd,
  order_value AS estimated_order_value_usd, supplier_name, supplier_id, supplier_ontime_pct, days_of_inventory, order_frequency_per_month
FROM x WHERE active AND q <= rp
"""

LOCATION_VIEW = f"""
SELECT location, warehouse_id, count(DISTINCT sku_id) AS total_skus, count(DISTINCT category) AS total_categories,
  {total("quantity_on_hand")} AS total_units, {total("total_inventory_value_usd")} AS total_value_usd,
  {tally("q <= 0")} AS out_of_stock_count, {tally("q > 0 AND q <= ss")} AS critical_count,
  {tally("q > ss AND q <= rp")} AS low_stock_count, {tally("q > rp")} AS healthy_count,
  {rnd(f"(1 - {dbl(tally('q <= ss'))} / nullif(count(DISTINCT sku_id), 0)) * 100", 1)} AS health_score,
  {rnd(mean("days_of_inventory"), 1)} AS avg_days_coverage, {rnd(mean("supplier_ontime_pct"), 1)} AS avg_supplier_performance,
  {rnd(mean("demand_forecast_accuracy_pct"), 1)} AS avg_forecast_accuracy, {tally("q <= rp")} AS items_needing_reorder
FROM x WHERE active GROUP BY location, warehouse_id
"""

HEATMAP_VIEW = f"""
SELECT location, category, count(DISTINCT sku_id) AS total_skus,
  count(DISTINCT CASE WHEN q <= 0 THEN sku_id END) AS out_of_stock_skus,
  count(DISTINCT CASE WHEN q > 0 AND q <= ss THEN sku_id END) AS critical_skus,
  count(DISTINCT CASE WHEN q > ss AND q <= rp THEN sku_id END) AS low_stock_skus,
  count(DISTINCT CASE WHEN q > rp THEN sku_id END) AS healthy_skus,
  {total("quantity_on_hand")} AS total_units, {total("total_inventory_value_usd")} AS total_value_usd,
  {rnd(mean("days_of_inventory"), 1)} AS avg_days_coverage, {rnd(mean("step"), 1)} AS avg_risk_score,
  CASE WHEN count(DISTINCT CASE WHEN q <= 0 THEN sku_id END) > 0 THEN 'OUT_OF_STOCK'
    WHEN count(DISTINCT CASE WHEN q <= ss THEN sku_id END) > count(DISTINCT sku_id) * 0.3 THEN 'CRITICAL'
    WHEN count(DISTINCT CASE WHEN q <= rp THEN sku_id END) > count(DISTINCT sku_id) * 0.5 THEN 'LOW' ELSE 'HEALTHY' END AS overall_status
FROM x WHERE active GROUP BY location, category
"""

SNAPSHOT_VIEW = """
SELECT audit_date AS snapshot_date, sku_id, sku_name AS item_name, location, category, q AS current_stock, ads AS consumption, rp AS reorder_point, ss AS safety_stock
FROM x WHERE active
"""

_VOL = "least(CAST(0.3 AS DOUBLE), greatest(CAST(0.1 AS DOUBLE), q / (demand * 30) * 0.05))"
PROJECTION_VIEW = f"""
SELECT sku_name AS item_name, sku_id, location, category, q AS current_stock, greatest(CAST(0 AS DOUBLE), q - demand * 14) AS predicted_stock,
  demand AS predicted_consumption, q / demand AS predicted_days_to_stockout,
  greatest(CAST(60 AS DOUBLE), least(CAST(95 AS DOUBLE), 85 - {_VOL} * 50 - CASE WHEN q < ss THEN 10 ELSE 0 END)) AS model_accuracy,
  14 AS forecast_horizon_days, demand * 0.85 AS confidence_interval_lower, demand * 1.15 AS confidence_interval_upper,
  CASE WHEN q / demand < 7 THEN 'HIGH RISK' WHEN q / demand < 14 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS stockout_risk, {_VOL} AS demand_volatility
FROM (SELECT *, CASE WHEN ads <= 0 THEN CAST(1 AS DOUBLE) ELSE ads END AS demand FROM x WHERE active)
"""


def over(select: str, *views: str, source: str = "inventory", before: str = "") -> str:
    """Statement over the shared CTEs and the named views."""
    texts = {
        "health": HEALTH_VIEW,
        "alerts": ALERT_VIEW,
        "reorders": REORDER_VIEW,
        "performance": LOCATION_VIEW,
        "heatmap": HEATMAP_VIEW,
        "snap": SNAPSHOT_VIEW,
        "projection": PROJECTION_VIEW,
    }
    parts = [f"inventory AS ({INVENTORY})"]
    if before:
        parts.append(before)
    parts += [f"m AS ({NUMBERS.format(source=source)})", f"x AS ({METRICS})"]
    parts += [f"{name} AS ({texts[name]})" for name in views]
    return "WITH " + ",\n".join(parts) + "\n" + select


def plain(select: str, *ctes: str) -> str:
    """Statement over the inventory without row metrics."""
    return "WITH " + ",\n".join([f"inventory AS ({INVENTORY})", *ctes]) + "\n" + select


def top(columns: str, table: str, order: str, k: int | None, where: str = "", views: tuple[str, ...] = (), extra: str = "") -> str:
    """Ordered list; all listed columns break ties."""
    names = [c.strip() for c in columns.split(",")]
    ties = ", ".join(f"{n} ASC NULLS LAST" for n in names)
    condition = f" WHERE {where}" if where else ""
    limit = f" LIMIT {k}" if k else ""
    return over(f"SELECT {columns}{extra} FROM {table}{condition} ORDER BY {order}, {ties}{limit}", *(views or (table,)))


TIE = "md5(concat_ws('|', batch_id, supplier_id, warehouse_location, CAST(quantity_on_hand AS VARCHAR), CAST(total_inventory_value_usd AS VARCHAR)))"


def _recent(days: int) -> str:
    return f"recent AS (SELECT *, {TIE} AS tie FROM inventory WHERE audit_date >= {DAY} - {days})"


_BY_ITEM = "(PARTITION BY sku_id ORDER BY audit_date, tie)"
_TRAIL = "(PARTITION BY sku_id ORDER BY audit_date, tie ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


def audit_changes(days: int) -> str:
    return plain(
        f"SELECT sku_id, audit_date, quantity_on_hand, warehouse_location, {dbl(f'lag(quantity_on_hand) OVER {_BY_ITEM}')} AS prev_qty, "
        f"{dbl(f'quantity_on_hand - lag(quantity_on_hand) OVER {_BY_ITEM}')} AS qty_change FROM recent",
        _recent(days),
    )


def _anomaly_ctes(days: int) -> list[str]:
    return [
        _recent(days),
        f"changed AS (SELECT *, {dbl(f'quantity_on_hand - lag(quantity_on_hand) OVER {_BY_ITEM}')} AS qty_change FROM recent)",
        "scored AS (SELECT *, avg(qty_change) OVER (PARTITION BY sku_id) AS mu, stddev_samp(qty_change) OVER (PARTITION BY sku_id) AS sd FROM changed WHERE qty_change IS NOT NULL)",
        f"z AS (SELECT *, {rnd('(qty_change - mu) / nullif(sd, 0)', 10)} AS z FROM scored)",
        f"""anomalies AS (SELECT sku_id, sku_name, category, warehouse_location, audit_date, qty_change, {rnd("mu", 2)} AS avg_change, {rnd("sd", 2)} AS stddev,
  CASE WHEN abs(z) > 3 THEN 'SEVERE' WHEN abs(z) > 2 THEN 'MODERATE' ELSE 'NORMAL' END AS anomaly_severity,
  CASE WHEN qty_change > 0 THEN 'Unusual stock increase detected' ELSE 'Unusual stock decrease detected' END AS anomaly_type, {rnd("z", 2)} AS z_score
  FROM z WHERE abs(z) > 2)""",
    ]


def change_statistics(days: int) -> str:
    return plain(
        f"SELECT sku_id, audit_date, qty_change, {rnd('mu', 4)} AS mean_change, {rnd('sd', 4)} AS stddev_change, {rnd('z', 4)} AS z_score FROM z",
        *_anomaly_ctes(days)[:-1],
    )


def inventory_anomalies(days: int) -> str:
    return plain("SELECT * FROM anomalies", *_anomaly_ctes(days))


def trailing_demand(days: int) -> str:
    mu, sd = f"avg(ads) OVER {_TRAIL}", f"stddev_samp(ads) OVER {_TRAIL}"
    return plain(
        f"SELECT sku_id, audit_date, ads AS avg_daily_sales, warehouse_location, {rnd('mu', 4)} AS moving_avg_30d, {rnd('sd', 4)} AS demand_volatility "
        f"FROM (SELECT *, {mu} AS mu, {sd} AS sd FROM (SELECT *, CAST(avg_daily_sales AS DOUBLE) AS ads FROM recent))",
        _recent(days),
    )


def _forecast_ctes(days: int) -> list[str]:
    group = "sku_id, sku_name, category, warehouse_location, abc_class, quantity_on_hand, reorder_point, safety_stock"
    return [
        _recent(days),
        f"rolled AS (SELECT *, stddev_samp(CAST(avg_daily_sales AS DOUBLE)) OVER {_TRAIL} AS sd FROM recent)",
        f"grouped AS (SELECT {group}, {mean('avg_daily_sales')} AS mu, avg(sd) AS spread, max(forecast_next_30d) AS forecast_30d FROM rolled GROUP BY {group})",
        f"""forecast AS (SELECT DISTINCT sku_id, sku_name, category, warehouse_location, abc_class, {rnd("mu", 2)} AS avg_daily_demand, {rnd("spread", 2)} AS volatility, forecast_30d,
  CASE WHEN {rnd('spread / nullif(mu, 0)', 10)} < 0.2 THEN 'HIGH' WHEN {rnd('spread / nullif(mu, 0)', 10)} < 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS forecast_confidence,
  CASE WHEN quantity_on_hand <= safety_stock THEN 'HIGH RISK' WHEN quantity_on_hand <= reorder_point THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS stockout_risk,
  CASE WHEN quantity_on_hand <= safety_stock THEN 'URGENT: Order immediately' WHEN quantity_on_hand <= reorder_point THEN 'WARNING: Plan reorder soon' ELSE 'OK: Monitor' END AS recommendation
  FROM grouped)""",
    ]


def demand_forecast(days: int) -> str:
    return plain("SELECT * FROM forecast", *_forecast_ctes(days))


def pivot(metric: str) -> str:
    value = {
        "risk": "avg_risk_score",
        "cover": "avg_days_coverage",
        "critical_pct": "coalesce(CAST(critical_skus AS DOUBLE) / total_skus * 100, 0)",
    }[metric]
    cells = ", ".join(f"avg({value}) FILTER (WHERE location = 'NATION_{n}') AS \"NATION_{n}\"" for n in range(25))
    return over(f"SELECT category, {cells} FROM heatmap GROUP BY category", "heatmap")


def _severity(column: str = "priority") -> str:
    return f"CASE {column} WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"


_BY_SEVERITY = f"{_severity()}, days_until_stockout ASC NULLS LAST"
_KNOWN = "CASE WHEN days_until_stockout < 999 THEN CAST(days_until_stockout AS DECIMAL(18,1)) END"
_STATES = ("OUT_OF_STOCK", "CRITICAL", "LOW", "MODERATE", "HEALTHY")


def _facts() -> str:
    summary = f"""overview AS (SELECT count(DISTINCT sku_id) AS total_items, count(DISTINCT location) AS total_locations, count(DISTINCT category) AS total_categories,
  {total("total_inventory_value_usd")} AS total_value, {rnd(mean(_KNOWN), 1)} AS avg_days_to_stockout,
  {tally("days_until_stockout <= 3")} AS days_3_count, {tally("days_until_stockout <= 7")} AS days_7_count, {tally("days_until_stockout <= 14")} AS days_14_count
  FROM health)"""

    def long(section: str, place: str, name: str, table: str, *measures: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}' AS section, CAST({place} AS INTEGER) AS place, {name} AS name, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {table}"
            for m in measures
        )

    status = " UNION ALL ".join(
        f"""SELECT 'status' AS section, {i} AS place, '{s}' AS name, u.measure, CASE u.measure WHEN 'count' THEN CAST(c.n AS DOUBLE) ELSE {rnd("CAST(c.n AS DOUBLE) / c.t * 100", 1)} END AS value
  FROM (SELECT {tally(f"stock_status = '{s}'")} AS n, count(DISTINCT sku_id) AS t FROM health) c, (VALUES ('count'), ('pct')) u(measure)"""
        for i, s in enumerate(_STATES[1:], 1)
    )
    ctes = [
        summary,
        f"abc AS (SELECT *, row_number() OVER (ORDER BY abc_class) AS place FROM (SELECT abc_class, count(*) AS item_count, {total('total_inventory_value_usd')} AS value, {tally("stock_status = 'CRITICAL'")} AS critical_count FROM health GROUP BY abc_class))",
        f"loc AS (SELECT *, row_number() OVER (ORDER BY critical DESC, location) AS place FROM (SELECT location, {tally("stock_status = 'CRITICAL'")} AS critical, {tally("stock_status = 'LOW'")} AS low, {tally("stock_status = 'HEALTHY'")} AS healthy FROM health GROUP BY location) ORDER BY place LIMIT 10)",
        f"cat AS (SELECT *, row_number() OVER (ORDER BY critical DESC, category) AS place FROM (SELECT category, {tally("stock_status = 'CRITICAL'")} AS critical, {rnd(mean('CAST(risk_score AS DECIMAL(18,0))'), 1)} AS avg_risk FROM health GROUP BY category) ORDER BY place LIMIT 10)",
        f"reo AS (SELECT count(*) AS items_to_reorder, {tally('priority_score >= 8')} AS urgent_items, {total('CAST(estimated_order_value_usd AS DECIMAL(18,2))')} AS total_order_value FROM reorders)",
        "item AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC NULLS LAST, sku_name, location, category, quantity_on_hand, days_until_stockout) AS place FROM health ORDER BY place LIMIT 10)",
    ]
    body = " UNION ALL ".join(
        [
            long("overview", "1", "''", "overview", "total_items", "total_locations", "total_categories", "total_value", "avg_days_to_stockout", "days_3_count", "days_7_count", "days_14_count"),
            status,
            long("abc", "place", "abc_class", "abc", "item_count", "value", "critical_count"),
            long("location", "place", "location", "loc", "critical", "low", "healthy"),
            long("category", "place", "category", "cat", "critical", "avg_risk"),
            long("reorder", "1", "''", "reo", "items_to_reorder", "urgent_items", "total_order_value"),
            long("top_item", "place", "sku_name", "item", "quantity_on_hand", "days_until_stockout", "risk_score"),
        ]
    )
    return over("SELECT * FROM facts", "health", "reorders").replace(
        "\nSELECT * FROM facts", ",\n" + ",\n".join(ctes) + f",\nfacts AS ({body})\nSELECT * FROM facts"
    )


RAW = derived.RAW_SQL.format(inventory="inventory")
_DROP = "CASE WHEN {c} IN ('NULL', 'null', '') THEN NULL ELSE {c} END"


def _clean(nulled: bool = False) -> str:
    """Cleaning rules in SQL; ``nulled`` first applies the file's null tokens."""

    def c(name: str) -> str:
        return _DROP.format(c=name) if nulled else name

    def title(name: str) -> str:
        words = f"string_split(lower({c(name)}), ' ')"
        return f"trim(array_to_string(list_transform({words}, lambda w: concat(upper(w[1]), w[2:])), ' '))"

    def num(name: str, strip: str, kind: str, floor: bool) -> str:
        text = c(name)
        for mark in strip:
            text = f"replace({text}, '{mark}', '')"
        value = f"coalesce(TRY_CAST({text} AS {kind}), 0)"
        return f"CAST({f'greatest({value}, 0)' if floor else value} AS {kind})"

    quantity = (
        "quantity_on_hand", "quantity_reserved", "quantity_committed", "damaged_qty", "returns_qty", "avg_daily_sales",
        "days_of_inventory", "sku_churn_rate", "order_frequency_per_month", "reorder_point", "safety_stock",
    )
    money = ("unit_cost_usd", "last_purchase_price_usd", "total_inventory_value_usd")
    pct = ("supplier_ontime_pct", "audit_variance_pct", "demand_forecast_accuracy_pct")
    out = {n: f"trim(upper({c(n)}))" for n in ("sku_id", "supplier_id", "warehouse_id", "batch_id")}
    out |= {n: f"trim({c(n)})" for n in ("sku_name", "supplier_name", "warehouse_location")}
    out |= {n: title(n) for n in ("category", "inventory_status")}
    out["abc_class"] = f"coalesce(upper(trim({c('abc_class')})), 'C')"
    out |= {
        n: f"CAST(try_strptime({c(n)}, '%Y-%m-%d') AS DATE)"
        for n in ("received_date", "last_purchase_date", "expiry_date", "audit_date")
    }
    out |= {n: num(n, ",", "DECIMAL(18,2)", True) for n in quantity}
    out |= {n: num(n, "$,", "DECIMAL(18,2)", True) for n in money}
    out |= {n: num(n, "%", "DECIMAL(5,2)", False) for n in pct}
    out["count_variance"] = num("count_variance", ",", "DECIMAL(18,2)", False)
    out["stock_age_days"] = num("stock_age_days", "", "INTEGER", False)
    out["forecast_next_30d"] = num("forecast_next_30d", ",", "INTEGER", True)
    out["lead_time_days"] = num("lead_time_days", "", "INTEGER", True)
    policy = f"upper(trim({c('fifo_fefo')}))"
    out["fifo_fefo"] = f"CASE WHEN {policy} IN ('FIFO', 'FEFO') THEN {policy} ELSE 'FIFO' END"
    out["notes"] = f"nullif(trim({c('notes')}), '')"
    columns = ", ".join(f"{text} AS {name}" for name, text in out.items())
    return plain(f"SELECT {columns} FROM raw WHERE sku_id IS NOT NULL AND batch_id IS NOT NULL", f"raw AS ({RAW})")


_HISTORY = f"history AS ({derived.ALERT_HISTORY_SQL.format(inventory='inventory')})"
_LOG = f"log AS ({derived.REORDER_LOG_SQL.format(inventory='inventory')})"
_OLD = f"old_state AS ({derived.OLD_SQL.format(inventory='inventory')})"
_NEW = f"new_state AS ({derived.NEW_SQL.format(inventory='inventory')})"
_STATE_COLUMNS = "sku_id, batch_id, warehouse_location, category, quantity_on_hand"
_NET = f"""net AS (SELECT {_STATE_COLUMNS}, sum(w) AS net FROM (
  SELECT {_STATE_COLUMNS}, -1 AS w FROM old_state UNION ALL SELECT {_STATE_COLUMNS}, 1 AS w FROM new_state) GROUP BY ALL HAVING sum(w) <> 0)"""

_LATER = """later AS (SELECT * REPLACE (CAST(CASE WHEN stock_age_days % 13 = 0 THEN quantity_on_hand + 5 ELSE quantity_on_hand END AS DECIMAL(18,2)) AS quantity_on_hand)
  FROM inventory WHERE stock_age_days % 17 <> 0)"""
_TRIAL = f"""few AS (SELECT DISTINCT sku_id FROM inventory WHERE category = 'ECONOMY' ORDER BY sku_id LIMIT 3),
several AS (SELECT DISTINCT sku_id FROM inventory WHERE category = 'STANDARD' ORDER BY sku_id LIMIT 5),
trial AS (SELECT * REPLACE (
  CAST(CASE WHEN sku_id IN (FROM several) THEN reorder_point * 0.8 WHEN sku_id IN (FROM few) THEN 5 ELSE quantity_on_hand END AS DECIMAL(18,2)) AS quantity_on_hand,
  CASE WHEN sku_id IN (FROM several) OR sku_id IN (FROM few) THEN {DAY} ELSE audit_date END AS audit_date) FROM inventory)"""

_NEW_ALERT_COLUMNS = """sku_id, sku_name, category, location, warehouse_id, abc_class, alert_type, priority, quantity_on_hand, reorder_point, safety_stock,
  days AS days_until_stockout, false AS resolved, supplier_name, supplier_id, lead_time_days, unit_cost_usd, impact AS estimated_impact_usd"""
_QUIET = f"""EXISTS (SELECT 1 FROM history h WHERE h.sku_id = x.sku_id AND h.location = x.location AND NOT h.resolved AND h.alert_timestamp >= {NOW} - INTERVAL 24 HOUR)"""
_PENDING = f"""EXISTS (SELECT 1 FROM log l WHERE l.sku_id = x.sku_id AND l.location = x.location AND l.status = 'PENDING' AND l.action_timestamp >= {NOW} - INTERVAL 7 DAY)"""


def statements() -> dict[str, str]:
    s: dict[str, str] = {}

    # row tables
    s["stock_health_matrix"] = over(
        "SELECT sku_id, sku_name, category, location, warehouse_id, abc_class, quantity_on_hand, quantity_reserved, quantity_committed, available_stock, "
        "reorder_point, safety_stock, lead_time_days, avg_daily_sales, forecast_next_30d, days_of_inventory, days AS days_until_stockout, status AS stock_status, "
        "CAST(level_pct AS DOUBLE) AS stock_level_pct, CAST(risk AS DOUBLE) AS risk_score, unit_cost_usd, total_inventory_value_usd, inventory_status, supplier_name, supplier_id, expiry_date, stock_age_days "
        "FROM x WHERE active"
    )
    s["stock_health"] = over("SELECT * FROM health", "health")
    s["materialized_stock_health"] = s["stock_health"]
    s["critical_items"] = over(
        "SELECT sku_id, sku_name, category, location, abc_class, quantity_on_hand, reorder_point, safety_stock, avg_daily_sales, coalesce(days, 999) AS days_until_stockout, "
        "urgency AS urgency_level, CASE WHEN status = 'HEALTHY' THEN 'MODERATE' ELSE status END AS stock_status, lead_time_days, supplier_name, supplier_id, supplier_ontime_pct, unit_cost_usd "
        "FROM x WHERE active AND attention"
    )
    s["active_alerts"] = over("SELECT * FROM alerts", "alerts")
    s["reorder_recommendations"] = over("SELECT * FROM reorders", "reorders")
    s["inventory_context"] = over(
        "SELECT sku_id, sku_name, category, warehouse_location, abc_class, quantity_on_hand, reorder_point, safety_stock, avg_daily_sales, CAST(days_on_hand AS DOUBLE) AS days_until_stockout, "
        "CASE WHEN status = 'MODERATE' THEN 'HEALTHY' ELSE status END AS stock_status, unit_cost_usd, total_inventory_value_usd, supplier_name, supplier_ontime_pct, lead_time_days FROM x WHERE active"
    )
    scatter = "SELECT location, category, sku_name, quantity_on_hand, days_until_stockout, stock_status, risk_score, {c} AS color_value FROM health"
    s["item_scatter"] = over(scatter.format(c="least(days_until_stockout, CAST(60 AS DOUBLE))"), "health")
    s["item_scatter_risk"] = over(scatter.format(c="risk_score"), "health")
    s["risk_alert_fallback"] = over("SELECT sku_id, sku_name, location, risk_score FROM health WHERE risk_score >= 70", "health")
    s["sliced_health"] = over("SELECT * FROM health WHERE location = 'NATION_1' AND category = 'ECONOMY' AND stock_status = 'CRITICAL'", "health")
    s["half_reorder_status"] = over(
        "SELECT CASE WHEN q < rp * 0.5 THEN 'CRITICAL' WHEN q < rp THEN 'LOW' ELSE 'HEALTHY' END AS stock_status, count(*) AS item_count FROM x WHERE active GROUP BY 1"
    )
    s["sliced_alerts"] = over("SELECT * FROM alerts WHERE location = 'NATION_1'", "alerts")

    # scorecards
    s["location_category_summary"] = over(
        f"""SELECT location, category, count(DISTINCT sku_id) AS total_skus, {total("quantity_on_hand")} AS total_stock, {total("available_stock")} AS available_stock,
  {rnd(mean("days_of_inventory"), 1)} AS avg_days_inventory, {tally("q <= 0")} AS out_of_stock_count, {tally("q > 0 AND q <= ss")} AS critical_count,
  {tally("q > ss AND q <= rp")} AS low_count, {tally("q > rp")} AS healthy_count, {rnd(mean("step"), 1)} AS avg_risk_score, {total("total_inventory_value_usd")} AS total_value_usd
FROM x WHERE active GROUP BY location, category"""
    )
    s["warehouse_performance"] = over(
        f"""SELECT location, warehouse_id, total_skus, total_categories, total_units, total_value_usd, avg_days_coverage, out_of_stock_count AS out_of_stock_items,
  out_of_stock_count + critical_count AS critical_items, items_needing_reorder AS low_stock_items, health_score, avg_supplier_performance AS avg_supplier_ontime_pct, avg_forecast_accuracy
FROM performance""",
        "performance",
    )
    s["abc_analysis"] = over(
        f"""SELECT location, abc_class, category, count(DISTINCT sku_id) AS sku_count, {total("total_inventory_value_usd")} AS total_value_usd, {total("quantity_on_hand")} AS total_units,
  {tally("q <= ss")} AS critical_count, {tally("q <= rp")} AS low_stock_count, {rnd(f"CAST(100 * {tally('q <= ss')} AS DOUBLE) / nullif(count(DISTINCT sku_id), 0)", 1)} AS critical_pct
FROM x WHERE active GROUP BY location, abc_class, category"""
    )
    s["location_performance"] = over("SELECT * FROM performance", "performance")
    s["category_heatmap"] = over("SELECT * FROM heatmap", "heatmap")
    for name, view in (
        ("stock_health", "health"), ("active_alerts", "alerts"), ("reorder_recommendations", "reorders"),
        ("location_performance", "performance"), ("category_heatmap", "heatmap"),
    ):
        s[f"stream_{name}"] = over(f"SELECT * FROM {view}", view, source="later", before=_LATER)
    s["overview_counts"] = plain(
        "SELECT (SELECT count(*) FROM inventory) AS total_records, (SELECT count(*) FROM (SELECT DISTINCT warehouse_location FROM inventory)) AS total_locations, "
        "(SELECT count(*) FROM (SELECT DISTINCT category FROM inventory)) AS total_categories, (SELECT count(*) FROM (SELECT DISTINCT sku_id FROM inventory)) AS total_skus"
    )
    s["restored_counts"] = s["overview_counts"]
    s["restored_rows"] = plain("SELECT * FROM inventory")
    s["table_row_counts"] = over(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {view}"
            for name, view in (
                ("stock_health", "health"), ("active_alerts", "alerts"), ("reorder_recommendations", "reorders"),
                ("location_performance", "performance"), ("category_heatmap", "heatmap"),
            )
        ),
        "health", "alerts", "reorders", "performance", "heatmap",
    )
    s["check_counts"] = over(
        "SELECT (SELECT count(*) FROM health WHERE stock_status = 'CRITICAL') AS critical_items, (SELECT count(*) FROM alerts WHERE priority IN ('CRITICAL', 'HIGH')) AS critical_alerts, (SELECT count(*) FROM inventory) AS total_records",
        "health", "alerts",
    )
    s["mean_days_all"] = over(f"SELECT {tally('q <= ss')} AS critical_items, count(*) AS total_items, {rnd('avg(CASE WHEN ads > 0 THEN q / ads ELSE 999 END)', 1)} AS avg_days_until_stockout FROM x")
    s["duplicate_keys"] = plain("SELECT sku_id, batch_id, count(*) AS copies FROM inventory GROUP BY sku_id, batch_id HAVING count(*) > 1")
    s["critical_item_list"] = over(
        """SELECT place // 100 AS part, string_agg(entry, ', ' ORDER BY place) AS critical_items
FROM (SELECT entry, row_number() OVER (ORDER BY quantity_on_hand, entry) - 1 AS place
  FROM (SELECT quantity_on_hand, sku_name || ' at ' || location || ' has only ' || CAST(quantity_on_hand AS VARCHAR) || ' units left' AS entry FROM x WHERE q <= ss) WHERE entry IS NOT NULL) GROUP BY 1"""
    )
    s["critical_item_entries"] = over(
        "SELECT quantity_on_hand, entry FROM (SELECT quantity_on_hand, sku_name || ' at ' || location || ' has only ' || CAST(quantity_on_hand AS VARCHAR) || ' units left' AS entry "
        "FROM x WHERE q <= ss) WHERE entry IS NOT NULL"
    )
    s["critical_categories"] = over(
        """SELECT place // 100 AS part, string_agg(category, ', ' ORDER BY place) AS critical_categories
FROM (SELECT category, row_number() OVER (ORDER BY category) - 1 AS place FROM (SELECT DISTINCT category FROM x WHERE q <= ss AND category IS NOT NULL)) GROUP BY 1"""
    )
    s["daily_insight_row"] = over(
        f"""SELECT {DAY} AS insight_date, CAST((SELECT sum(n) FROM c) AS BIGINT) AS critical_count, CAST((SELECT sum(v) FROM c) AS DOUBLE) AS total_value,
  (SELECT string_agg(category, ', ' ORDER BY category) FROM (SELECT category FROM c ORDER BY n DESC, category LIMIT 5)) AS top_categories"""
    ).replace("x AS (", "x AS MATERIALIZED (").replace(
        f"\nSELECT {DAY} AS insight_date", f",\nc AS (SELECT category, count(*) AS n, sum(total_inventory_value_usd) AS v FROM x WHERE q <= ss GROUP BY category)\nSELECT {DAY} AS insight_date"
    )

    # figures over the item tables
    crit, low = "stock_status = 'CRITICAL'", "stock_status = 'LOW'"
    s["appended_daily_insight"] = s["daily_insight_row"]
    s["health_by_location_category"] = over(
        f"SELECT * FROM (SELECT location, category, count(*) AS items, {tally(crit)} AS critical_items, {tally(low)} AS low_items FROM health GROUP BY location, category) "
        "ORDER BY critical_items DESC, location, category LIMIT 10",
        "health",
    )
    s["inventory_summary"] = over(
        f"""SELECT count(DISTINCT sku_id) AS total_items, count(DISTINCT location) AS total_locations, count(DISTINCT category) AS total_categories, {total("total_inventory_value_usd")} AS total_value,
  {tally(crit)} AS critical_count, {tally(low)} AS low_count, {tally("stock_status = 'MODERATE'")} AS moderate_count, {tally("stock_status = 'HEALTHY'")} AS healthy_count,
  {tally("days_until_stockout <= 3")} AS days_3_count, {tally("days_until_stockout <= 7")} AS days_7_count, {tally("days_until_stockout <= 14")} AS days_14_count,
  {rnd(mean(_KNOWN), 1)} AS avg_days_to_stockout FROM health""",
        "health",
    )
    s["abc_summary"] = over(f"SELECT abc_class, count(*) AS item_count, {total('total_inventory_value_usd')} AS value, {tally(crit)} AS critical_count FROM health GROUP BY abc_class", "health")
    s["location_breakdown"] = over(
        f"SELECT location, {tally(crit)} AS critical, {tally(low)} AS low, {tally("stock_status = 'HEALTHY'")} AS healthy FROM health GROUP BY location ORDER BY critical DESC, location LIMIT 10", "health"
    )
    s["category_breakdown"] = over(
        f"SELECT category, {tally(crit)} AS critical, {rnd(mean('CAST(risk_score AS DECIMAL(18,0))'), 1)} AS avg_risk FROM health GROUP BY category ORDER BY critical DESC, category LIMIT 10", "health"
    )
    s["dashboard_kpis"] = over(
        f"""SELECT {tally(crit)} AS critical_items, {tally(low)} AS low_stock, {rnd(mean(_KNOWN), 1)} AS avg_days_to_stockout,
  {rnd(f"{total('quantity_on_hand')} * {mean('unit_cost_usd')}", 2)} AS kpi_total_value, {total("quantity_on_hand * unit_cost_usd")} AS exact_total_value,
  100 - {dbl(tally(f"{crit} OR {low}"))} / count(*) * 100 AS health_pct FROM health""",
        "health",
    )
    at_risk = f"abc_class = 'A' AND ({crit} OR {low})"
    s["abc_at_risk"] = over(
        f"""SELECT {tally(at_risk)} AS class_a_at_risk, {tally("abc_class = 'A'")} AS class_a_items, {rnd(f"{dbl(tally(at_risk))} / nullif({tally("abc_class = 'A'")}, 0) * 100", 1)} AS class_a_at_risk_pct,
  {rnd(mean("unit_cost_usd"), 2)} AS avg_unit_cost, {tally("days_until_stockout <= 7")} AS items_within_week FROM health""",
        "health",
    )
    s["abc_distribution"] = over("SELECT abc_class, count(*) AS item_count FROM health GROUP BY abc_class", "health")
    s["abc_value_share"] = over(
        f"""SELECT abc_class, total_value, value_pct, CASE WHEN abc_class = 'A' THEN CASE WHEN value_pct >= 60 THEN 'VERIFIED' WHEN value_pct >= 40 THEN 'MODERATE' ELSE 'REVIEW' END END AS verdict
FROM (SELECT *, {rnd("total_value / (sum(total_value) OVER ()) * 100", 1)} AS value_pct FROM (SELECT abc_class, {total("quantity_on_hand * unit_cost_usd")} AS total_value FROM health GROUP BY abc_class))""",
        "health",
    )
    s["abc_cost_stats"] = over(
        f"SELECT abc_class, {rnd(mean('unit_cost_usd'), 2)} AS avg_cost, {rnd('median(CAST(unit_cost_usd AS DOUBLE))', 2)} AS median_cost, count(unit_cost_usd) AS item_count FROM health GROUP BY abc_class", "health"
    )
    s["abc_risk"] = over(f"SELECT abc_class, {mean('CAST(risk_score AS DECIMAL(18,0))')} AS avg_risk_score FROM health GROUP BY abc_class", "health")
    s["status_counts"] = over("SELECT stock_status, count(*) AS item_count FROM health GROUP BY stock_status", "health")
    s["status_by_category"] = over(
        "SELECT category, " + ", ".join(f"{tally(f'stock_status = {name!r}')} AS \"{name}\"" for name in _STATES) + " FROM health GROUP BY category", "health"
    )
    s["alerts_by_priority"] = over(
        f"SELECT priority, count(*) AS alert_count, {mean('CAST(days_until_stockout AS DECIMAL(18,1))')} AS avg_days_until_stockout, {_severity()} AS severity_rank FROM alerts GROUP BY priority", "alerts"
    )
    s["alert_summary"] = over(
        f"""SELECT {tally("priority IN ('CRITICAL', 'HIGH')")} AS critical_alerts, {tally("priority = 'MEDIUM'")} AS medium_alerts, {rnd(mean(_KNOWN), 1)} AS avg_days_to_stockout,
  count(DISTINCT location) AS locations_affected FROM alerts""",
        "alerts",
    )
    value = total("CAST(estimated_order_value_usd AS DECIMAL(18,2))")
    s["reorder_stats"] = over(f"SELECT count(*) AS items_to_reorder, {tally('priority_score >= 8')} AS urgent_items, {value} AS total_order_value FROM reorders", "reorders")
    summary = "SELECT count(*) AS items_to_reorder, {v} AS total_order_value, {u} AS urgent_items, count(DISTINCT supplier_name) AS suppliers FROM reorders"
    s["reorder_summary"] = over(summary.format(v=value, u=tally("priority_score >= 8")), "reorders")
    s["reorder_summary_by_point"] = over(summary.format(v=total("reorder_point * unit_cost_usd"), u=tally("priority_score >= 8")), "reorders")
    s["reorder_summary_by_stock"] = over(summary.format(v=value, u=tally("quantity_on_hand <= safety_stock")), "reorders")
    s["category_by_location"] = over(
        f"SELECT category, location, {mean('CAST(risk_score AS DECIMAL(18,0))')} AS avg_risk, {mean('CAST(days_until_stockout AS DECIMAL(18,1))')} AS avg_days, "
        f"CAST({tally("stock_status = 'CRITICAL'")} * 100 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS critical_pct FROM health "
        "WHERE category IS NOT NULL AND location IS NOT NULL GROUP BY category, location",
        "health",
    )
    for metric in ("risk", "cover", "critical_pct"):
        s[f"heatmap_pivot_{metric}"] = pivot(metric)
    s["insight_context"] = _facts()

    # windows
    for suffix, days in (("", 90), ("_long", 3650)):
        s[f"audit_changes{suffix}"] = audit_changes(days)
        s[f"change_statistics{suffix}"] = change_statistics(days)
        s[f"inventory_anomalies{suffix}"] = inventory_anomalies(days)
        s[f"trailing_demand{suffix}"] = trailing_demand(days)
        s[f"demand_forecast{suffix}"] = demand_forecast(days)
    s["latest_by_location_category"] = over(
        """SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY location, category ORDER BY snapshot_date DESC, sku_id DESC, item_name DESC, current_stock DESC, consumption DESC, reorder_point DESC, safety_stock DESC) AS place FROM snap) WHERE place = 1""",
        "snap",
    )
    newest = "snapshot_date = (SELECT max(snapshot_date) FROM snap)"
    s["latest_snapshot"] = over(f"SELECT * FROM snap WHERE {newest}", "snap")
    s["newest_snapshot_folder"] = s["latest_snapshot"]

    # projection and trends
    s["stock_projection"] = over("SELECT * FROM projection", "projection")
    s["projection_compare_all"] = over("SELECT item_name, location, current_stock, predicted_stock FROM projection", "projection")
    s["projection_compare"] = over(
        "SELECT item_name, location, current_stock, predicted_stock FROM projection WHERE item_name IN (SELECT DISTINCT item_name FROM projection ORDER BY item_name LIMIT 5)", "projection"
    )
    s["projection_compare_named"] = over(
        "SELECT item_name, location, current_stock, predicted_stock FROM projection WHERE item_name IN ('small ring', 'cold anvil')", "projection"
    )
    for dimension in ("category", "location"):
        s[f"forecast_risk_by_{dimension}"] = over(f"SELECT {dimension}, stockout_risk, count(*) AS item_count FROM projection GROUP BY {dimension}, stockout_risk", "projection")
    s["forecast_summary"] = over(
        f"""SELECT {tally("stockout_risk = 'HIGH RISK'")} AS high_risk, {tally("stockout_risk = 'MODERATE RISK'")} AS moderate_risk, {tally("stockout_risk = 'LOW RISK'")} AS low_risk,
  {rnd("avg(model_accuracy)", 1)} AS avg_accuracy FROM projection""",
        "projection",
    )
    s["accuracy_by_category"] = over(f"SELECT category, {rnd('avg(model_accuracy)', 4)} AS avg_accuracy FROM projection GROUP BY category", "projection")
    s["accuracy_histogram"] = over(
        "SELECT bin, 60 + (bin - 1) * CAST(1.75 AS DOUBLE) AS bin_start, count(*) AS item_count FROM (SELECT CAST(least(20, floor((model_accuracy - 60) * 20 / 35) + 1) AS INTEGER) AS bin FROM projection) GROUP BY bin",
        "projection",
    )
    s["snapshot_history"] = over("SELECT * FROM snap", "snap")
    for suffix, days in (("", 30), ("_long", 3650)):
        for name, measure in (("trend_stock", "current_stock"), ("trend_consumption", "consumption")):
            s[f"{name}{suffix}"] = over(f"SELECT snapshot_date, category, sum({measure}) AS {measure} FROM snap WHERE snapshot_date >= {DAY} - {days} GROUP BY snapshot_date, category", "snap")
    s["stock_by_location"] = over("SELECT location, sum(current_stock) AS current_stock FROM snap GROUP BY location", "snap")
    s["status_by_location"] = s["latest_by_location_category"].replace("SELECT * EXCLUDE (place) FROM (SELECT *, row_number()", "SELECT location, CASE WHEN current_stock <= safety_stock THEN 'CRITICAL' WHEN current_stock <= reorder_point THEN 'LOW' ELSE 'HEALTHY' END AS stock_status, count(*) AS item_count FROM (SELECT *, row_number()") + " GROUP BY 1, 2"
    level = rnd("avg(current_stock / nullif(reorder_point, 0) * 100)", 1)
    s["item_snapshot_stats"] = over(
        f"SELECT item_name, sum(current_stock) AS total_stock, {level} AS avg_stock_pct, {tally('current_stock <= safety_stock')} AS critical_locations FROM snap WHERE {newest} GROUP BY item_name", "snap"
    )
    s["item_stock_by_location"] = over(f"SELECT item_name, location, current_stock, reorder_point FROM snap WHERE {newest}", "snap")
    s["trend_summary"] = over(
        f"SELECT count(DISTINCT item_name) AS unique_items, count(DISTINCT location) AS locations, {level} AS avg_stock_pct, {tally('current_stock < reorder_point * 0.25')} AS items_needing_restock FROM snap WHERE {newest}", "snap"
    )

    # ordered lists
    s["top_critical_items"] = top(
        "sku_name, location, category, abc_class, quantity_on_hand, reorder_point, days_until_stockout, risk_score, unit_cost_usd", "health", "risk_score DESC NULLS LAST", 10,
        extra=f", {rnd('CAST(quantity_on_hand AS DOUBLE) * CAST(unit_cost_usd AS DOUBLE)', 2)} AS total_value",
    )
    s["top_reorders"] = top("sku_name, location, quantity_on_hand, reorder_point, recommended_order_qty, priority_score, estimated_order_value_usd", "reorders", "priority_score DESC", 10)
    s["reorders_in_table_order"] = top(", ".join(tables.REORDER_COLUMNS), "reorders", "priority_score DESC, abc_class ASC NULLS LAST, estimated_order_value_usd DESC NULLS LAST", None)
    s["worst_locations"] = top("location, total_skus, critical_count, low_stock_count, health_score, items_needing_reorder", "performance", "health_score ASC NULLS LAST", None)
    s["top_heatmap_cells"] = top("location, category, total_skus, critical_skus, avg_risk_score, overall_status", "heatmap", "avg_risk_score DESC NULLS LAST", 20)
    s["first_alerts"] = top("sku_name, location, category, abc_class, priority, quantity_on_hand, reorder_point, safety_stock, days_until_stockout", "alerts", _BY_SEVERITY, 20)
    s["reorder_list"] = top(
        "sku_id, sku_name, category, location, quantity_on_hand, reorder_point, recommended_order_qty, priority_score, unit_cost_usd, supplier_name, estimated_order_value_usd",
        "reorders", "priority_score DESC, estimated_order_value_usd DESC NULLS LAST", 100,
    )
    projected = (
        "item_name, sku_id, location, category, current_stock, predicted_stock, predicted_consumption, predicted_days_to_stockout, model_accuracy, forecast_horizon_days, "
        "confidence_interval_lower, confidence_interval_upper, stockout_risk, demand_volatility"
    )
    s["high_risk_forecasts"] = top(projected, "projection", "predicted_days_to_stockout", 10, "stockout_risk = 'HIGH RISK'")
    s["high_risk_search"] = top(projected, "projection", "predicted_days_to_stockout", 10, "stockout_risk = 'HIGH RISK' AND contains(lower(item_name), 'ring')")
    anomaly = "sku_id, sku_name, category, warehouse_location, audit_date, qty_change, avg_change, stddev, anomaly_severity, anomaly_type, z_score"
    s["top_anomalies"] = plain(f"SELECT {anomaly} FROM anomalies ORDER BY abs(z_score) DESC, {anomaly} LIMIT 20", *_anomaly_ctes(3650))
    forecast = "sku_id, sku_name, category, warehouse_location, abc_class, avg_daily_demand, volatility, forecast_30d, forecast_confidence, stockout_risk, recommendation"
    s["top_forecasts"] = plain(
        f"SELECT {forecast} FROM forecast WHERE stockout_risk <> 'LOW RISK' ORDER BY volatility DESC NULLS LAST, {forecast} LIMIT 20", *_forecast_ctes(3650)
    )
    s["recent_insights"] = over(
        f"""SELECT audit_date AS insight_date, CAST(sum(n) AS BIGINT) AS critical_count, CAST(sum(v) AS DOUBLE) AS total_value, string_agg(category, ', ' ORDER BY category) FILTER (WHERE place <= 5) AS top_categories
FROM (SELECT *, row_number() OVER (PARTITION BY audit_date ORDER BY n DESC, category) AS place FROM (SELECT audit_date, category, count(*) AS n, sum(total_inventory_value_usd) AS v FROM x WHERE q <= ss GROUP BY audit_date, category))
GROUP BY audit_date ORDER BY audit_date DESC LIMIT 7"""
    )
    s["location_picker"] = over("SELECT DISTINCT location FROM health", "health")
    s["category_picker"] = over("SELECT DISTINCT category FROM health", "health")
    s["read_stock_health"] = top(", ".join(tables.HEALTH_COLUMNS), "health", "risk_score DESC NULLS LAST, abc_class, category", None)
    s["read_active_alerts"] = top(", ".join(tables.ALERT_COLUMNS), "alerts", _BY_SEVERITY, None)
    s["read_reorder"] = top(", ".join(tables.REORDER_COLUMNS), "reorders", "priority_score DESC, estimated_order_value_usd DESC NULLS LAST", None)
    s["read_location"] = over(f"SELECT {', '.join(tables.LOCATION_COLUMNS)} FROM performance", "performance")
    s["read_heatmap"] = over(f"SELECT {', '.join(tables.HEATMAP_COLUMNS)} FROM heatmap", "heatmap")
    s["result_preview"] = top("sku_id, location, priority, days_until_stockout", "alerts", _BY_SEVERITY, 20, extra=", (SELECT greatest(0, count(*) - 20) FROM alerts) AS more_rows")

    # questions
    s["question_critical_by_risk"] = top("sku_name, location, category, quantity_on_hand, stock_status, risk_score", "health", "risk_score DESC NULLS LAST", 100, crit)
    s["question_value_by_location"] = over(f"SELECT location, {total('total_inventory_value_usd')} AS total_value FROM health GROUP BY location", "health")
    s["question_out_within_three_days"] = top(
        "sku_name, location, category, quantity_on_hand, days_until_stockout, stock_status", "health", "days_until_stockout", 100, "days_until_stockout > 0 AND days_until_stockout <= 3"
    )
    s["question_top_items_by_value"] = top("total_inventory_value_usd, sku_id, sku_name, location, category, quantity_on_hand", "health", "total_inventory_value_usd DESC NULLS LAST", 5)
    s["question_critical_value"] = over(f"SELECT count(*) AS critical_items, {total('total_inventory_value_usd')} AS critical_value FROM health WHERE {crit}", "health")
    s["question_best_suppliers"] = over(
        f"SELECT * FROM (SELECT supplier_name, {rnd(mean('supplier_ontime_pct'), 1)} AS avg_ontime_pct FROM health GROUP BY supplier_name) ORDER BY avg_ontime_pct DESC NULLS LAST, supplier_name", "health"
    )
    s["question_class_a_low"] = over(
        "SELECT sku_id, sku_name, location, quantity_on_hand, reorder_point, stock_status FROM health WHERE abc_class = 'A' AND stock_status IN ('OUT_OF_STOCK', 'CRITICAL', 'LOW')", "health"
    )
    s["question_alerts_by_location"] = over(f"SELECT location, count(*) AS alert_count, {tally("priority = 'CRITICAL'")} AS critical_alerts FROM alerts GROUP BY location", "alerts")
    s["question_urgent_reorders"] = over(
        """SELECT sku_name, location, category, quantity_on_hand, recommended_order_qty, priority_score, estimated_order_value_usd AS order_value FROM reorders WHERE priority_score >= 8
ORDER BY priority_score DESC, sku_name, location, category, quantity_on_hand, recommended_order_qty, order_value LIMIT 50""",
        "reorders",
    )
    s["question_categories_needing_attention"] = over(
        f"SELECT category, {tally("overall_status <> 'HEALTHY'")} AS troubled_locations, CAST(sum(critical_skus) AS BIGINT) AS critical_skus FROM heatmap GROUP BY category", "heatmap"
    )
    s["question_supplier_ontime_list"] = plain("SELECT DISTINCT supplier_name, supplier_ontime_pct FROM inventory WHERE supplier_name IS NOT NULL")

    # cleaning
    s["cleaned_inventory"] = _clean()
    s["loaded_inventory"] = _clean(nulled=True)
    s["rejected_rows"] = plain("SELECT *, CASE WHEN sku_id IS NULL THEN 'no sku_id' ELSE 'no batch_id' END AS reject_reason FROM raw WHERE sku_id IS NULL OR batch_id IS NULL", f"raw AS ({RAW})")

    # jobs
    s["generate_alerts"] = over(f"SELECT {_NEW_ALERT_COLUMNS} FROM x WHERE active AND attention AND NOT {_QUIET}", before=_HISTORY)
    s["stream_alert_log"] = over(
        """SELECT batch_id, sku_id, location, alert_type, priority, quantity_on_hand FROM (
SELECT 0 AS batch_id, * FROM x WHERE active AND attention AND stock_age_days % 2 = 0 UNION ALL
SELECT 1 AS batch_id, * FROM x WHERE active AND attention AND stock_age_days % 2 <> 0
  AND NOT EXISTS (SELECT 1 FROM x e WHERE e.active AND e.attention AND e.stock_age_days % 2 = 0 AND e.sku_id = x.sku_id AND e.location = x.location))"""
    )
    # the second batch comes 25 hours later: nothing is quiet any more
    s["stream_alert_log_next_day"] = over(
        """SELECT batch_id, sku_id, location, alert_type, priority, quantity_on_hand FROM (
SELECT 0 AS batch_id, * FROM x WHERE active AND attention AND stock_age_days % 2 = 0 UNION ALL
SELECT 1 AS batch_id, * FROM x WHERE active AND attention AND stock_age_days IS NOT NULL)"""
    )
    s["stream_alert_log_heartbeat"] = over(
        """SELECT batch_id, sku_id, location, alert_type, priority, quantity_on_hand FROM (
SELECT 0 AS batch_id, * FROM x WHERE active AND attention UNION ALL
SELECT 1 AS batch_id, * FROM x WHERE active AND attention AND (sku_id IS NULL OR location IS NULL) UNION ALL
SELECT 2 AS batch_id, * FROM x WHERE active AND attention)"""
    )
    s["generate_reorders"] = over(
        f"""SELECT sku_id, sku_name, category, location, order_qty AS recommended_qty, eoq AS economic_order_qty, score AS priority_score, unit_cost_usd, whole_order_value AS total_order_value_usd,
  'PENDING' AS status, supplier_name, supplier_id, 'SYSTEM' AS created_by FROM x WHERE active AND q <= rp AND NOT {_PENDING}""",
        before=_LOG,
    )
    s["purge_resolved"] = plain(
        f"SELECT sku_id, location, resolved, CAST(alert_timestamp AS DATE) AS alerted_on, CAST(resolved_timestamp AS DATE) AS resolved_on FROM history WHERE NOT coalesce(resolved AND resolved_timestamp < {NOW} - INTERVAL 90 DAY, false)", _HISTORY
    )
    s["purged_days"] = s["purge_resolved"]
    s["resolve_alerts"] = plain(
        f"""SELECT sku_id, location, resolved OR hit AS resolved, CASE WHEN hit AND NOT resolved THEN {DAY} ELSE CAST(resolved_timestamp AS DATE) END AS resolved_on, CAST(alert_timestamp AS DATE) AS alerted_on,
  CASE WHEN hit AND NOT resolved THEN 'planner' END AS resolved_by, CASE WHEN hit AND NOT resolved THEN 'restocked' END AS resolution_notes
FROM (SELECT *, EXISTS (SELECT 1 FROM inventory i WHERE i.abc_class = 'A' AND i.sku_id = history.sku_id AND i.warehouse_location = history.location) AS hit FROM history)""",
        _HISTORY,
    )
    status = "CASE abc_class WHEN 'A' THEN 'ORDERED' WHEN 'B' THEN 'DELIVERED' END"
    for name, rows in (("move_reorders", ""), ("move_reorders_in_order", "QUALIFY audit_date = max(audit_date) OVER (PARTITION BY sku_id, warehouse_location)")):
        s[name] = plain(
            f"""SELECT l.sku_id, l.location, CAST(l.action_timestamp AS DATE) AS action_date, coalesce(k.status, l.status) AS status, CASE WHEN k.status = 'ORDERED' THEN {DAY} END AS order_date,
  CASE WHEN k.status = 'DELIVERED' THEN {DAY} END AS actual_delivery_date
FROM log l LEFT JOIN (SELECT sku_id, location, CASE WHEN count(DISTINCT status) = 1 THEN max(status) END AS status
  FROM (SELECT sku_id, warehouse_location AS location, {status} AS status FROM inventory WHERE abc_class IN ('A', 'B') {rows}) GROUP BY ALL) k
  ON l.sku_id = k.sku_id AND l.location = k.location""",
            _LOG,
        )
    s["clashing_moves"] = plain(
        f"""SELECT sku_id, warehouse_location AS location, min({status}) AS first_status, max({status}) AS other_status FROM inventory WHERE abc_class IN ('A', 'B')
GROUP BY sku_id, warehouse_location HAVING count(DISTINCT abc_class) > 1"""
    )
    s["stock_override"] = plain("SELECT * FROM trial", _TRIAL)
    s["stock_override_critical"] = over("SELECT stock_status, count(*) AS item_count FROM health GROUP BY stock_status", "health", source="trial", before=_TRIAL)
    s["inventory_changes"] = plain(
        f"""SELECT {_STATE_COLUMNS}, CASE WHEN net > 0 THEN 'INSERT' ELSE 'DELETE' END AS change_action,
  min(net) OVER (PARTITION BY sku_id, batch_id) < 0 AND max(net) OVER (PARTITION BY sku_id, batch_id) > 0 AS is_update, CAST(abs(net) AS BIGINT) AS copies FROM net""",
        _OLD, _NEW, _NET,
    )
    s["has_changes"] = plain("SELECT count(*) > 0 AS has_data FROM net", _OLD, _NEW, _NET)
    s["applied_changes"] = plain(f"SELECT {_STATE_COLUMNS} FROM new_state", _NEW)
    s["state_changes"] = s["inventory_changes"]
    headings = ", ".join(f'{name} AS "{heading}"' for name, heading in sinks.EXPORT_HEADINGS.items())
    s["export_reorder"] = over(f"SELECT {headings} FROM reorders WHERE location = 'NATION_1'", "reorders")
    shown = (
        "sku_id, sku_name, category, location, warehouse_id, abc_class, quantity_on_hand, quantity_reserved, quantity_committed, available_stock, reorder_point, safety_stock, lead_time_days, "
        "avg_daily_sales, forecast_next_30d, recommended_order_qty, economic_order_qty, priority_score, unit_cost_usd, estimated_order_value_usd, supplier_name, supplier_id, "
        "supplier_ontime_pct, days_of_inventory, order_frequency_per_month"
    )
    renamed = ", ".join(f'{n} AS "{sinks.SHOWN_HEADINGS[n]}"' if n in sinks.SHOWN_HEADINGS else n for n in shown.split(", "))
    s["export_shown_list"] = over(
        f"SELECT {renamed} FROM (SELECT * FROM reorders ORDER BY priority_score DESC, estimated_order_value_usd DESC NULLS LAST, {shown} LIMIT 100)", "reorders"
    )
    s["export_log"] = over(
        """SELECT 'REORDER_LIST' AS export_type, count(*) AS record_count, 'user' AS exported_by, 'CSV' AS file_format, '{"category": "All", "location": "All"}' AS filters_applied FROM reorders""",
        "reorders",
    )
    return s
