"""Aggregates over the derived item tables: dashboard figures and insight context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import constants as K
from larder.functions import metrics as M
from larder.functions import predicates as P
from larder.functions.numeric import (
    as_double,
    count_when,
    exact_mean,
    exact_sum,
    ladder,
    mean,
    ratio,
    round_to,
)
from larder.operators import items
from larder.operators.distinct import counted_once, first_places
from larder.operators.ranking import joined_text, numbered, ranked
from larder.operators.skew import amount_counts, exact_median


def _is(status: str) -> Column:
    return F.col("stock_status") == status


def _known_days() -> Column:
    days = F.col("days_until_stockout")
    return F.when(days < K.NO_DEMAND_DAYS, days)


def _within(days: int) -> Column:
    return F.col("days_until_stockout") <= days


def health_by_location_category(health: DataFrame, k: int = 10) -> DataFrame:
    groups = health.groupBy("location", "category").agg(
        F.count(F.lit(1)).alias("items"),
        count_when(_is(K.CRITICAL)).alias("critical_items"),
        count_when(_is(K.LOW)).alias("low_items"),
    )
    return ranked(groups, k, F.desc("critical_items"))


def alerts_by_priority(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("priority").agg(
        F.count(F.lit(1)).alias("alert_count"),
        exact_mean(F.col("days_until_stockout"), 1).alias("avg_days_until_stockout"),
        F.max(M.ordinal("priority", K.PRIORITIES)).alias("severity_rank"),
    )


def inventory_summary(health: DataFrame) -> DataFrame:
    """One-row overview. Three distinct counts over (location, category, sku) cells, without copied rows."""
    cells = health.groupBy("location", "category", "sku_id").agg(
        F.sum("total_inventory_value_usd").alias("value"),
        count_when(_is(K.CRITICAL)).alias("critical"),
        count_when(_is(K.LOW)).alias("low"),
        count_when(_is(K.MODERATE)).alias("moderate"),
        count_when(_is(K.HEALTHY)).alias("healthy"),
        count_when(_within(3)).alias("d3"),
        count_when(_within(7)).alias("d7"),
        count_when(_within(14)).alias("d14"),
        F.sum(_known_days().cast("decimal(18,1)")).alias("days"),
        F.count(_known_days()).alias("days_n"),
    )

    def summed(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    places = counted_once(cells, "sku_id", ("location", "category"), "items")
    return first_places(places, ("location", "category"), ("locations", "categories")).agg(
        summed("items").alias("total_items"),
        F.count_if("locations").alias("total_locations"),
        F.count_if("categories").alias("total_categories"),
        as_double(F.sum("value")).alias("total_value"),
        summed("critical").alias("critical_count"),
        summed("low").alias("low_count"),
        summed("moderate").alias("moderate_count"),
        summed("healthy").alias("healthy_count"),
        summed("d3").alias("days_3_count"),
        summed("d7").alias("days_7_count"),
        summed("d14").alias("days_14_count"),
        round_to(ratio(F.sum("days"), F.sum("days_n")), 1).alias("avg_days_to_stockout"),
    )


def abc_summary(health: DataFrame) -> DataFrame:
    return health.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("item_count"),
        as_double(F.sum("total_inventory_value_usd")).alias("value"),
        count_when(_is(K.CRITICAL)).alias("critical_count"),
    )


def location_breakdown(health: DataFrame, k: int = 10) -> DataFrame:
    groups = health.groupBy("location").agg(
        count_when(_is(K.CRITICAL)).alias("critical"),
        count_when(_is(K.LOW)).alias("low"),
        count_when(_is(K.HEALTHY)).alias("healthy"),
    )
    return ranked(groups, k, F.desc("critical"))


def category_breakdown(health: DataFrame, k: int = 10) -> DataFrame:
    groups = health.groupBy("category").agg(
        count_when(_is(K.CRITICAL)).alias("critical"),
        round_to(exact_mean(F.col("risk_score"), 0), 1).alias("avg_risk"),
    )
    return ranked(groups, k, F.desc("critical"))


def reorder_stats(reorders: DataFrame) -> DataFrame:
    return reorders.agg(
        F.count(F.lit(1)).alias("items_to_reorder"),
        count_when(F.col("priority_score") >= K.URGENT_SCORE).alias("urgent_items"),
        F.coalesce(exact_sum(F.col("estimated_order_value_usd"), 2), F.lit(0.0)).alias("total_order_value"),
    )


def dashboard_kpis(health: DataFrame) -> DataFrame:
    """Headline figures.

    ``kpi_total_value`` keeps the dashboard's shortcut (all units times mean unit cost);
    ``exact_total_value`` sums units times cost per row. Empty items do not lower the
    health figure.
    """
    troubled = count_when(_is(K.CRITICAL) | _is(K.LOW))
    rows = F.count(F.lit(1))
    return health.agg(
        count_when(_is(K.CRITICAL)).alias("critical_items"),
        count_when(_is(K.LOW)).alias("low_stock"),
        round_to(exact_mean(_known_days(), 1), 1).alias("avg_days_to_stockout"),
        round_to(as_double(F.sum("quantity_on_hand")) * mean("unit_cost_usd"), 2).alias("kpi_total_value"),
        as_double(F.sum(F.col("quantity_on_hand") * F.col("unit_cost_usd"))).alias("exact_total_value"),
        F.coalesce(100 - ratio(troubled, rows) * 100, F.lit(0.0)).alias("health_pct"),
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        count_when(F.col("priority").isin(*K.PRIORITIES[:2])).alias("critical_alerts"),
        count_when(F.col("priority") == K.PRIORITIES[2]).alias("medium_alerts"),
        round_to(exact_mean(_known_days(), 1), 1).alias("avg_days_to_stockout"),
        F.count_distinct("location").alias("locations_affected"),
    )


def reorder_summary(reorders: DataFrame, value_from: str = "estimate", urgent_from: str = "score") -> DataFrame:
    """Order totals; ``value_from="reorder_point"`` prices whole reorder points instead.

    ``urgent_from="stock"`` counts items at or below their safety stock, for lists without a score.
    """
    urgent = F.col("priority_score") >= K.URGENT_SCORE if urgent_from == "score" else M.at_safety()
    if value_from == "estimate":
        value = exact_sum(F.col("estimated_order_value_usd"), 2)
    else:
        value = as_double(F.sum(F.col("reorder_point") * F.col("unit_cost_usd")))
    return reorders.agg(
        F.count(F.lit(1)).alias("items_to_reorder"),
        F.coalesce(value, F.lit(0.0)).alias("total_order_value"),
        count_when(urgent).alias("urgent_items"),
        F.count_distinct("supplier_name").alias("suppliers"),
    )


def abc_at_risk(health: DataFrame) -> DataFrame:
    class_a = F.col("abc_class") == "A"
    at_risk = class_a & F.col("stock_status").isin(K.CRITICAL, K.LOW)
    return health.agg(
        count_when(at_risk).alias("class_a_at_risk"),
        count_when(class_a).alias("class_a_items"),
        F.coalesce(round_to(ratio(count_when(at_risk), count_when(class_a)) * 100, 1), F.lit(0.0)).alias("class_a_at_risk_pct"),
        round_to(mean("unit_cost_usd"), 2).alias("avg_unit_cost"),
        count_when(_within(7)).alias("items_within_week"),
    )


def abc_distribution(health: DataFrame) -> DataFrame:
    return health.groupBy("abc_class").agg(F.count(F.lit(1)).alias("item_count"))


def abc_value_share(health: DataFrame) -> DataFrame:
    """Value per class, its share, and for class A how well the share fits the idea of ABC."""
    values = health.groupBy("abc_class").agg(
        as_double(F.sum(F.col("quantity_on_hand") * F.col("unit_cost_usd"))).alias("total_value")
    )
    # the window runs over one row per class
    share = round_to(ratio(F.col("total_value"), F.sum("total_value").over(Window.partitionBy())) * 100, 1)
    verified, moderate = K.ABC_VALUE_BANDS
    verdict = ladder(
        (F.col("value_pct") >= verified, "VERIFIED"),
        (F.col("value_pct") >= moderate, "MODERATE"),
        default="REVIEW",
    )
    return values.withColumn("value_pct", share).withColumn("verdict", F.when(F.col("abc_class") == "A", verdict))


def abc_cost_stats(health: DataFrame) -> DataFrame:
    """Mean, exact median and number of unit costs per class, all from one count per cost."""
    counts = amount_counts(health, "abc_class", "unit_cost_usd")
    costs = counts.groupBy("abc_class").agg(
        round_to(ratio(F.sum(F.col("unit_cost_usd") * F.col("n")), F.sum("n")), 2).alias("avg_cost"),
        F.sum("n").alias("item_count"),
    )
    medians = exact_median(counts, "abc_class", "unit_cost_usd").select(
        F.col("abc_class").alias("_class"), round_to(F.col("median"), 2).alias("median_cost")
    )
    return costs.join(medians, F.col("abc_class").eqNullSafe(F.col("_class")), "left").drop("_class")


def abc_risk(health: DataFrame) -> DataFrame:
    return health.groupBy("abc_class").agg(exact_mean(F.col("risk_score"), 0).alias("avg_risk_score"))


def heatmap_pivot(heatmap: DataFrame, metric: str, locations: list[str] | None = None) -> DataFrame:
    """Category by location matrix of ``risk``, ``cover`` or ``critical_pct``.

    Naming the locations saves a job; without them Spark looks them up and refuses more
    than ``spark.sql.pivotMaxValues``.
    """
    value = {
        "risk": F.col("avg_risk_score"),
        "cover": F.col("avg_days_coverage"),
        "critical_pct": F.coalesce(ratio(F.col("critical_skus"), F.col("total_skus")) * 100, F.lit(0.0)),
    }[metric]
    cells = heatmap.select("category", "location", value.alias("value"))
    return cells.groupBy("category").pivot("location", locations).agg(F.avg("value"))


def category_by_location(health: DataFrame) -> DataFrame:
    """Cells of the category by location matrix from item rows: mean risk, mean days, share of critical rows."""
    placed = health.where(F.col("category").isNotNull() & F.col("location").isNotNull())
    return placed.groupBy("category", "location").agg(
        exact_mean(F.col("risk_score"), 0).alias("avg_risk"),
        exact_mean(F.col("days_until_stockout"), 1).alias("avg_days"),
        ratio(count_when(_is(K.CRITICAL)) * 100, F.count(F.lit(1))).alias("critical_pct"),
    )


def status_counts(health: DataFrame) -> DataFrame:
    return health.groupBy("stock_status").agg(F.count(F.lit(1)).alias("item_count"))


def status_by_category(health: DataFrame) -> DataFrame:
    statuses = [K.OUT_OF_STOCK, K.CRITICAL, K.LOW, K.MODERATE, K.HEALTHY]
    return health.groupBy("category").pivot("stock_status", statuses).count().na.fill(0)


def _scarcity(name: Column, location: Column, quantity: Column) -> Column:
    return F.concat(name, F.lit(" at "), location, F.lit(" has only "), quantity.cast("string"), F.lit(" units left"))


def critical_item_list(inventory: DataFrame) -> DataFrame:
    """All critical items as sentences, scarcest first, a hundred to a row (part, critical_items)."""
    return joined_text(numbered(critical_item_entries(inventory), F.asc("quantity_on_hand")), "entry", "critical_items")


def critical_item_entries(inventory: DataFrame) -> DataFrame:
    """All critical items, a row with its part of the sentence each, scarcest first; like the list, without parts that are null."""
    entry = _scarcity(F.col("sku_name"), F.col("warehouse_location"), F.col("quantity_on_hand")).alias("entry")
    rows = inventory.where(M.at_safety()).select("quantity_on_hand", "sku_name", "warehouse_location", entry)
    return ranked(rows.where(F.col("entry").isNotNull()), None, F.asc("quantity_on_hand")).select("quantity_on_hand", "entry")


def critical_categories(inventory: DataFrame) -> DataFrame:
    """The categories with critical items by name, a hundred to a row (part, critical_categories)."""
    names = inventory.where(M.at_safety() & F.col("category").isNotNull()).select("category").distinct()
    return joined_text(numbered(names), "category", "critical_categories")


def _insight(per_category: DataFrame, date: Column) -> DataFrame:
    worst = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))), 1, 5)
    names = F.array_sort(F.transform(worst, lambda e: e["category"]))
    return per_category.agg(
        date.alias("insight_date"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("critical_count"),
        as_double(F.sum("v")).alias("total_value"),
        F.array_join(names, ", ").alias("top_categories"),
    )


def daily_insight_row(inventory: DataFrame, as_of: str) -> DataFrame:
    """Count and value of critical rows and their five most frequent categories, in one pass."""
    per_category = (
        inventory.where(M.at_safety())
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_inventory_value_usd").alias("v"))
    )
    return _insight(per_category, F.to_date(F.lit(as_of)))


def insights_by_audit_date(inventory: DataFrame) -> DataFrame:
    """The same figures for every audit day."""
    per_category = (
        inventory.where(M.at_safety())
        .groupBy("audit_date", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_inventory_value_usd").alias("v"))
    )
    return _insight(per_category.groupBy("audit_date"), F.max("audit_date")).drop("audit_date")


_STATES = (K.CRITICAL, K.LOW, K.MODERATE, K.HEALTHY)
_INSIGHT_KEYS = ("location", "category", "abc_class")
_LISTED = 10


def _insight_cells(inventory: DataFrame) -> DataFrame:
    """One row per (location, category, class) with the summed measures of active rows; an item counts once."""
    needs = P.needs_reorder()
    rows = inventory.where(P.is_active()).select(
        F.col("warehouse_location").alias("location"),
        "category",
        "abc_class",
        "sku_id",
        F.col("total_inventory_value_usd").alias("value"),
        M.stock_status().alias("stock_status"),
        M.days_until_stockout(no_demand=K.NO_DEMAND_DAYS).alias("days_until_stockout"),
        M.risk_score().cast("decimal(18,0)").alias("risk"),
        needs.alias("due"),
        F.when(needs, M.priority_score()).alias("score"),
        F.when(needs, M.estimated_order_value().cast("decimal(18,2)")).alias("order_value"),
    )
    cells = rows.groupBy(*_INSIGHT_KEYS, "sku_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("value").alias("value"),
        *[count_when(_is(s)).alias(s.lower()) for s in _STATES],
        *[count_when(_within(d)).alias(f"d{d}") for d in (3, 7, 14)],
        F.sum(_known_days().cast("decimal(18,1)")).alias("days"),
        F.count(_known_days()).alias("days_n"),
        F.sum("risk").alias("risk"),
        F.count("risk").alias("risk_n"),
        count_when(F.col("due")).alias("due"),
        count_when(F.col("score") >= K.URGENT_SCORE).alias("urgent"),
        F.sum("order_value").alias("order_value"),
    )
    return counted_once(cells, "sku_id", _INSIGHT_KEYS, "items")


def insight_context(inventory: DataFrame) -> DataFrame:
    """Everything an insight text needs, as one nested row.

    All figures come from one scan: rows fold to cells, and one pass of grouping sets over the cells gives the
    whole, the classes, the locations and the categories. Only the ten worst places of a kind reach the row. The
    worst items are a second scan. An empty table gives counts of 0 and empty lists.
    """
    cells = _insight_cells(inventory)
    measures = [c for c in cells.columns if c not in _INSIGHT_KEYS]
    marked = first_places(cells, ("location", "category"), ("locations", "categories"), "abc_class")
    sets = marked.groupingSets([[], ["abc_class"], ["location"], ["category"]], *_INSIGHT_KEYS).agg(
        F.grouping_id().alias("kind"),
        F.count_if("locations").alias("locations"),
        F.count_if("categories").alias("categories"),
        *[F.sum(m).alias(m) for m in measures],
    )
    whole, by_class, by_location, by_category = (F.col("kind") == kind for kind in (0b111, 0b110, 0b011, 0b101))
    name = F.coalesce("location", "category")
    worst_first = Window.partitionBy("kind", "abc_class").orderBy(F.desc("critical"), F.asc_nulls_last(name))
    kept = sets.withColumn("place", F.row_number().over(worst_first)).where(F.col("place") <= _LISTED)

    def value(column: str) -> Column:
        return F.max(F.when(whole, F.col(column)))

    def count(column: str) -> Column:
        return F.coalesce(value(column), F.lit(0))

    def listed(kind: Column, sort: Column, *columns: Column) -> Column:
        entries = F.collect_list(F.when(kind, F.struct(sort.alias("_sort"), F.struct(*columns).alias("row"))))
        return F.transform(F.sort_array(entries), lambda e: e["row"])

    class_order = F.struct(F.col("abc_class").isNull(), F.col("abc_class"))
    figures = kept.agg(
        F.struct(
            count("items").alias("total_items"),
            count("locations").alias("total_locations"),
            count("categories").alias("total_categories"),
            as_double(value("value")).alias("total_value"),
            *[count(s.lower()).alias(f"{s.lower()}_count") for s in _STATES],
            *[count(f"d{d}").alias(f"days_{d}_count") for d in (3, 7, 14)],
            round_to(ratio(value("days"), value("days_n")), 1).alias("avg_days_to_stockout"),
        ).alias("overview"),
        listed(
            by_class, class_order,
            F.col("abc_class"), F.col("rows").alias("item_count"),
            as_double("value").alias("value"), F.col("critical").alias("critical_count"),
        ).alias("abc_classes"),
        listed(by_location, F.col("place"), *[F.col(c) for c in ("location", "critical", "low", "healthy")]).alias("locations"),
        listed(
            by_category, F.col("place"),
            F.col("category"), F.col("critical"), round_to(ratio(F.col("risk"), F.col("risk_n")), 1).alias("avg_risk"),
        ).alias("categories"),
        F.struct(
            count("due").alias("items_to_reorder"),
            count("urgent").alias("urgent_items"),
            F.coalesce(as_double(value("order_value")), F.lit(0.0)).alias("total_order_value"),
        ).alias("reorders"),
    )

    def status(name: str) -> Column:
        n = F.col(f"overview.{name.lower()}_count")
        pct = F.coalesce(round_to(ratio(n, F.col("overview.total_items")) * 100, 1), F.lit(0.0))
        return F.struct(F.lit(name).alias("status"), n.alias("count"), pct.alias("pct"))

    return figures.select("*", _worst_items(inventory).alias("top_items"), F.array(*[status(s) for s in _STATES]).alias("statuses"))


def _worst_items(inventory: DataFrame) -> Column:
    """The ten items of the highest risk, worst first, as an array."""
    columns = ("sku_name", "location", "category", "quantity_on_hand", "days_until_stockout", "risk_score")
    top = ranked(items.stock_health(inventory).select(*columns), _LISTED, F.desc("risk_score"))
    rows = F.struct((-F.col("risk_score")).alias("_risk"), *[F.col(c).alias(f"_{c}") for c in columns[:-1]], F.struct(*columns).alias("row"))
    return top.agg(F.transform(F.sort_array(F.collect_list(rows)), lambda e: e["row"])).scalar()


def insight_facts(context: DataFrame) -> DataFrame:
    """The nested row laid out as (section, place, name, measure, value), from one pass over it."""

    def facts(section: str, rows: Column, name: str, *measures: str) -> Column:
        def of_row(row: Column, at: Column) -> Column:
            named = row[name].cast("string") if name else F.lit("")
            return F.array(*[
                F.struct(
                    F.lit(section).alias("section"), (at + 1).alias("place"), named.alias("name"),
                    F.lit(m).alias("measure"), as_double(row[m]).alias("value"),
                )
                for m in measures
            ])

        return F.flatten(F.transform(rows, of_row))

    overview = (
        "total_items", "total_locations", "total_categories", "total_value", "avg_days_to_stockout",
        "days_3_count", "days_7_count", "days_14_count",
    )
    parts = (
        facts("overview", F.array("overview"), "", *overview),
        facts("status", F.col("statuses"), "status", "count", "pct"),
        facts("abc", F.col("abc_classes"), "abc_class", "item_count", "value", "critical_count"),
        facts("location", F.col("locations"), "location", "critical", "low", "healthy"),
        facts("category", F.col("categories"), "category", "critical", "avg_risk"),
        facts("reorder", F.array("reorders"), "", "items_to_reorder", "urgent_items", "total_order_value"),
        facts("top_item", F.col("top_items"), "sku_name", "quantity_on_hand", "days_until_stockout", "risk_score"),
    )
    return context.select(F.inline(F.concat(*parts)))
