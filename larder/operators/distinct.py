"""Several distinct counts next to sums, without copying rows.

Two ``count(distinct ...)`` in one aggregate make Spark copy every row once per count. Here a value counts at
its first place alone, so each distinct count becomes a plain sum of marks. The input is cells, one row per
combination of the counted columns: a window over one value holds at most one row per place of the others,
whatever the number of rows behind them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_first(keys: Iterable[str], *order: str) -> Column:
    """True at one row of each combination of ``keys``; NULL is a value like others."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1


def counted_once(cells: DataFrame, value: str, places: tuple[str, ...], alias: str) -> DataFrame:
    """Fold cells per (places, value) to places: measures add up, ``alias`` adds up to the distinct non-null values."""
    measures = [c for c in cells.columns if c not in (*places, value)]
    marked = cells.withColumn(alias, F.col(value).isNotNull() & is_first([value], *places))
    return marked.groupBy(*places).agg(F.count_if(alias).alias(alias), *[F.sum(m).alias(m) for m in measures])


def first_places(cells: DataFrame, values: tuple[str, ...], aliases: tuple[str, ...], *order: str) -> DataFrame:
    """Mark for each of ``values`` one cell per non-null value, in the column of ``aliases``.

    Values and ``order`` together must tell the cells apart.
    """
    marks = {
        alias: F.col(value).isNotNull() & is_first([value], *[v for v in values if v != value], *order)
        for value, alias in zip(values, aliases, strict=True)
    }
    return cells.withColumns(marks)
