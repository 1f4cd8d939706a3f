"""Rolling expressions over one entity's rows in date order.

All windows share one partitioning and order, so a select with any number of them is one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec



def wc() -> WindowSpec:
    """The rows of an entity in date order."""
    return Window.partitionBy("code").orderBy("date")


def wd() -> WindowSpec:
    """The rows of a date."""
    return Window.partitionBy("date")


def rows(n: int):
    return wc().rowsBetween(-(n - 1), 0)


def roll(f: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None) -> Column:
    """``f`` over the last n rows, null until ``least`` (default n) of them have a value."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(rows(n)) >= (n if least is None else least), f(x).over(rows(n)))


def change(x: str, n: int) -> Column:
    """Relative change against n rows before; null where that is null or zero."""
    return F.try_divide(F.col(x), F.lag(x, n).over(wc())) - 1


def forward(x: str, n: int, base: Column | None = None) -> Column:
    """Return from ``base`` (default: this row) to the value n rows later."""
    return F.try_divide(F.lead(x, n).over(wc()), F.col(x) if base is None else base) - 1


def gap(x: str, n: int) -> Column:
    """Relative distance from the n-row mean."""
    return F.try_divide(F.col(x), roll(F.avg, x, n)) - 1


def position_in_range(close: str, high: str, low: str, n: int) -> Column:
    top, bottom = roll(F.max, high, n), roll(F.min, low, n)
    return F.try_divide(F.col(close) - bottom, top - bottom)


def true_range(high: str = "high", low: str = "low", close: str = "close") -> Column:
    before = F.lag(close).over(wc())
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def mean_absolute_deviation(x: Column, n: int) -> Column:
    items = F.collect_list(x).over(rows(n))
    mean = F.aggregate(items, F.lit(0.0), lambda a, v: a + v) / F.lit(float(n))
    return F.when(F.size(items) == n, F.aggregate(items, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.lit(float(n)))
