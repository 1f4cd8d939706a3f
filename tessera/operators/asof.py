"""Point-in-time joins: as-of, next session, validity intervals, calendar densifying."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, right_date: str, columns: Sequence[str], key: str = "code", date: str = "date") -> DataFrame:
    """Each left row with the last right row of its key on or before its date, null fields included.

    Both sides go through one shuffle on the key as a union; a key's rows are ordered once. No range join, and the number of
    rows does not grow.
    """
    value = F.struct(*columns)
    names = [c for c in left.columns if c not in (key, date)]
    a = left.select(F.col(key), F.col(date).alias("__d"), F.lit(1).alias("__s"), F.struct(*names, F.lit(0).alias("__x")).alias("__l"))
    b = right.filter(F.col(right_date).isNotNull()).select(F.col(key), F.col(right_date).alias("__d"), F.lit(0).alias("__s"), value.alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("__d", "__s").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__r", F.last("__r", ignorenulls=True).over(upto)).filter("__s = 1")
    return both.select(key, F.col("__d").alias(date), *(F.col(f"__l.`{c}`") for c in names), *(F.col(f"__r.`{c}`") for c in columns))


def next_session(df: DataFrame, calendar: DataFrame, date: str, out: str = "session", strict: bool = True) -> DataFrame:
    """The first session after ``date`` (from it on if not strict), by the as-of idea turned round: one global order of the
    distinct dates alone, then an equi-join."""
    days = df.select(F.col(date).alias("__d")).distinct().withColumn("__s", F.lit(1 if strict else 0)).union(calendar.select(F.col("date"), F.lit(0 if strict else 1)))
    onward = Window.partitionBy(F.lit(0)).orderBy("__d", "__s").rowsBetween(1, Window.unboundedFollowing)
    session = F.when(F.col("__s") == (0 if strict else 1), F.col("__d"))
    known = days.withColumn(out, F.first(session, ignorenulls=True).over(onward)).filter(F.col("__s") == (1 if strict else 0)).select("__d", out)
    return df.join(known, F.col(date) == F.col("__d"), "left").drop("__d")


def valid_at(left: DataFrame, log: DataFrame, value: str, key: str = "code", date: str = "date") -> DataFrame:
    """The value valid at a date and already published: valid_from <= date < valid_to and available_from <= date; of several
    the one published last. ``log`` has one row per change of a key, so the join is by key with a range condition."""
    mine = log.select(F.col(key).alias("__k"), "valid_from", "valid_to", "available_from", F.col(value))
    on = (F.col(key) == F.col("__k")) & (F.col("valid_from") <= F.col(date)) & (F.col("valid_to").isNull() | (F.col(date) < F.col("valid_to"))) & (F.col("available_from") <= F.col(date))
    hit = left.select(key, date).distinct().join(mine, on).groupBy(key, date).agg(F.max_by(value, F.struct("available_from", "valid_from")).alias(value))
    return left.join(hit, [key, date], "left")


def intervals(log: DataFrame, key: str = "code") -> DataFrame:
    """A change log as validity intervals: valid_to = next valid_from, available_from = the later of start and publication."""
    w = Window.partitionBy(key).orderBy("valid_from")
    return log.withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("available_from", F.greatest("valid_from", "published"))


def densify(bars: DataFrame, calendar: DataFrame, key: str = "code", date: str = "date") -> DataFrame:
    """Every session between an entity's first and last bar; bars that lack are null."""
    span = bars.groupBy(key).agg(F.min(date).alias("a"), F.max(date).alias("z"))
    grid = span.join(F.broadcast(calendar.select(F.col("date").alias(date))) if _few_days(calendar) else calendar, F.col(date).between(F.col("a"), F.col("z"))).select(key, date)
    return grid.join(bars, [key, date], "left")


def _few_days(calendar: DataFrame, most: int = 100_000) -> bool:
    """A calendar grows by 366 rows a year at most; its size is checked before it is broadcast."""
    return calendar.select("date").distinct().limit(most + 1).count() <= most


def session_number(calendar: DataFrame) -> DataFrame:
    """(date, ord): sessions counted from 1. A calendar is one short ordered list, so one task numbers it."""
    return calendar.withColumn("ord", F.row_number().over(Window.orderBy("date")))


def full_outer_previous(weights: DataFrame, date: str = "date", key: str = "code") -> DataFrame:
    """(date, key, weight, before): each portfolio beside the one emitted before it."""
    days = weights.select(date).distinct().withColumn("__n", F.row_number().over(Window.orderBy(date)))
    now = weights.join(days, date).select("__n", key, "weight")
    was = now.select((F.col("__n") + 1).alias("__n"), key, F.col("weight").alias("before"))
    both = now.join(was, ["__n", key], "full_outer").join(days, "__n")
    return both.select(date, key, F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("before", F.lit(0.0)).alias("before"))


def present(*columns: str) -> Column:
    return F.coalesce(*(F.col(c) for c in columns))
