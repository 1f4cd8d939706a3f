"""Keyed merges: which of several rows with a key wins is always by a stated order, never by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", nth).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; within a side the last by ``order`` wins."""
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)), allowMissingColumns=True)
    return pick(both, keys, [F.desc("__b"), *(F.desc(c) for c in order)]).drop("__b")


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """First wins: rows of ``new`` are added only where their keys are unknown."""
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)), allowMissingColumns=True)
    return pick(both, keys, [F.asc("__b"), *(F.asc(c) for c in order)]).drop("__b")


def replace_keys(history: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History without the keys of ``fresh``, and ``fresh``; columns are united."""
    return history.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def warm_tail(df: DataFrame, start: str, warmup: int, key: str = "code", date: str = "date") -> DataFrame:
    """All rows from ``start`` on, and the last ``warmup`` rows of each key before it."""
    day = F.lit(start).cast("date")
    before = Window.partitionBy(key, F.col(date) >= day).orderBy(F.desc(date))
    return df.withColumn("__n", F.row_number().over(before)).filter((F.col(date) >= day) | (F.col("__n") <= warmup)).drop("__n")


def freshness(df: DataFrame, universe: DataFrame, key: str = "code", date: str = "date") -> DataFrame:
    """(key, last, fresh) for each key of the universe: whether its last date is the table's last."""
    last = df.groupBy(key).agg(F.max(date).alias("last"))
    top = df.agg(F.max(date).alias("top"))
    return universe.select(key).distinct().join(last, key, "left").crossJoin(F.broadcast(top)).select(key, "last", F.coalesce(F.col("last") == F.col("top"), F.lit(False)).alias("fresh"))


def require(df: DataFrame, violations: Column, message: str) -> DataFrame:
    """The table itself; a row that violates a constraint stops the job."""
    return df.filter(F.when(F.coalesce(violations, F.lit(False)), F.raise_error(F.lit(message)).isNull()).otherwise(F.lit(True)))


def missing_months(panel: DataFrame, existing: DataFrame, latest: int, date: str = "date") -> DataFrame:
    """(month): the latest n months of the span, and those that ``existing`` lacks."""
    span = panel.agg(F.date_trunc("month", F.min(date)).alias("a"), F.date_trunc("month", F.max(date)).alias("z"))
    every = span.select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("m"), "z").select(F.date_format("m", "yyyy-MM").alias("month"), (F.col("m") > F.add_months("z", -latest)).alias("late"))
    return every.join(existing.select("month").distinct().withColumn("have", F.lit(True)), "month", "left").filter("late or have is null").select("month")
