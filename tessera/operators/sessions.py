"""Trading sessions as ordinals, so that ages and next sessions are equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_days(calendar: DataFrame) -> DataFrame:
    """(day, is_session, upto, before, next_session, next_nth) for every day between the first and the last session: sessions up
    to the day and before it, and the first session from the day on with its ordinal. One row a day, so that one ordering
    serves all."""
    ends = calendar.agg(F.min("date").alias("a"), F.max("date").alias("z")).filter("a is not null")
    days = ends.select(F.explode(F.sequence("a", "z")).alias("day")).join(calendar.select(F.col("date").alias("day"), F.lit(True).alias("is_session")), "day", "left")
    days = days.withColumn("is_session", F.coalesce("is_session", F.lit(False)))
    by_day = Window.orderBy("day")
    days = days.withColumn("upto", F.sum(F.col("is_session").cast("long")).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumns({"before": F.col("upto") - F.col("is_session").cast("long"), "next_session": F.min(F.when(F.col("is_session"), F.col("day"))).over(by_day.rowsBetween(0, Window.unboundedFollowing))})
    return days.withColumn("next_nth", F.col("before") + 1)


def listing_sessions(rows: DataFrame, listed: DataFrame, calendar: DataFrame) -> DataFrame:
    """(code, date, listing_sessions): sessions from a code's list_date to the row's date, both counted; null before it and
    without a list date. A list date before the calendar counts from its first session."""
    days = session_days(calendar)
    start = listed.join(days.select(F.col("day").alias("list_date"), "before"), "list_date", "left").select("code", "list_date", F.coalesce("before", F.lit(0)).alias("before"))
    at = rows.join(days.select(F.col("day").alias("date"), "upto"), "date", "left").join(start, "code", "left")
    return at.select("code", "date", F.when(F.col("date") >= F.col("list_date"), F.col("upto") - F.col("before")).alias("listing_sessions"))
