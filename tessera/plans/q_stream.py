"""Queries of the tick operators in their batch form (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cross import rank_pct
from tessera.operators.asof import asof
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables
from tessera.streaming import ticks as tk

ST = "st AS (SELECT *, lag(last) OVER w AS prev, lag(ts) OVER w AS prev_ts, max(last) OVER s AS high, min(last) OVER s AS low, first_value(last) OVER s AS first, CASE WHEN amount / nullif(volume, 0) / nullif(last, 0) BETWEEN 0.5 AND 2 THEN amount / nullif(volume, 0) END AS vwap, amount - lag(amount) OVER w AS delta FROM ticks WINDOW w AS (PARTITION BY code ORDER BY ts, event_id), s AS (PARTITION BY code ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"
DAY = 86400


def first_sql(condition: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, event_id) AS rn FROM st WHERE {condition}) WHERE rn = 1"


@query("t01_quote_fields", f"WITH {ST} SELECT event_id, last / nullif(prev, 0) - 1 AS pct, (high - low) / nullif(last, 0) AS spread, last >= high - 0.001 AS at_high FROM st")
def quote_fields(t: Tables) -> DataFrame:
    s = tk.intraday_state(t.ticks)
    return s.select("event_id", (F.try_divide("last", F.nullif("prev", F.lit(0.0))) - 1).alias("pct"), F.try_divide(F.col("high") - F.col("low"), F.nullif("last", F.lit(0.0))).alias("spread"), (F.col("last") >= F.col("high") - 0.001).alias("at_high"))


@query("t02_state", f"WITH {ST} SELECT code, event_id, prev, high, low, first, delta FROM st")
def state(t: Tables) -> DataFrame:
    return tk.intraday_state(t.ticks).select("code", "event_id", "prev", "high", "low", "first", "delta")


@query("t03_vwap", f"WITH {ST} SELECT event_id, vwap FROM st")
def vwap(t: Tables) -> DataFrame:
    return tk.intraday_state(t.ticks).select("event_id", "vwap")


@query("t04_quote_age", "SELECT code, date_diff('second', max(ts), (SELECT max(ts) FROM ticks)) AS age_s FROM ticks GROUP BY code")
def quote_age(t: Tables) -> DataFrame:
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    top = t.ticks.agg(sec(F.max("ts")).alias("top"))
    return t.ticks.groupBy("code").agg(sec(F.max("ts")).alias("at")).crossJoin(F.broadcast(top)).select("code", (F.col("top") - F.col("at")).alias("age_s"))


@query("t06_surge", f"WITH {ST} SELECT event_id, last / nullif(prev, 0) - 1 AS change FROM st WHERE abs(last / nullif(prev, 0) - 1) >= 0.02 AND date_diff('second', prev_ts, ts) BETWEEN 1 AND {DAY}")
def surge(t: Tables) -> DataFrame:
    return tk.surge_candidates(tk.intraday_state(t.ticks), 0.02, DAY).select("event_id", "change")


def cooldown_sql(signals: str, by: str, seconds: int, columns: str, p: str = "") -> str:
    """DuckDB text of the fold: from each signal the first one late enough, followed from the first of each key."""
    hops = ", ".join(f"{p}hop.{c}" for c in by.split(", "))
    return f"{p}sg AS MATERIALIZED ({signals}), {p}tm AS MATERIALIZED (SELECT {by}, ts, min(event_id) AS event_id FROM {p}sg GROUP BY ALL), {p}hop AS MATERIALIZED (SELECT *, min(ts) OVER (PARTITION BY {by} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {p}tm), {p}kept AS (SELECT {by}, min(ts) AS ts FROM {p}tm GROUP BY {by} UNION ALL SELECT {hops}, {p}hop.nxt AS ts FROM {p}kept JOIN {p}hop USING ({by}, ts) WHERE {p}hop.nxt IS NOT NULL) SELECT {columns} FROM {p}kept JOIN {p}tm USING ({by}, ts) JOIN {p}sg USING ({by}, ts, event_id)"


SURGES = f"SELECT code, event_id, ts, last / nullif(prev, 0) - 1 AS change, last > prev AS up FROM st WHERE abs(last / nullif(prev, 0) - 1) >= 0.02 AND date_diff('second', prev_ts, ts) BETWEEN 1 AND {DAY}"


@query("t06_surge_cooldown", f"WITH RECURSIVE {ST}, {cooldown_sql(SURGES, 'code, up', 2 * DAY, 'code, event_id, change')}")
def surge_cooldown(t: Tables) -> DataFrame:
    """Surges of a code and direction, each at least two days after the one before that was kept."""
    s = tk.surge_candidates(tk.intraday_state(t.ticks), 0.02, DAY).select("code", "event_id", "ts", "change", (F.col("last") > F.col("prev")).alias("up"))
    return tk.cooldown(s, 2 * DAY, ("code", "up")).select("code", "event_id", "change")


@query("t07_volume_surge", f"WITH {ST}, b AS (SELECT *, first_value(CASE WHEN delta > 0 THEN delta END IGNORE NULLS) OVER (PARTITION BY code ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS base FROM st) SELECT code, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, event_id) AS rn FROM b WHERE delta >= 3 * base) WHERE rn = 1 GROUP BY code")
def volume_surge(t: Tables) -> DataFrame:
    s = tk.intraday_state(t.ticks)
    b = s.withColumn("base", F.first(F.when(F.col("delta") > 0, F.col("delta")), ignorenulls=True).over(tk.sofar()))
    return tk.once(b, F.col("delta") >= 3 * F.col("base")).select("code", "event_id")


@query("t14_sector_status", "WITH b AS (SELECT ts AS bts, last AS bench FROM ticks WHERE code = (SELECT min(code) FROM ticks)), j AS (SELECT t.code, t.ts, t.event_id, t.last / nullif(b.bench, 0) - 1 AS excess FROM ticks t ASOF LEFT JOIN b ON t.ts >= b.bts), s AS (SELECT *, CASE WHEN excess > 0.3 THEN 'strong' WHEN excess < -0.3 THEN 'weak' ELSE 'neutral' END AS status FROM j), c AS (SELECT *, lag(status) OVER (PARTITION BY code ORDER BY ts, event_id) AS was FROM s) SELECT code, event_id, status FROM c WHERE was IS DISTINCT FROM status")
def sector_status(t: Tables) -> DataFrame:
    low = t.ticks.agg(F.min("code").alias("code"))
    day = lambda c: F.to_date(c)
    b = t.ticks.join(F.broadcast(low), "code").select(F.col("ts").alias("bts"), F.col("last").alias("bench"))
    # the benchmark is one code's ticks: an as-of join on the day keeps groups small, the day's opening value carries over
    span = t.ticks.select(day("ts").alias("d")).distinct()
    carried = span.join(b, F.col("d") > day("bts"), "left").groupBy("d").agg(F.max_by(F.struct("bts", "bench"), "bts").alias("c")).filter("c is not null").select("d", F.col("d").cast("timestamp_ntz").alias("bts"), F.col("c.bench").alias("bench"))
    bench = b.withColumn("d", day("bts")).unionByName(carried).groupBy("d", "bts").agg(F.last("bench").alias("bench"))
    j = asof(t.ticks.withColumn("d", day("ts")), bench, "bts", ["bench"], key="d", date="ts")
    excess = F.try_divide("last", F.nullif("bench", F.lit(0.0))) - 1
    s = j.withColumn("status", F.when(excess > 0.3, "strong").when(excess < -0.3, "weak").otherwise("neutral"))
    return s.withColumn("was", F.lag("status").over(tk.wt())).filter(~F.col("was").eqNullSafe(F.col("status"))).select("code", "event_id", "status")


@query("t17_rerank", f"WITH {ST}, l AS (SELECT code, arg_max(last, {{'a': ts, 'b': event_id}}) AS last, arg_max(vwap, {{'a': ts, 'b': event_id}}) AS vwap, arg_max(first, {{'a': ts, 'b': event_id}}) AS first FROM st GROUP BY code), s AS (SELECT code, last / nullif(first, 0) - 1 AS expected, greatest(least(coalesce(1 - last / vwap, 0), 0.02), -0.02) AS adj FROM l), p AS (SELECT *, row_number() OVER (ORDER BY expected DESC, code) AS pool FROM s WHERE expected > 0.003) SELECT code, expected, adj, row_number() OVER (ORDER BY expected + adj DESC, code) AS place FROM p WHERE pool <= 30")
def rerank(t: Tables) -> DataFrame:
    last = tk.intraday_state(t.ticks).groupBy("code").agg(F.max_by(F.struct("last", "vwap", "first"), F.struct("ts", "event_id")).alias("q"), F.max_by("vwap", F.when(F.col("vwap").isNotNull(), F.struct("ts", "event_id"))).alias("vw")).select("code", "q.last", F.col("vw").alias("vwap"), "q.first")
    s = last.select("code", (F.try_divide("last", F.nullif("first", F.lit(0.0))) - 1).alias("expected"), F.greatest(F.least(F.coalesce(1 - F.try_divide("last", "vwap"), F.lit(0.0)), F.lit(0.02)), F.lit(-0.02)).alias("adj"))
    pool = s.filter("expected > 0.003").orderBy(F.desc("expected"), "code").limit(30)
    return pool.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("expected") + F.col("adj")), "code")))


@query("t18_board", "WITH d AS (SELECT CAST(ts AS DATE) AS day, code, arg_max(last, {'a': ts, 'b': event_id}) AS last FROM ticks GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY last DESC, code) AS n FROM d), b AS (SELECT day, sha256(string_agg(code, ',' ORDER BY n)) AS print FROM r WHERE n <= 3 GROUP BY day), c AS (SELECT *, lag(print) OVER (ORDER BY day) AS was FROM b) SELECT day, print FROM c WHERE was IS DISTINCT FROM print")
def board(t: Tables) -> DataFrame:
    d = t.ticks.groupBy(F.to_date("ts").alias("day"), "code").agg(F.max_by("last", F.struct("ts", "event_id")).alias("last"))
    r = d.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("last"), "code"))).filter("n <= 3")
    b = r.groupBy("day").agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"].cast("string"))), 256).alias("print"))
    c = b.withColumn("was", F.lag("print").over(Window.orderBy("day")))  # one row a day
    return c.filter(~F.col("was").eqNullSafe(F.col("print"))).select("day", "print")


@query("t20_entry_filters", f"WITH {ST} SELECT CASE WHEN prev IS NULL THEN 'no_quote' WHEN last / nullif(prev, 0) - 1 > 0.6 THEN 'gap' WHEN last / vwap - 1 > 0.2 THEN 'rich' WHEN (high - low) / nullif(last, 0) > 0.9 THEN 'spread' ELSE 'ok' END AS reason, count(*) AS n FROM st GROUP BY ALL")
def entry_filters(t: Tables) -> DataFrame:
    s = tk.intraday_state(t.ticks)
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    reason = F.when(F.col("prev").isNull(), "no_quote").when(ratio(F.col("last"), F.col("prev")) - 1 > 0.6, "gap").when(F.try_divide("last", "vwap") - 1 > 0.2, "rich").when(ratio(F.col("high") - F.col("low"), F.col("last")) > 0.9, "spread").otherwise("ok")
    return s.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("t21_sizes", "SELECT event_id, CAST(floor(least(100000 / 5, 15000, 1000 / nullif(abs(last) * 0.02, 0)) / 100) * 100 AS BIGINT) AS shares FROM ticks")
def sizes(t: Tables) -> DataFrame:
    budget = F.least(F.lit(100000 / 5), F.lit(15000.0), F.try_divide(F.lit(1000.0), F.nullif(F.abs("last") * 0.02, F.lit(0.0))))
    return t.ticks.select("event_id", (F.floor(budget / 100) * 100).cast("long").alias("shares"))


@query("t22_exits", f"WITH {ST}, p AS (SELECT code AS pc, arg_min(last, {{'a': ts, 'b': event_id}}) AS buy FROM ticks GROUP BY code), j AS (SELECT *, CASE WHEN last <= 0.5 * buy THEN 'stop_loss' WHEN last >= 1.5 * buy THEN 'take_profit' WHEN last <= 0.6 * high THEN 'trailing_stop' WHEN last < vwap * 0.8 THEN 'vwap_break' END AS reason FROM st JOIN p ON code = pc) SELECT code, event_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, event_id) AS rn FROM j WHERE reason IS NOT NULL) WHERE rn = 1")
def exits(t: Tables) -> DataFrame:
    s = tk.intraday_state(t.ticks)
    reason = F.when(F.col("last") <= 0.5 * F.col("first"), "stop_loss").when(F.col("last") >= 1.5 * F.col("first"), "take_profit").when(F.col("last") <= 0.6 * F.col("high"), "trailing_stop").when(F.col("last") < F.col("vwap") * 0.8, "vwap_break")
    return tk.once(s.withColumn("reason", reason), F.col("reason").isNotNull()).select("code", "event_id", "reason")


@query("t16_reference", "WITH l AS (SELECT code, max(last) - min(last) AS range, count(*) AS n FROM ticks GROUP BY code) SELECT code, range, n, (rank() OVER (ORDER BY range) + (count(*) OVER (PARTITION BY range) - 1) / 2.0::DOUBLE) / count(*) OVER () AS rank_pct FROM l")
def reference(t: Tables) -> DataFrame:
    r = t.ticks.groupBy("code", F.lit(0).alias("all")).agg((F.max("last") - F.min("last")).alias("range"), F.count("*").alias("n"))
    return r.select("code", "range", "n", rank_pct("range", ("all",)).alias("rank_pct"))
