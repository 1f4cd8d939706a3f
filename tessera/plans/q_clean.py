"""Queries of cleaning, validation, projection and predicates (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import clean
from tessera.functions.rolling import wc
from tessera.operators import asof
from tessera.operators.sessions import session_days
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables


@query("p01_numbers", "SELECT o_orderkey, TRY_CAST(trim(replace(replace(replace(s, '%', ''), ',', ''), '--', '')) AS DOUBLE) AS x FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.5%' WHEN 1 THEN '1,' || (o_orderkey % 900 + 100) WHEN 2 THEN '--' ELSE o_orderpriority END AS s FROM orders)")
def numbers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".5%"))).when(k % 4 == 1, F.concat(F.lit("1,"), (k % 900 + 100).cast("string"))).when(k % 4 == 2, "--").otherwise(F.col("o_orderpriority"))
    return t.raw("orders").select("o_orderkey", clean.number(s).alias("x"))


@query("p03_codes", "SELECT c_custkey, CASE WHEN c_custkey >= 100000 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS code FROM customer")
def codes(t: Tables) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("SH"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(k, F.lit(".SZ"))).otherwise(k)
    return t.raw("customer").select("c_custkey", clean.bare_code(text).alias("code"))


@query("p04_boards", """WITH c AS (SELECT l_partkey, lpad(CAST(l_partkey * 337 % 1000000 AS VARCHAR), 6, '0') AS code, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CASE WHEN regexp_matches(code, '^(6|9|5)') THEN 'SH' WHEN regexp_matches(code, '^(0|2|3|1)') THEN 'SZ' WHEN regexp_matches(code, '^(4|8)') THEN 'BJ' ELSE 'OTHER' END AS exchange,
CASE WHEN regexp_matches(code, '^(688|689)') THEN 'STAR' WHEN regexp_matches(code, '^(300|301)') THEN 'GEM' WHEN regexp_matches(code, '^(43|83|87|88|92|4|8)') THEN 'BSE' WHEN code LIKE '6%' THEN 'SH_MAIN' WHEN code LIKE '0%' THEN 'SZ_MAIN' ELSE 'OTHER' END AS board, sum(n)::BIGINT AS n FROM c GROUP BY ALL""")
def boards(t: Tables) -> DataFrame:
    c = F.lpad((F.col("l_partkey") * 337 % 1000000).cast("string"), 6, "0")
    return t.raw("lineitem").groupBy(clean.exchange(c).alias("exchange"), clean.board(c).alias("board")).agg(F.count("*").alias("n"))


@query("p05_invalid_bars", "SELECT code, count(*) FILTER (high < low OR open > high OR close < low OR volume <= 0)::BIGINT AS invalid, (count(*) - count(DISTINCT date))::BIGINT AS doubled FROM bars GROUP BY code")
def invalid_bars(t: Tables) -> DataFrame:
    bad = F.expr("high < low or open > high or close < low or volume <= 0")
    return t.bars.groupBy("code").agg(F.count_if(bad).alias("invalid"), (F.count("*") - F.countDistinct("date")).alias("doubled"))


@query("p06_standard_bars", "SELECT code, date, coalesce(CASE WHEN volume > 40 THEN amount END, 0) AS amount, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS pct_change FROM bars")
def standard_bars(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", F.coalesce(F.when(F.col("volume") > 40, F.col("amount")), F.lit(0.0)).alias("amount"), (F.col("close") / F.lag("close").over(wc()) - 1).alias("pct_change"))


@query("p07_valuation", "SELECT code, ann_date AS date, CASE WHEN value > 100000 THEN ln(value) END AS log_mv FROM reports")
def valuation(t: Tables) -> DataFrame:
    return t.reports.select("code", F.col("ann_date").alias("date"), F.when(F.col("value") > 100000, F.ln("value")).alias("log_mv"))


FACTOR = "f AS (SELECT code, ann_date, 1 + (CAST(floor(value) AS BIGINT) % 7) / 10.0::DOUBLE AS factor FROM reports), latest AS (SELECT code, arg_max(factor, ann_date) AS base FROM f GROUP BY code)"


def _factor(t: Tables) -> DataFrame:
    return t.reports.select("code", "ann_date", (1 + (F.floor("value").cast("long") % 7) / F.lit(10.0)).alias("factor"))


@query("p08_price_adjust", f"WITH {FACTOR} SELECT b.code, b.date, b.close * f.factor / latest.base AS qfq, b.close * f.factor AS hfq FROM bars b ASOF LEFT JOIN f ON b.code = f.code AND b.date >= f.ann_date LEFT JOIN latest ON b.code = latest.code")
def price_adjust(t: Tables) -> DataFrame:
    f = _factor(t)
    base = f.groupBy("code").agg(F.max_by("factor", "ann_date").alias("base"))
    joined = asof.asof(t.bars.select("code", "date", "close"), f, "ann_date", ["factor"]).join(base, "code", "left")
    return joined.select("code", "date", (F.col("close") * F.col("factor") / F.col("base")).alias("qfq"), (F.col("close") * F.col("factor")).alias("hfq"))


@query("p09_unpivot", "SELECT code, date, name, value FROM (SELECT code, date, open, close FROM bars) UNPIVOT (value FOR name IN (open, close))")
def unpivot(t: Tables) -> DataFrame:
    return t.bars.unpivot(["code", "date"], ["open", "close"], "name", "value")


@query("p10_ex_right", f"WITH {FACTOR}, before AS (SELECT code, arg_max(factor, ann_date) AS was FROM f WHERE ann_date < DATE '1997-01-01' GROUP BY code) SELECT code, base AS factor, was IS NULL OR abs(base - was) > 1e-9 * abs(was) AS changed FROM latest LEFT JOIN before USING (code)")
def ex_right(t: Tables) -> DataFrame:
    f = _factor(t)
    early = F.col("ann_date") < F.lit("1997-01-01").cast("date")
    g = f.groupBy("code").agg(F.max_by("factor", "ann_date").alias("factor"), F.max_by("factor", F.when(early, F.col("ann_date"))).alias("was"))
    return g.select("code", "factor", (F.col("was").isNull() | (F.abs(F.col("factor") - F.col("was")) > 1e-9 * F.abs("was"))).alias("changed"))


@query("p11_calendar_check", "SELECT count(*) AS n, count(*) - count(DISTINCT date) AS doubled, count(*) FILTER (date IS NULL) AS missing FROM calendar")
def calendar_check(t: Tables) -> DataFrame:
    return t.calendar.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("date")).alias("doubled"), F.count_if(F.col("date").isNull()).alias("missing"))


@query("p14_status_check", "SELECT code, count(*) AS days, count(*) FILTER (is_suspended) AS suspended FROM status GROUP BY code")
def status_check(t: Tables) -> DataFrame:
    return t.status.groupBy("code").agg(F.count("*").alias("days"), F.count_if("is_suspended").alias("suspended"))


@query("p15_industry_intervals", "SELECT *, lead(valid_from) OVER (PARTITION BY code ORDER BY valid_from) AS valid_to, greatest(valid_from, published) AS available_from FROM industry_log")
def industry_intervals(t: Tables) -> DataFrame:
    return asof.intervals(t.industry_log)


@query("p16_interval_violations", "SELECT code, count(*) FILTER (greatest(valid_from, published) < valid_from) AS early, count(*) FILTER (published > DATE '1998-06-01') AS late FROM industry_log GROUP BY code")
def interval_violations(t: Tables) -> DataFrame:
    log = asof.intervals(t.industry_log)
    return log.groupBy("code").agg(F.count_if(F.col("available_from") < F.col("valid_from")).alias("early"), F.count_if(F.expr("published > date'1998-06-01'")).alias("late"))


@query("p17_spot_bar", "SELECT s.code, coalesce(b.close, 0) AS close, coalesce(b.volume, 0) AS volume, count(b.code) OVER () / count(*) OVER () >= 0.8 AS covered FROM securities s LEFT JOIN (SELECT * FROM bars WHERE date = (SELECT max(date) FROM bars)) b USING (code)")
def spot_bar(t: Tables) -> DataFrame:
    last = t.bars.join(F.broadcast(t.bars.agg(F.max("date").alias("date"))), "date").select("code", "close", "volume")
    both = t.securities.select("code").join(last.withColumn("got", F.lit(1)), "code", "left")
    share = both.agg((F.count("got") / F.count("*") >= 0.8).alias("covered"))
    return both.crossJoin(F.broadcast(share)).select("code", F.coalesce("close", F.lit(0.0)).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), "covered")


@query("p18_report_tag", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ann_date FROM orders")
def report_tag(t: Tables) -> DataFrame:
    o = t.raw("orders")
    first = next(c for c in ("ann_date", "notice_date", "o_orderdate") if c in o.columns)
    return o.select("o_orderkey", F.to_date(first).alias("ann_date"))


@query("p19_stale_codes", "SELECT code, max(date) AS last FROM bars GROUP BY code HAVING max(date) < (SELECT max(date) FROM bars)")
def stale_codes(t: Tables) -> DataFrame:
    from tessera.operators.keyed import freshness

    return freshness(t.bars, t.bars).filter("not fresh").select("code", "last")


@query("p20_update_batches", "SELECT code, date_diff('day', max(date), DATE '1998-12-31') AS gap, CASE WHEN date_diff('day', max(date), DATE '1998-12-31') <= 31 THEN 'batch' ELSE 'full' END AS plan FROM bars GROUP BY code")
def update_batches(t: Tables) -> DataFrame:
    gap = F.datediff(F.lit("1998-12-31").cast("date"), F.max("date"))
    return t.bars.groupBy("code").agg(gap.cast("long").alias("gap"), F.when(gap <= 31, "batch").otherwise("full").alias("plan"))


@query("p21_eligible", "SELECT code, date FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM bars) WHERE n >= 60")
def eligible(t: Tables) -> DataFrame:
    return t.bars.withColumn("n", F.row_number().over(wc())).filter("n >= 60").select("code", "date")


@query("p23_expected_session", "WITH c AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS n FROM calendar WHERE date <= DATE '1997-05-05') SELECT code, max(bars.date) < (SELECT date FROM c WHERE n = 2) AS stale FROM bars WHERE bars.date <= DATE '1997-05-05' GROUP BY code")
def expected_session(t: Tables) -> DataFrame:
    upto = t.calendar.filter("date <= date'1997-05-05'").withColumn("n", F.row_number().over(Window.orderBy(F.desc("date")))).filter("n = 2").select(F.col("date").alias("expected"))
    return t.bars.filter("date <= date'1997-05-05'").groupBy("code").agg(F.max("date").alias("last")).crossJoin(F.broadcast(upto)).select("code", (F.col("last") < F.col("expected")).alias("stale"))


@query("p24_stratified_sample", "SELECT c_custkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey), c_custkey) AS n FROM customer) WHERE n <= 20")
def stratified_sample(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("c_custkey").cast("string")), 256), "c_custkey")
    return t.raw("customer").withColumn("n", F.row_number().over(w)).filter("n <= 20").select("c_custkey", "c_mktsegment", "n")


@query("p25_net_return", "SELECT code, date, (1 + ret) * (1 - 0.001) / (1 + 0.001) - 1 AS net FROM predictions")
def net_return(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", clean.net_return(F.col("ret"), 0.002).alias("net"))


@query("p26_latest_complete_date", "WITH c AS (SELECT date, count(*) AS n FROM bars GROUP BY date), l AS (SELECT * FROM c ORDER BY date DESC LIMIT 20), m AS (SELECT greatest(10, 0.8 * median(n)) AS need FROM l) SELECT coalesce(max(date) FILTER (n >= need), max(date)) AS date FROM l, m")
def latest_complete_date(t: Tables) -> DataFrame:
    last = t.bars.groupBy("date").count().orderBy(F.desc("date")).limit(20)
    need = last.agg(F.greatest(F.lit(10.0), 0.8 * F.median("count")).alias("need"))
    return last.crossJoin(need).agg(F.coalesce(F.max(F.when(F.col("count") >= F.col("need"), F.col("date"))), F.max("date")).alias("date"))


@query("p27_training_mask", "SELECT code, date FROM (SELECT code, date, CASE WHEN volume > 60 THEN FALSE WHEN volume > 20 THEN TRUE END AS mask FROM bars) WHERE mask IS DISTINCT FROM FALSE")
def training_mask(t: Tables) -> DataFrame:
    mask = F.when(F.col("volume") > 60, F.lit(False)).when(F.col("volume") > 20, F.lit(True))
    return t.bars.filter(~mask.eqNullSafe(F.lit(False))).select("code", "date")


@query("p28_time_split", "SELECT CASE WHEN date < DATE '1996-01-01' THEN 'train' WHEN date < DATE '1997-01-01' THEN 'valid' ELSE 'test' END AS part, count(*) AS n FROM bars GROUP BY ALL")
def time_split(t: Tables) -> DataFrame:
    part = F.expr("case when date < date'1996-01-01' then 'train' when date < date'1997-01-01' then 'valid' else 'test' end")
    return t.bars.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("p30_list_hash", "SELECT industry, sha256(string_agg(code, chr(10) ORDER BY code)) AS digest FROM securities GROUP BY industry")
def list_hash(t: Tables) -> DataFrame:
    return t.securities.groupBy("industry").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("code"))), 256).alias("digest"))


@query("p31_holding_days", "WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM calendar), r AS (SELECT code, ann_date FROM reports), p AS (SELECT r.code, r.ann_date, c.ord FROM r ASOF LEFT JOIN c ON r.ann_date >= c.date) SELECT code, ann_date, (SELECT max(ord) FROM c) - coalesce(ord, 0) AS days FROM p")
def holding_days(t: Tables) -> DataFrame:
    """Sessions since each report, by equality with the days of the calendar; reports behind it have none, before it all."""
    days = session_days(t.calendar).select("day", "upto")
    ends = days.agg(F.max("upto").alias("top"), F.max("day").alias("last"))
    at = t.reports.join(days, F.col("ann_date") == F.col("day"), "left").crossJoin(F.broadcast(ends))  # one row
    passed = F.coalesce("upto", F.when(F.col("ann_date") > F.col("last"), F.col("top")).otherwise(0))
    return at.select("code", "ann_date", (F.col("top") - passed).alias("days"))


@query("p33_priority_list", """WITH u AS (SELECT code, 1 AS p, 0 AS s FROM securities WHERE industry = 'R1' UNION ALL SELECT code, 2, 0 FROM securities WHERE industry = 'R2' UNION ALL SELECT code, 3, -max(ridge_pred) FROM predictions GROUP BY code),
d AS (SELECT code, min({'p': p, 's': s}) AS k FROM u GROUP BY code), n AS (SELECT code, k.p AS p, row_number() OVER (ORDER BY k, code) AS n FROM d)
SELECT code, n FROM n WHERE n <= greatest(12, (SELECT count(*) FROM d WHERE k.p = 1))""")
def priority_list(t: Tables) -> DataFrame:
    s = t.securities
    u = s.filter("industry = 'R1'").select("code", F.lit(1).alias("p"), F.lit(0.0).alias("s"))
    u = u.union(s.filter("industry = 'R2'").select("code", F.lit(2), F.lit(0.0))).union(t.predictions.groupBy("code").agg(F.lit(3), -F.max("ridge_pred")))
    d = u.groupBy("code").agg(F.min(F.struct("p", "s")).alias("k"))
    protected = d.agg(F.greatest(F.lit(12), F.count_if(F.col("k.p") == 1)).alias("cap"))
    n = d.withColumn("n", F.row_number().over(Window.orderBy("k", "code")))
    return n.crossJoin(F.broadcast(protected)).filter("n <= cap").select("code", "n")


@query("p35_normal_weights", "WITH w AS (SELECT code, sum(greatest(ridge_pred, 0)) AS a FROM predictions GROUP BY code) SELECT code, a / sum(a) OVER () AS weight FROM w")
def normal_weights(t: Tables) -> DataFrame:
    w = t.predictions.groupBy("code").agg(F.sum(F.greatest("ridge_pred", F.lit(0.0))).alias("a"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("a").alias("total")))).select("code", (F.col("a") / F.col("total")).alias("weight"))
