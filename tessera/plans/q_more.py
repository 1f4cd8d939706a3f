"""Further queries: advice scores, composites, selection, bootstrap, board statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.rolling import change, roll, wc, wd
from tessera.operators import factor_stats as fs
from tessera.operators import portfolio as pf
from tessera.operators import selection as sel
from tessera.plans.q_backtest import PLAIN, PORT, RULES
from tessera.plans.q_news import SCORED, _scored
from tessera.plans.q_series import W, over
from tessera.plans.q_stats import FACTORS
from tessera.plans.q_stream import ST
from tessera.plans.q_xsec import D, rank
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables
from tessera.streaming import ticks as tk

SIG = "CASE WHEN {0} > {1} THEN 1 WHEN {0} < {2} THEN -1 ELSE 0 END"
ADVICE = f"adv AS (SELECT code, date, close, close / ({over('avg', 'close', 5)}) - 1 AS g5, close / ({over('avg', 'close', 20)}) - 1 AS g20, close / lag(close, 5) OVER ({W}) - 1 AS r5, volume / ({over('avg', 'volume', 5)}) - 1 AS v FROM bars), scored_adv AS (SELECT code, date, {' + '.join(SIG.format(*x) for x in (('g5', 0.01, -0.01), ('g20', 0.03, -0.03), ('r5', 0.05, -0.05), ('v', 0.5, -0.5)))} AS score FROM adv)"


def _advice(t: Tables) -> DataFrame:
    x = t.bars.select("code", "date", *((F.try_divide("close", roll(F.avg, "close", n)) - 1).alias(f"g{n}") for n in (5, 20)), change("close", 5).alias("r5"), (F.try_divide("volume", roll(F.avg, "volume", 5)) - 1).alias("v"))
    return x.select("code", "date", sel.sign_score((F.col("g5"), 0.01, -0.01), (F.col("g20"), 0.03, -0.03), (F.col("r5"), 0.05, -0.05), (F.col("v"), 0.5, -0.5)).alias("score"))


@query("w12_rule_score", f"WITH {ADVICE} SELECT code, date, score, score - lag(score, 5) OVER ({W}) AS change FROM scored_adv")
def rule_score(t: Tables) -> DataFrame:
    return _advice(t).select("code", "date", "score", (F.col("score") - F.lag("score", 5).over(wc())).alias("change"))


@query("w38_advice", f"WITH {ADVICE} SELECT code, arg_max(score, date) AS score, CASE WHEN arg_max(score, date) >= 3 THEN 'buy' WHEN arg_max(score, date) >= 1 THEN 'lean_buy' WHEN arg_max(score, date) <= -3 THEN 'sell' WHEN arg_max(score, date) <= -1 THEN 'lean_sell' ELSE 'hold' END AS action FROM scored_adv GROUP BY code")
def advice(t: Tables) -> DataFrame:
    s = F.max_by("score", "date")
    return _advice(t).groupBy("code").agg(s.alias("score"), F.when(s >= 3, "buy").when(s >= 1, "lean_buy").when(s <= -3, "sell").when(s <= -1, "lean_sell").otherwise("hold").alias("action"))


@query("w35_fund_flow", f"WITH x AS (SELECT code, date, sum(coalesce(sign(close - open), 0) * amount) OVER ({W} ROWS 4 PRECEDING) AS flow, sum(amount) OVER ({W} ROWS 4 PRECEDING) AS total FROM bars) SELECT code, date, flow / nullif(total, 0) AS share, CASE WHEN flow / nullif(total, 0) > 0.5 THEN 2 WHEN flow > 0 THEN 1 WHEN flow / nullif(total, 0) < -0.5 THEN -2 WHEN flow < 0 THEN -1 ELSE 0 END AS score FROM x")
def fund_flow(t: Tables) -> DataFrame:
    five = wc().rowsBetween(-4, 0)
    x = t.bars.select("code", "date", F.sum(F.signum(F.col("close") - F.col("open")) * F.col("amount")).over(five).alias("flow"), F.sum("amount").over(five).alias("total"))
    s = F.try_divide("flow", F.nullif("total", F.lit(0.0)))
    return x.select("code", "date", s.alias("share"), F.when(s > 0.5, 2).when(F.col("flow") > 0, 1).when(s < -0.5, -2).when(F.col("flow") < 0, -1).otherwise(0).alias("score"))


@query("w42_sentiment_forward", f"WITH {SCORED}, d AS (SELECT code, day, avg(score) AS s FROM scored GROUP BY ALL), f AS (SELECT code, date, lead(close, 1) OVER ({W}) / close - 1 AS r1, lead(close, 3) OVER ({W}) / close - 1 AS r3 FROM bars) SELECT d.code, d.day, s, r1, r3 FROM d LEFT JOIN f ON d.code = f.code AND d.day = f.date")
def sentiment_forward(t: Tables) -> DataFrame:
    from tessera.functions.rolling import forward

    d = _scored(t).groupBy("code", "day").agg(F.avg("score").alias("s"))
    f = t.bars.select("code", F.col("date").alias("day"), forward("close", 1).alias("r1"), forward("close", 3).alias("r3"))
    return d.join(f, ["code", "day"], "left")


@query("w44_report_score", "WITH r AS (SELECT *, lag(value) OVER (PARTITION BY code ORDER BY ann_date) AS was FROM reports) SELECT code, max(ann_date) AS ann_date, arg_max(CASE WHEN value > 1.5 * was THEN 2 WHEN value > was THEN 1 WHEN value < 0.5 * was THEN -2 WHEN value < was THEN -1 ELSE 0 END, ann_date) AS score FROM r GROUP BY code")
def report_score(t: Tables) -> DataFrame:
    was = F.lag("value").over(Window.partitionBy("code").orderBy("ann_date"))
    r = t.reports.withColumn("was", was)
    v, b = F.col("value"), F.col("was")
    s = F.when(v > 1.5 * b, 2).when(v > b, 1).when(v < 0.5 * b, -2).when(v < b, -1).otherwise(0)
    return r.groupBy("code").agg(F.max("ann_date").alias("ann_date"), F.max_by(s, "ann_date").alias("score"))


@query("x26_screener", f"WITH {ADVICE}, p AS (SELECT code, date, {rank('ridge_pred')} / count(*) OVER ({D}) AS pct FROM predictions) SELECT code, date, score + 6 * (pct - 0.5) AS blended FROM scored_adv JOIN p USING (code, date)")
def screener(t: Tables) -> DataFrame:
    p = t.predictions.select("code", "date", cross.rank_pct("ridge_pred").alias("pct"))
    return _advice(t).join(p, ["code", "date"]).select("code", "date", (F.col("score") + 6 * (F.col("pct") - 0.5)).alias("blended"))


@query("x27_direction", f"WITH {ADVICE}, c AS (SELECT s.code, s.date, (0.6 * greatest(least(score, 2), -2) + 0.4 * rule_score) AS x FROM scored_adv s JOIN predictions USING (code, date)) SELECT code, date, x, CASE WHEN x >= 0.4 THEN 'up' WHEN x <= -0.4 THEN 'down' ELSE 'flat' END AS direction FROM c")
def direction(t: Tables) -> DataFrame:
    j = _advice(t).join(t.predictions.select("code", "date", "rule_score"), ["code", "date"])
    x = cross.blend({"a": 0.6, "rule_score": 0.4})
    j = j.withColumn("a", F.greatest(F.least("score", F.lit(2)), F.lit(-2)).cast("double")).select("code", "date", x.alias("x"))
    return j.withColumn("direction", F.when(F.col("x") >= 0.4, "up").when(F.col("x") <= -0.4, "down").otherwise("flat"))


@query("x29_market_composite", "WITH s AS (SELECT date, industry, avg(close / open - 1) AS x, count(*) AS n FROM bars JOIN securities USING (code) GROUP BY ALL), m AS (SELECT date, sum(x * n) / sum(n) AS score FROM s GROUP BY date) SELECT date, score, CASE WHEN score > 0.01 THEN 'warm' WHEN score < -0.01 THEN 'cold' ELSE 'mild' END AS label FROM m")
def market_composite(t: Tables) -> DataFrame:
    s = t.bars.join(t.securities, "code").groupBy("date", "industry").agg(F.avg(F.col("close") / F.col("open") - 1).alias("x"), F.count("*").alias("n"))
    m = s.groupBy("date").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("score"))
    return m.withColumn("label", F.when(F.col("score") > 0.01, "warm").when(F.col("score") < -0.01, "cold").otherwise("mild"))


@query("x31_daily_record", f"WITH {ADVICE}, {SCORED}, n AS (SELECT code, day AS date, avg(score) AS news FROM scored GROUP BY ALL) SELECT a.code, a.date, a.score AS technical, n.news, p.ridge_pred AS quant FROM scored_adv a LEFT JOIN n USING (code, date) LEFT JOIN predictions p USING (code, date) WHERE a.date >= DATE '1997-01-01'")
def daily_record(t: Tables) -> DataFrame:
    n = _scored(t).groupBy("code", F.col("day").alias("date")).agg(F.avg("score").alias("news"))
    p = t.predictions.select("code", "date", F.col("ridge_pred").alias("quant"))
    history = _advice(t).filter("date < date'1997-01-01'").select("code", "date")
    return _advice(t).withColumnRenamed("score", "technical").join(history, ["code", "date"], "left_anti").join(n, ["code", "date"], "left").join(p, ["code", "date"], "left")


@query("x07_ridge_neutral_labels")
def ridge_neutral_labels(t: Tables) -> DataFrame:
    return sel.ridge_neutral(t.predictions.join(t.securities, "code"), "ret", "vol", "industry", least=5)


@query("a08_decorrelated_factors")
def decorrelated_factors(t: Tables) -> DataFrame:
    ic = fs.daily_ic(t.predictions, FACTORS, "ret")
    kept = sel.decorrelated(ic, 3, 0.6)
    return fs.ic_summary(ic.filter(F.col("factor").isin(kept)))


@query("b14_bootstrap")
def bootstrap(t: Tables) -> DataFrame:
    """Share of circular block bootstrap means at or under zero, of the daily difference between two portfolios."""
    a, b = pf.portfolio(t.predictions, rules=RULES), pf.portfolio(t.predictions, "lgbm_pred")
    d = a.select("date", F.col("net").alias("x")).join(b.select("date", F.col("net").alias("y")), "date").select("date", (F.col("x") - F.col("y")).alias("d"))
    return sel.block_bootstrap(d, "d", 400, 20, 7).agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p_value"), F.count("*").alias("draws"))


_SHARPE = "avg(net) / nullif(stddev_samp(net), 0)"


@query("b17_promotion", f"WITH {PORT}, {PLAIN}, c AS (SELECT strftime(date, '%Y') AS year, {_SHARPE} AS b FROM port GROUP BY ALL), p AS (SELECT strftime(date, '%Y') AS year, {_SHARPE} AS a FROM plain GROUP BY ALL), y AS (SELECT round(b - a, 9) AS d FROM c JOIN p USING (year)) SELECT avg(d) AS gain, count(*) FILTER (d > 0) AS improved, avg(d) > 0.1 AND count(*) FILTER (d > 0) >= 2 AS promote FROM y")
def promotion(t: Tables) -> DataFrame:
    """Whether the filtered portfolio gains Sharpe on the same without filters, on average over the years and in two at least."""
    sharpe = F.try_divide(F.avg("net"), F.nullif(F.stddev_samp("net"), F.lit(0.0)))
    yearly = lambda rules, name: pf.portfolio(t.predictions, rules=rules).groupBy(F.date_format("date", "yyyy").alias("year")).agg(sharpe.alias(name))
    y = yearly(RULES, "b").join(yearly((), "a"), "year").select(F.round(F.col("b") - F.col("a"), 9).alias("d"))
    gain, n = F.avg("d"), F.count_if(F.col("d") > 0)
    return y.agg(gain.alias("gain"), n.alias("improved"), ((gain > 0.1) & (n >= 2)).alias("promote"))


@query("b20_confidence_gate", f"WITH c AS (SELECT *, 1 - abs({rank('ridge_pred')} / count(*) OVER ({D}) - {rank('lgbm_pred')} / count(*) OVER ({D})) AS conf FROM predictions), q AS (SELECT *, quantile_cont(conf, 0.5) OVER ({D}) AS cut FROM c) SELECT date, avg(ret) FILTER (conf >= cut) AS gated, avg(ret) AS plain FROM q GROUP BY date")
def confidence_gate(t: Tables) -> DataFrame:
    c = t.predictions.withColumn("conf", 1 - F.abs(cross.rank_pct("ridge_pred") - cross.rank_pct("lgbm_pred")))
    q = c.withColumn("cut", F.percentile("conf", 0.5).over(wd()))
    return q.groupBy("date").agg(F.avg(F.when(F.col("conf") >= F.col("cut"), F.col("ret"))).alias("gated"), F.avg("ret").alias("plain"))


@query("b30_composite_backtest", f"WITH {ADVICE}, f AS (SELECT code, date, score, lead(close, 3) OVER ({W}) / close - 1 AS r FROM scored_adv JOIN bars USING (code, date)) SELECT sign(score)::INTEGER AS side, count(*) AS n, avg((r * sign(score) > 0)::DOUBLE) AS hit FROM f WHERE abs(score) >= 2 GROUP BY ALL")
def composite_backtest(t: Tables) -> DataFrame:
    from tessera.functions.rolling import forward

    f = t.bars.select("code", "date", forward("close", 3).alias("r")).join(_advice(t), ["code", "date"]).filter("abs(score) >= 2")
    side = F.signum(F.col("score").cast("double"))
    return f.groupBy(side.cast("int").alias("side")).agg(F.count("*").alias("n"), F.avg((F.col("r") * side > 0).cast("double")).alias("hit"))


@query("n16_watchlist_sentiment", f"WITH {SCORED}, d AS (SELECT code, day AS date, sum(score) AS s FROM scored GROUP BY ALL) SELECT p.code, p.date, coalesce(d.s, 0) AS sentiment FROM predictions p SEMI JOIN (SELECT code FROM securities WHERE industry IN ('R1', 'R3')) w USING (code) LEFT JOIN d ON p.code = d.code AND p.date = d.date")
def watchlist_sentiment(t: Tables) -> DataFrame:
    d = _scored(t).groupBy("code", F.col("day").alias("date")).agg(F.sum("score").alias("s"))
    p = t.predictions.select("code", "date").join(t.securities.filter("industry in ('R1', 'R3')").select("code"), "code", "left_semi")
    return p.join(d, ["code", "date"], "left").select("code", "date", F.coalesce("s", F.lit(0.0)).alias("sentiment"))


@query("n22_snapshot_fields", f"WITH {SCORED} SELECT code, day, count(*) AS n, count(*) FILTER (score > 0) AS good, count(*) FILTER (score < 0) AS bad, string_agg(DISTINCT category, ',' ORDER BY category) AS tags FROM scored GROUP BY ALL")
def snapshot_fields(t: Tables) -> DataFrame:
    return _scored(t).groupBy("code", "day").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("good"), F.count_if(F.col("score") < 0).alias("bad"), F.concat_ws(",", F.array_sort(F.collect_set("category"))).alias("tags"))


@query("t15_status_counts", f"WITH {ST} SELECT CAST(ts AS DATE) AS day, CASE WHEN last > 1.2 * first THEN 'strong' WHEN last < 0.8 * first THEN 'weak' ELSE 'neutral' END AS status, count(*) AS n FROM st GROUP BY ALL")
def status_counts(t: Tables) -> DataFrame:
    s = tk.intraday_state(t.ticks)
    status = F.when(F.col("last") > 1.2 * F.col("first"), "strong").when(F.col("last") < 0.8 * F.col("first"), "weak").otherwise("neutral")
    return s.groupBy(F.to_date("ts").alias("day"), status.alias("status")).agg(F.count("*").alias("n"))


@query("t19_position_advice", f"WITH {ST}, l AS (SELECT code, arg_max(last, {{'a': ts, 'b': event_id}}) AS last, arg_max(first, {{'a': ts, 'b': event_id}}) AS first, count(*) AS n FROM st GROUP BY code) SELECT code, last / nullif(first, 0) - 1 AS pnl, CASE WHEN last < 0.7 * first THEN 'cut' WHEN last > 1.5 * first THEN 'trim' ELSE 'hold' END AS action, CAST(ceil(n * 7 / 100.0) * 100 AS BIGINT) AS trim_shares FROM l")
def position_advice(t: Tables) -> DataFrame:
    q = tk.intraday_state(t.ticks).groupBy("code").agg(F.max_by(F.struct("last", "first"), F.struct("ts", "event_id")).alias("q"), F.count("*").alias("n")).select("code", "q.*", "n")
    action = F.when(F.col("last") < 0.7 * F.col("first"), "cut").when(F.col("last") > 1.5 * F.col("first"), "trim").otherwise("hold")
    return q.select("code", (F.try_divide("last", F.nullif("first", F.lit(0.0))) - 1).alias("pnl"), action.alias("action"), (F.ceil(F.col("n") * 7 / F.lit(100.0)) * 100).cast("long").alias("trim_shares"))


@query("t23_funnel", f"WITH {ST}, r AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN prev IS NULL THEN 'no_quote' WHEN last > prev * 1.5 THEN 'chased' WHEN last < prev THEN 'falling' ELSE 'bought' END AS status FROM st) SELECT day, count(*) FILTER (status = 'bought') AS bought, count(*) FILTER (status <> 'bought') AS filtered, CASE WHEN count(*) FILTER (status = 'bought') > 0 THEN 'traded' ELSE 'idle' END AS run FROM r GROUP BY day")
def funnel(t: Tables) -> DataFrame:
    s = tk.intraday_state(t.ticks)
    status = F.when(F.col("prev").isNull(), "no_quote").when(F.col("last") > F.col("prev") * 1.5, "chased").when(F.col("last") < F.col("prev"), "falling").otherwise("bought")
    r = s.select(F.to_date("ts").alias("day"), status.alias("status"))
    bought = F.count_if(F.col("status") == "bought")
    return r.groupBy("day").agg(bought.alias("bought"), F.count_if(F.col("status") != "bought").alias("filtered"), F.when(bought > 0, "traded").otherwise("idle").alias("run"))


@query("p22_leak_guard", "SELECT date, count(ridge_pred) AS ridge_pred, count(lgbm_pred) AS lgbm_pred, count(rule_score) AS rule_score, count(vol) AS vol FROM predictions GROUP BY date")
def leak_guard(t: Tables) -> DataFrame:
    """Numeric feature columns by the schema; names that tell the future are refused before any fit."""
    p = t.predictions
    names = [f.name for f in p.schema if f.dataType.simpleString() == "double" and not f.name.startswith(("ret", "target_", "label", "future_"))]
    return p.groupBy("date").agg(*(F.count(c).alias(c) for c in names))


@query("p32_claims", "SELECT code, date, CASE WHEN close = high THEN 'closed at limit-up' ELSE 'closed at move' END AS claim FROM bars")
def claims(t: Tables) -> DataFrame:
    text = F.lit("closed at limit-up")
    return t.bars.select("code", "date", F.when(F.col("close") == F.col("high"), text).otherwise(F.regexp_replace(text, "limit-(up|down)", "move")).alias("claim"))
