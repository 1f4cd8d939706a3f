"""Queries of aggregations and factor statistics (A), and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.cross import correlation
from tessera.functions.rolling import change, forward, wd
from tessera.operators import factor_stats as fs
from tessera.plans.q_series import W
from tessera.plans.q_xsec import D, rank
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

FACTORS = ["ridge_pred", "lgbm_pred", "rule_score", "vol"]


def ic_sql(source: str, label: str) -> str:
    by = "date, factor"
    return f"SELECT date, factor, corr(a, b) AS ic FROM (SELECT date, factor, value, y, {rank('value', by)} AS a, {rank('y', by)} AS b FROM (SELECT date, code, factor, value, {label} AS y FROM {source}) WHERE value IS NOT NULL AND y IS NOT NULL) GROUP BY date, factor HAVING count(*) >= 5 AND count(DISTINCT value) >= 3 AND count(DISTINCT y) >= 3"


LONG = "long AS (SELECT * FROM (SELECT code, date, ret, ridge_pred, lgbm_pred, rule_score, vol FROM predictions) UNPIVOT (value FOR factor IN (ridge_pred, lgbm_pred, rule_score, vol)))"
IC = f"{LONG}, ic AS ({ic_sql('long', 'ret')})"


@query("entry_rank_ic", f"WITH m AS (SELECT code, date, 'ret_5d' AS factor, close / lag(close, 5) OVER ({W}) - 1 AS value, lead(close, 1) OVER ({W}) / close - 1 AS nxt FROM bars) {ic_sql('m', 'nxt')}")
def entry_rank_ic(t: Tables) -> DataFrame:
    x = t.bars.select("code", "date", change("close", 5).alias("ret_5d"), forward("close", 1).alias("nxt"))
    return fs.daily_ic(x, ["ret_5d"], "nxt")


@query("a01_event_counts", "SELECT code, ann_date AS date, count(*) AS n FROM reports GROUP BY ALL")
def event_counts(t: Tables) -> DataFrame:
    return t.reports.groupBy("code", F.col("ann_date").alias("date")).agg(F.count("*").alias("n"))


@query("a02_daily_ic", f"WITH {IC} SELECT * FROM ic")
def daily_ic(t: Tables) -> DataFrame:
    return fs.daily_ic(t.predictions, FACTORS, "ret")


@query("a03_ic_summary", f"WITH {IC} SELECT factor, avg(ic) AS mean, stddev_samp(ic) AS std, count(ic) AS n, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg((ic > 1e-9)::DOUBLE) AS win_rate, avg(abs(ic)) AS abs_mean FROM ic GROUP BY factor")
def ic_summary(t: Tables) -> DataFrame:
    return fs.ic_summary(fs.daily_ic(t.predictions, FACTORS, "ret"))


LAYERS = "e AS (SELECT date, list_distinct(list_sort(quantile_cont(ridge_pred, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e, count(*) AS n, count(DISTINCT ridge_pred) AS u FROM predictions GROUP BY date), l AS (SELECT p.date, greatest(len(list_filter(e, lambda v: v < ridge_pred)) - 1, 0) AS layer, ret FROM predictions p JOIN e USING (date) WHERE n >= 15 AND u >= 5), layers AS (SELECT date, CAST(layer AS INTEGER) AS layer, avg(ret) AS mean FROM l GROUP BY ALL)"


@query("a04_layers", f"WITH {LAYERS} SELECT * FROM layers")
def layers(t: Tables) -> DataFrame:
    return fs.layer_returns(t.predictions, "ridge_pred", "ret", 5)


@query("a05_layer_summary", f"WITH {LAYERS}, x AS (SELECT date, arg_max(mean, layer) AS top, arg_min(mean, layer) AS bottom FROM layers GROUP BY date) SELECT avg(top) AS top, avg(bottom) AS bottom, avg(top - bottom) AS long_short FROM x")
def layer_summary(t: Tables) -> DataFrame:
    return fs.layer_summary(fs.layer_returns(t.predictions, "ridge_pred", "ret", 5))


@query("a06_ic_decay", "WITH " + ", ".join(f"m{h} AS (SELECT code, date, 'h{h}' AS factor, close / lag(close, 5) OVER ({W}) - 1 AS value, lead(close, {h}) OVER ({W}) / close - 1 AS y FROM bars), i{h} AS ({ic_sql(f'm{h}', 'y')})" for h in (1, 3, 5, 10, 20)) + " SELECT factor AS horizon, avg(ic) AS mean, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM i{h}" for h in (1, 3, 5, 10, 20)) + ") GROUP BY factor")
def ic_decay(t: Tables) -> DataFrame:

    x = t.bars.select("code", "date", change("close", 5).alias("f"), *(forward("close", h).alias(f"h{h}") for h in (1, 3, 5, 10, 20)))
    long = x.unpivot(["code", "date", "f"], [f"h{h}" for h in (1, 3, 5, 10, 20)], "horizon", "y").dropna()
    by = ("date", "horizon")
    r = long.select(*by, "f", "y", cross.avg_rank("f", by).alias("a"), cross.avg_rank("y", by).alias("b"))
    g = r.groupBy(*by).agg(correlation("a", "b").alias("ic"), F.count("*").alias("n"), F.countDistinct("f").alias("u"), F.countDistinct("y").alias("v")).filter("n >= 5 and u >= 3 and v >= 3")
    return g.groupBy("horizon").agg(F.avg("ic").alias("mean"), F.count("*").alias("n"))


@query("a07_factor_selection", f"WITH {IC}, s AS (SELECT factor, avg(ic) AS mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM ic GROUP BY factor) SELECT factor, mean, icir FROM s ORDER BY abs(mean) DESC, factor LIMIT 2")
def factor_selection(t: Tables) -> DataFrame:
    s = fs.ic_summary(fs.daily_ic(t.predictions, FACTORS, "ret"))
    return s.orderBy(F.desc(F.abs("mean")), "factor").limit(2).select("factor", "mean", "icir")


@query("a09_ic_weights", f"WITH {IC}, d AS (SELECT *, pow(0.5, date_diff('day', date, max(date) OVER ()) / 250.0) AS w FROM ic), s AS (SELECT factor, sum(w * ic) / sum(w) / nullif(stddev_samp(ic), 0) AS raw FROM d GROUP BY factor) SELECT factor, raw / sum(abs(raw)) OVER () AS weight FROM s")
def ic_weights(t: Tables) -> DataFrame:
    ic = fs.daily_ic(t.predictions, FACTORS, "ret")
    last = ic.agg(F.max("date").alias("top"))
    w = F.pow(F.lit(0.5), F.datediff("top", "date") / 250.0)
    s = ic.crossJoin(F.broadcast(last)).withColumn("w", w).groupBy("factor").agg((F.sum(F.col("w") * F.col("ic")) / F.sum("w") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("raw"))
    return s.crossJoin(F.broadcast(s.agg(F.sum(F.abs("raw")).alias("total")))).select("factor", (F.col("raw") / F.col("total")).alias("weight"))


@query("a10_regression_metrics", f"WITH r AS (SELECT *, {rank('ridge_pred')} AS a, {rank('ret')} AS b, quantile_cont(ridge_pred, 0.8) OVER ({D}) AS cut FROM predictions) SELECT date, corr(a, b) AS rank_ic, avg(pow(ridge_pred - ret, 2)) AS mse, avg(ret) FILTER (ridge_pred >= cut) AS top_mean FROM r GROUP BY date HAVING count(*) >= 5")
def regression_metrics(t: Tables) -> DataFrame:
    r = t.predictions.select("date", "ridge_pred", "ret", cross.avg_rank("ridge_pred").alias("a"), cross.avg_rank("ret").alias("b"), F.percentile("ridge_pred", 0.8).over(wd()).alias("cut"))
    g = r.groupBy("date").agg(correlation("a", "b").alias("rank_ic"), F.avg(F.pow(F.col("ridge_pred") - F.col("ret"), 2)).alias("mse"), F.avg(F.when(F.col("ridge_pred") >= F.col("cut"), F.col("ret"))).alias("top_mean"), F.count("*").alias("n"))
    return g.filter("n >= 5").drop("n")


@query("a11_auc", f"WITH m AS (SELECT strftime(date, '%Y-%m') AS month, ridge_pred, (ret > 0)::INTEGER AS y FROM predictions), r AS (SELECT month, y, {rank('ridge_pred', 'month')} AS r FROM m) SELECT month, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM r GROUP BY month")
def auc(t: Tables) -> DataFrame:
    m = t.predictions.select(F.date_format("date", "yyyy-MM").alias("month"), "ridge_pred", (F.col("ret") > 0).cast("int").alias("y"))
    return fs.auc(m, "ridge_pred", "y", "month")


@query("a12_decay_weights", "WITH w AS (SELECT code, date, greatest(pow(0.5, date_diff('day', date, max(date) OVER ()) / 365.0), 0.2) AS w FROM predictions) SELECT code, date, w / avg(w) OVER () AS weight FROM w")
def decay_weights(t: Tables) -> DataFrame:
    p = t.predictions.select("code", "date")
    w = p.crossJoin(F.broadcast(p.agg(F.max("date").alias("top")))).select("code", "date", F.greatest(F.pow(F.lit(0.5), F.datediff("top", "date") / 365.0), F.lit(0.2)).alias("w"))
    return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean")))).select("code", "date", (F.col("w") / F.col("mean")).alias("weight"))


@query("a13_quantiles", "SELECT code, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.95) AS q95 FROM predictions GROUP BY code")
def quantiles(t: Tables) -> DataFrame:
    q = t.predictions.groupBy("code").agg(F.percentile("ret", [0.05, 0.5, 0.95]).alias("q"))
    return q.select("code", *(F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q50", "q95"))))


@query("a15_breadth", f"WITH r AS (SELECT date, close / lag(close) OVER ({W}) - 1 AS r FROM bars) SELECT date, median(r) AS median, avg((r > 0)::DOUBLE) AS up_share, count(r) AS n FROM r WHERE r IS NOT NULL GROUP BY date")
def breadth(t: Tables) -> DataFrame:
    r = t.bars.select("date", change("close", 1).alias("r")).filter("r is not null")
    return r.groupBy("date").agg(F.median("r").alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("up_share"), F.count("r").alias("n"))


@query("a16_member_lists", "WITH n AS (SELECT industry, count(*) AS n FROM securities GROUP BY industry) SELECT n.n, string_agg(code, ',' ORDER BY industry, code) AS codes FROM securities JOIN n USING (industry) GROUP BY n.n")
def member_lists(t: Tables) -> DataFrame:
    s = t.securities
    n = s.groupBy("industry").agg(F.count("*").alias("n"))
    pair = F.array_sort(F.collect_list(F.struct("industry", "code")))
    return s.join(n, "industry").groupBy("n").agg(F.concat_ws(",", F.transform(pair, lambda p: p["code"])).alias("codes"))


@query("a17_calibration", f"WITH q AS (SELECT quantile_cont(ridge_pred, [0.2, 0.4, 0.6, 0.8]) AS e FROM predictions), b AS (SELECT CAST(len(list_filter(e, lambda v: v < ridge_pred)) AS INTEGER) AS bin, ret FROM predictions, q), g AS (SELECT bin, avg(ret) AS mean, avg((ret > 0)::DOUBLE) AS win, count(*) AS n FROM b GROUP BY bin) SELECT bin, mean, win, n, max(mean) OVER (ORDER BY bin) AS monotone FROM g")
def calibration(t: Tables) -> DataFrame:
    p = t.predictions.select("ridge_pred", "ret")
    edges = p.agg(F.percentile("ridge_pred", [0.2, 0.4, 0.6, 0.8]).alias("e"))
    b = p.crossJoin(F.broadcast(edges)).select(F.size(F.filter("e", lambda v: v < F.col("ridge_pred"))).alias("bin"), "ret")
    g = b.groupBy("bin").agg(F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("win"), F.count("*").alias("n"))
    return g.withColumn("monotone", F.max("mean").over(Window.orderBy("bin")))


@query("a18_deciles", f"WITH r AS (SELECT ret, row_number() OVER ({D} ORDER BY ridge_pred, code) AS rn, count(*) OVER ({D}) AS n FROM predictions) SELECT CAST(greatest(ceil((rn - 1) * 10 / (n - 1)) - 1, 0) AS INTEGER) AS decile, avg(ret) AS mean, count(*) AS n FROM r WHERE n > 1 GROUP BY ALL")
def deciles(t: Tables) -> DataFrame:
    x = t.predictions.select(cross.quantile_bucket("ridge_pred", 10).alias("decile"), "ret").filter("decile is not null")
    return x.groupBy("decile").agg(F.avg("ret").alias("mean"), F.count("*").alias("n"))


@query("a19_leg_correlation", f"WITH r AS (SELECT date, {rank('ridge_pred')} AS a, {rank('lgbm_pred')} AS b, {rank('vol')} AS c FROM predictions) SELECT corr(a, b) AS ridge_lgbm, corr(a, c) AS ridge_vol, corr(b, c) AS lgbm_vol FROM r")
def leg_correlation(t: Tables) -> DataFrame:
    r = t.predictions.select(cross.avg_rank("ridge_pred").alias("a"), cross.avg_rank("lgbm_pred").alias("b"), cross.avg_rank("vol").alias("c"))
    return r.agg(correlation("a", "b").alias("ridge_lgbm"), correlation("a", "c").alias("ridge_vol"), correlation("b", "c").alias("lgbm_vol"))


@query("a20_concentration", "WITH c AS (SELECT code, abs(sum(ret)) AS c FROM predictions GROUP BY code), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, code) AS n FROM c) SELECT sum(c) FILTER (n = 1) / sum(c) AS top1, sum(c) FILTER (n <= 3) / sum(c) AS top3 FROM r")
def concentration(t: Tables) -> DataFrame:
    c = t.predictions.groupBy("code").agg(F.abs(F.sum("ret")).alias("c"))
    r = c.withColumn("n", F.row_number().over(Window.orderBy(F.desc("c"), "code")))
    return r.agg(*((F.sum(F.when(F.col("n") <= k, F.col("c"))) / F.sum("c")).alias(f"top{k}") for k in (1, 3)))


@query("a21_pick_overlap", f"WITH p AS (SELECT date, code, row_number() OVER ({D} ORDER BY ridge_pred DESC, code) <= 5 AS a, row_number() OVER ({D} ORDER BY lgbm_pred DESC, code) <= 5 AS b FROM predictions) SELECT date, count(*) FILTER (a AND b) / count(*) FILTER (a OR b) AS jaccard FROM p GROUP BY date")
def pick_overlap(t: Tables) -> DataFrame:
    p = t.predictions.select("date", *((F.row_number().over(wd().orderBy(F.desc(c), "code")) <= 5).alias(n) for n, c in (("a", "ridge_pred"), ("b", "lgbm_pred"))))
    return p.groupBy("date").agg((F.count_if(F.col("a") & F.col("b")) / F.count_if(F.col("a") | F.col("b"))).alias("jaccard"))


@query("a22_contribution", f"WITH h AS (SELECT *, CASE WHEN row_number() OVER ({D} ORDER BY ridge_pred DESC, code) <= 5 THEN 0.2 ELSE 0 END AS w FROM predictions) SELECT industry, strftime(date, '%Y-%m') AS month, sum(w * ret) AS contribution FROM h JOIN securities USING (code) GROUP BY ALL")
def contribution(t: Tables) -> DataFrame:
    w = F.when(F.row_number().over(wd().orderBy(F.desc("ridge_pred"), "code")) <= 5, 0.2).otherwise(0.0)
    h = t.predictions.withColumn("w", w).join(t.securities, "code")
    return h.groupBy("industry", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(F.col("w") * F.col("ret")).alias("contribution"))
