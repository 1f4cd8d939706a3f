"""Queries of portfolios, grids and gates (B, L03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rolling import change, forward, wc
from tessera.operators import portfolio as pf
from tessera.plans.q_series import W
from tessera.plans.q_xsec import D
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

RULES = [("vol", 0.9, False), ("lgbm_pred", 0.1, True)]
L03 = f"f1 AS (SELECT *, quantile_cont(vol, 0.9) OVER ({D}) AS c, count(vol) OVER ({D}) AS n FROM predictions), f2 AS (SELECT * EXCLUDE (c, n), quantile_cont(lgbm_pred, 0.1) OVER ({D}) AS c, count(*) OVER ({D}) AS n FROM f1 WHERE n < 5 OR vol <= c), alive AS (SELECT * EXCLUDE (c, n) FROM f2 WHERE n < 5 OR lgbm_pred >= c)"
PICK = f"pick AS (SELECT *, least(1.0 / count(*) OVER ({D}), 0.15) AS weight FROM (SELECT *, row_number() OVER ({D} ORDER BY ridge_pred DESC, code) AS rn FROM alive) WHERE rn <= 5)"
TURN = "days AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM pick)), a AS (SELECT k, code, weight FROM pick JOIN days USING (date)), b AS (SELECT k + 1 AS k, code, weight AS before FROM a), chg AS (SELECT date, coalesce(weight, 0) AS w, coalesce(before, 0) AS v FROM a FULL JOIN b USING (k, code) JOIN days USING (k)), turn AS (SELECT date, (sum(abs(w - v)) + abs(sum(v) - sum(w))) / 2 AS turnover FROM chg GROUP BY date)"
PORT = f"{L03}, {PICK}, {TURN}, gross AS (SELECT date, sum(weight * ret) / 3 AS gross FROM pick GROUP BY date), port AS (SELECT date, gross, turnover, greatest(gross - turnover * 0.002, -0.99) AS net FROM gross JOIN turn USING (date))"
#: The same portfolio without filters, as one expression of its own.
PLAIN = "plain AS (WITH pick AS (" + PORT.partition("), pick AS (")[2].replace("FROM alive", "FROM predictions") + " SELECT * FROM port)"



def metrics_sql(source: str, by: str = "", compounded: bool = False) -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    annual, vol = "exp(sum(ln(1 + net)) * 252 / count(*)) - 1", "stddev_samp(net) * sqrt(252)"
    return f"SELECT {lead}count(*) AS n, {annual} AS annual, {vol} AS vol, ({annual if compounded else 'avg(net) * 252'}) / nullif({vol}, 0) AS sharpe, min(dd) AS max_dd, avg((net > 0)::DOUBLE) AS win_rate FROM (SELECT *, nav / greatest(max(nav) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + net)) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM {source})){group}"


@query("l03_quantile_filters", f"WITH {L03} SELECT code, date, ridge_pred FROM alive")
def quantile_filters(t: Tables) -> DataFrame:
    return pf.quantile_filters(t.predictions, RULES).select("code", "date", "ridge_pred")


@query("b01_portfolio", f"WITH {PORT} SELECT date, gross, turnover, net, exp(sum(ln(1 + net)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM port")
def portfolio(t: Tables) -> DataFrame:
    return pf.portfolio(t.predictions, rules=RULES)


@query("b02_turnover", f"WITH {L03}, {PICK}, {TURN} SELECT * FROM turn")
def turnover(t: Tables) -> DataFrame:
    return pf.turnover(pf.top_weights(pf.quantile_filters(t.predictions, RULES), "ridge_pred", 5, 0.15))


@query("b03_metrics", f"WITH {PORT} {metrics_sql('port')}")
def metrics(t: Tables) -> DataFrame:
    return pf.return_metrics(pf.portfolio(t.predictions, rules=RULES))


@query("b04_compounded_metrics", f"WITH {PORT} {metrics_sql('port', compounded=True)}")
def compounded_metrics(t: Tables) -> DataFrame:
    return pf.return_metrics(pf.portfolio(t.predictions, rules=RULES), compounded=True)


@query("b07_purge", "SELECT code, date FROM (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM bars WHERE date < DATE '1997-01-01') WHERE n = 4")
def purge(t: Tables) -> DataFrame:
    """The last date of each code whose three-row label ends before a boundary."""
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    return t.bars.filter("date < date'1997-01-01'").withColumn("n", F.row_number().over(w)).filter("n = 4").select("code", "date")


@query("b08_purge_spans", "SELECT strftime(date, '%Y') AS year, h, CASE WHEN h >= 10 THEN 3 WHEN h >= 3 THEN 2 ELSE 1 END AS valid_months, h + 2 AS tradable_span, h + 1 AS open_span, count(*) AS n FROM bars, (SELECT unnest([1, 3, 10]) AS h) GROUP BY ALL")
def purge_spans(t: Tables) -> DataFrame:
    h = t.bars.select(F.date_format("date", "yyyy").alias("year"), F.explode(F.array(*map(F.lit, (1, 3, 10)))).alias("h"))
    months = F.when(F.col("h") >= 10, 3).when(F.col("h") >= 3, 2).otherwise(1)
    return h.groupBy("year", "h", months.alias("valid_months"), (F.col("h") + 2).alias("tradable_span"), (F.col("h") + 1).alias("open_span")).agg(F.count("*").alias("n"))


GRID = "params AS (SELECT row_number() OVER (ORDER BY top_n, a, b) AS param_id, top_n, a AS w_ridge_pred, b AS w_lgbm_pred FROM (SELECT unnest([3, 5]) AS top_n), (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE]) AS a), (SELECT unnest([0.1::DOUBLE, 0.6::DOUBLE, 1.1::DOUBLE]) AS b))"
RUN = f"{GRID}, s AS (SELECT param_id, date, code, ret, top_n, w_ridge_pred * ridge_pred + w_lgbm_pred * lgbm_pred AS score FROM predictions, params), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY param_id, date ORDER BY score DESC, code) AS rn FROM s) WHERE rn <= top_n), w AS (SELECT param_id, date, code, ret, least(1.0 / count(*) OVER (PARTITION BY param_id, date), 0.15) AS weight FROM p), d AS (SELECT param_id, date, row_number() OVER (PARTITION BY param_id ORDER BY date) AS k FROM (SELECT DISTINCT param_id, date FROM w)), a AS (SELECT w.param_id, k, code, weight, ret FROM w JOIN d USING (param_id, date)), b AS (SELECT param_id, k + 1 AS k, code, weight AS before FROM a), c AS (SELECT param_id, k, coalesce(weight, 0) AS x, coalesce(before, 0) AS y, coalesce(ret, 0) AS r FROM a FULL JOIN b USING (param_id, k, code)), grid AS (SELECT d.param_id, d.date, sum(x * r) - 0.002 * (sum(abs(x - y)) + abs(sum(x) - sum(y))) / 2 AS net FROM c JOIN d USING (param_id, k) GROUP BY ALL)"


def _params(t: Tables) -> DataFrame:
    part = lambda name, values: t.spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    p = part("top_n", (3, 5)).crossJoin(part("w_ridge_pred", (0.5, 1.0))).crossJoin(part("w_lgbm_pred", (0.1, 0.6, 1.1)))
    return p.withColumn("param_id", F.row_number().over(Window.orderBy("top_n", "w_ridge_pred", "w_lgbm_pred")))


@query("b11_grid", f"WITH {RUN} {metrics_sql('grid', 'param_id', True)}")
def grid(t: Tables) -> DataFrame:
    returns = pf.grid_returns(t.predictions, _params(t), ["ridge_pred", "lgbm_pred"])
    return pf.return_metrics(returns, ["param_id"], compounded=True)


@query("b10_neighbourhood", f"WITH {RUN}, m AS ({metrics_sql('grid', 'param_id', True)}), best AS (SELECT top_n, w_lgbm_pred FROM m JOIN params USING (param_id) ORDER BY sharpe DESC, param_id LIMIT 1) SELECT param_id FROM params p, best WHERE p.top_n = best.top_n AND abs(p.w_lgbm_pred - best.w_lgbm_pred) <= 0.5")
def neighbourhood(t: Tables) -> DataFrame:
    params = _params(t)
    m = pf.return_metrics(pf.grid_returns(t.predictions, params, ["ridge_pred", "lgbm_pred"]), ["param_id"], compounded=True)
    best = m.join(params, "param_id").orderBy(F.desc("sharpe"), "param_id").limit(1).select(F.col("top_n").alias("bt"), F.col("w_lgbm_pred").alias("bw"))
    return params.crossJoin(F.broadcast(best)).filter("top_n = bt and abs(w_lgbm_pred - bw) <= 0.5").select("param_id")


@query("b12_selection_score", f"WITH {RUN}, m AS ({metrics_sql('grid', 'param_id', True)}) SELECT top_n, avg(sharpe) AS sharpe, min(max_dd) AS worst_dd, avg(sharpe) + 0.5 * min(max_dd) + 0.2 * avg(win_rate) AS score FROM m JOIN params USING (param_id) GROUP BY top_n")
def selection_score(t: Tables) -> DataFrame:
    params = _params(t)
    m = pf.return_metrics(pf.grid_returns(t.predictions, params, ["ridge_pred", "lgbm_pred"]), ["param_id"], compounded=True).join(params, "param_id")
    return m.groupBy("top_n").agg(F.avg("sharpe").alias("sharpe"), F.min("max_dd").alias("worst_dd"), (F.avg("sharpe") + 0.5 * F.min("max_dd") + 0.2 * F.avg("win_rate")).alias("score"))


@query("b15_holm", f"WITH m AS (SELECT code AS name, least(abs(avg(ret)) / nullif(stddev_samp(ret), 0), 0.5) AS p FROM predictions GROUP BY code), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM m) SELECT name, p, least(max((m - r + 1) * p) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 1) AS holm, least(p * m, 1) AS bonferroni FROM r")
def holm(t: Tables) -> DataFrame:
    p = F.least(F.try_divide(F.abs(F.avg("ret")), F.nullif(F.stddev_samp("ret"), F.lit(0.0))), F.lit(0.5))
    return pf.holm(t.predictions.groupBy(F.col("code").alias("name")).agg(p.alias("p")))


@query("b19_monthly_win_rate", f"WITH {PORT}, {PLAIN}, c AS (SELECT strftime(date, '%Y-%m') AS month, sum(ln(1 + net)) AS a FROM port GROUP BY ALL), p AS (SELECT strftime(date, '%Y-%m') AS month, sum(ln(1 + net)) AS b FROM plain GROUP BY ALL) SELECT avg((round(a, 9) > round(b, 9))::DOUBLE) AS win_rate, count(*) AS months FROM c JOIN p USING (month)")
def monthly_win_rate(t: Tables) -> DataFrame:
    """In which share of the months the filtered portfolio compounds to more than the same without filters."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    total = lambda rules, name: pf.portfolio(t.predictions, rules=rules).groupBy(month).agg(F.round(F.sum(F.log1p("net")), 9).alias(name))
    both = total(RULES, "a").join(total((), "b"), "month")
    return both.agg(F.avg((F.col("a") > F.col("b")).cast("double")).alias("win_rate"), F.count("*").alias("months"))


@query("b25_regime_weights", f"WITH {RUN}, reg AS (SELECT date, CASE WHEN avg(ret) > 0 THEN 'up' ELSE 'down' END AS regime FROM predictions GROUP BY date), m AS (SELECT regime, param_id, count(*) AS n, avg(net) / nullif(stddev_samp(net), 0) AS sharpe FROM grid JOIN reg USING (date) GROUP BY ALL) SELECT regime, arg_max(param_id, {{'a': sharpe, 'b': -param_id}}) AS param_id FROM m WHERE n >= 20 GROUP BY regime")
def regime_weights(t: Tables) -> DataFrame:
    reg = t.predictions.groupBy("date").agg(F.when(F.avg("ret") > 0, "up").otherwise("down").alias("regime"))
    g = pf.grid_returns(t.predictions, _params(t), ["ridge_pred", "lgbm_pred"]).join(reg, "date")
    m = g.groupBy("regime", "param_id").agg(F.count("*").alias("n"), F.try_divide(F.avg("net"), F.nullif(F.stddev_samp("net"), F.lit(0.0))).alias("sharpe"))
    return m.filter("n >= 20").groupBy("regime").agg(F.max_by("param_id", F.struct("sharpe", -F.col("param_id"))).alias("param_id"))


@query("b29_signal_backtest", f"WITH s AS (SELECT code, date, sign(close - avg(close) OVER ({W} ROWS 4 PRECEDING)) + sign(close - avg(close) OVER ({W} ROWS 19 PRECEDING)) + sign(close / lag(close, 3) OVER ({W}) - 1) AS score, {', '.join(f'lead(close, {h}) OVER ({W}) / close - 1 AS r{h}' for h in (1, 3, 5))} FROM bars) SELECT CAST(score AS INTEGER) AS score, count(*) AS n, {', '.join(f'avg((r{h} > 0)::DOUBLE) AS win_{h}' for h in (1, 3, 5))} FROM s WHERE abs(score) >= 3 GROUP BY ALL")
def signal_backtest(t: Tables) -> DataFrame:
    c = F.col("close")
    score = F.signum(c - F.avg("close").over(wc().rowsBetween(-4, 0))) + F.signum(c - F.avg("close").over(wc().rowsBetween(-19, 0))) + F.signum(change("close", 3))
    s = t.bars.select(score.cast("int").alias("score"), *(forward("close", h).alias(f"r{h}") for h in (1, 3, 5))).filter("abs(score) >= 3")
    return s.groupBy("score").agg(F.count("*").alias("n"), *(F.avg((F.col(f"r{h}") > 0).cast("double")).alias(f"win_{h}") for h in (1, 3, 5)))


@query("b35_compare_runs", f"WITH {PORT}, x AS (SELECT 'net' AS run, date, net FROM port UNION ALL SELECT 'gross', date, gross FROM port) {metrics_sql('x', 'run')}")
def compare_runs(t: Tables) -> DataFrame:
    p = pf.portfolio(t.predictions, rules=RULES)
    return pf.return_metrics(p.select(F.lit("net").alias("run"), "date", "net").union(p.select(F.lit("gross"), "date", "gross")), ["run"])
