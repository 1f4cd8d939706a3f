"""Portfolios from predictions, their turnover, cost and return metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rolling import wd
from tessera.operators.asof import full_outer_previous


def quantile_filters(pred: DataFrame, rules: Sequence[tuple[str, float, bool]], least: int = 5) -> DataFrame:
    """Filters per date one after another; each cuts at a quantile of what the ones before left, where ``least`` rows are
    left. A rule is (column, quantile, keep the upper side)."""
    alive: Column = F.lit(True)
    out = pred.withColumn("__alive", alive)
    for column, q, upper in rules:
        x = F.when(F.col("__alive"), F.col(column))
        cut, n = F.percentile(x, q).over(wd()), F.count(x).over(wd())
        ok = (F.col(column) >= cut) if upper else (F.col(column) <= cut)
        out = out.withColumn("__alive", F.col("__alive") & ((n < least) | ok))
    return out.filter("__alive").drop("__alive")


def top_weights(pred: DataFrame, score: str, top_n: int, max_weight: float) -> DataFrame:
    """(date, code, weight): the top n by score, equally weighted up to a cap; ties by code."""
    nth = F.row_number().over(wd().orderBy(F.desc(score), "code"))
    picked = pred.withColumn("__n", nth).filter(F.col("__n") <= top_n)
    return picked.withColumn("weight", F.least(1.0 / F.count("*").over(wd()), F.lit(max_weight))).drop("__n")


def turnover(weights: DataFrame) -> DataFrame:
    """(date, turnover): half the absolute changes of the weights and of cash against the portfolio emitted before."""
    both = full_outer_previous(weights.select("date", "code", "weight"))
    cash = F.abs(F.sum("before") - F.sum("weight"))
    return both.groupBy("date").agg(((F.sum(F.abs(F.col("weight") - F.col("before"))) + cash) / 2).alias("turnover"))


def portfolio(pred: DataFrame, score: str = "ridge_pred", label: str = "ret", top_n: int = 5, max_weight: float = 0.15, cost: float = 0.002, horizon: int = 3, rules: Sequence[tuple[str, float, bool]] = ()) -> DataFrame:
    """(date, gross, turnover, net, nav): filters, top n, weights, turnover, cost; a label of h sessions counts by 1/h."""
    w = top_weights(quantile_filters(pred, rules), score, top_n, max_weight)
    gross = w.groupBy("date").agg((F.sum(F.col("weight") * F.col(label)) / horizon).alias("gross"))
    day = gross.join(turnover(w), "date").withColumn("net", F.greatest(F.col("gross") - F.col("turnover") * cost, F.lit(-0.99)))
    # one row per date from here on; the running product is over dates alone
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumn("nav", F.exp(F.sum(F.log1p("net")).over(run)))


def return_metrics(day: DataFrame, by: Sequence[str] = (), ret: str = "net", compounded: bool = False, year: int = 252) -> DataFrame:
    """Annual return, volatility, Sharpe (arithmetic, or annual over volatility), drawdown and win rate of daily returns."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = part.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = day.withColumn("__nav", F.exp(F.sum(F.log1p(ret)).over(run)))
    x = x.withColumn("__dd", F.col("__nav") / F.greatest(F.max("__nav").over(run), F.lit(1.0)) - 1)
    n = F.count("*")
    annual, vol = F.exp(F.sum(F.log1p(ret)) * year / n) - 1, F.stddev_samp(ret) * year**0.5
    sharpe = F.try_divide(annual if compounded else F.avg(ret) * year, F.nullif(vol, F.lit(0.0)))
    return x.groupBy(*by).agg(n.alias("n"), annual.alias("annual"), vol.alias("vol"), sharpe.alias("sharpe"), F.min("__dd").alias("max_dd"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"))


def grid_returns(pred: DataFrame, params: DataFrame, legs: Sequence[str], label: str = "ret", cost: float = 0.002, max_weight: float = 0.15) -> DataFrame:
    """(param_id, date, net) of many parameter rows (param_id, top_n, w_<leg>...) at once: the parameter table is small by
    construction and broadcast; its id is part of every window key, so parameters spread over the cluster."""
    score = sum((F.col(f"w_{c}") * F.col(c) for c in legs), F.lit(0.0))
    p = pred.select("date", "code", label, *legs).crossJoin(F.broadcast(params)).withColumn("score", score)
    by = Window.partitionBy("param_id", "date")
    p = p.withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "code"))).filter("n <= top_n")
    w = p.withColumn("weight", F.least(1.0 / F.count("*").over(by), F.lit(max_weight))).select("param_id", "date", "code", "weight", label)
    days = w.select("param_id", "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("param_id").orderBy("date")))
    now = w.join(days, ["param_id", "date"])
    was = now.select("param_id", (F.col("k") + 1).alias("k"), "code", F.col("weight").alias("before"))
    both = now.drop("date").join(was, ["param_id", "k", "code"], "full_outer").join(days, ["param_id", "k"])
    a, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("before", F.lit(0.0))
    turn = (F.sum(F.abs(a - b)) + F.abs(F.sum(a) - F.sum(b))) / 2
    return both.groupBy("param_id", "date").agg((F.sum(a * F.coalesce(label, F.lit(0.0))) - cost * turn).alias("net"))


def holm(p: DataFrame) -> DataFrame:
    """Holm-adjusted p-values of a short table (name, p)."""
    order = Window.orderBy("p", "name")
    m = p.crossJoin(F.broadcast(p.agg(F.count("*").alias("m")))).withColumn("r", F.row_number().over(order))
    raw = (F.col("m") - F.col("r") + 1) * F.col("p")
    return m.select("name", "p", F.least(F.max(raw).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)).alias("holm"), F.least(F.col("p") * F.col("m"), F.lit(1.0)).alias("bonferroni"))
