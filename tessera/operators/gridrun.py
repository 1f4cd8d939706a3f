"""A whole parameter grid over one panel.

The score of a row depends on the pair of weights alone (15 in the short grid), what the two filters leave on the pair of
quantiles (36): 540 ranked lists of five names serve all 8,100 rows. The panel is multiplied by the pairs, never by the grid.
A list becomes one row per date; how many names are held and how much they cost are prefixes of it, and exposure only scales
them, so all exposures of a list and size come from the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits to which scores and cuts are compared, so that the order of a sum decides nothing.
DIGITS = 9
LIST = ("ic_weight", "naive_weight", "pred_quantile", "ridge_quantile")


def _cut(x: Column, among: DataFrame, part: list[str], name: str, values: Sequence[float | None], least: int) -> DataFrame:
    """For each quantile the rows at or above it, per part; all rows where the quantile is null or fewer than ``least`` count."""
    w, known = Window.partitionBy(*part), [v for v in values if v is not None]
    cuts = F.percentile(x, F.array(*map(F.lit, known))).over(w) if known else F.array().cast("array<double>")
    out = among.withColumns({"__n": F.count(x).over(w), "__cuts": cuts, "__x": x})
    passed = [F.when(F.lit(True) if v is None else F.col("__x").isNotNull() & ((F.col("__n") < least) | (F.col("__x") >= F.round(F.col("__cuts")[known.index(v)], DIGITS))), F.struct(F.lit(v).cast("double").alias("v"))) for v in values]
    out = out.withColumn("__q", F.explode(F.array_compact(F.array(*passed))))
    return out.withColumn(name, F.col("__q.v")).drop("__n", "__cuts", "__x", "__q")


def ranked_lists(pred: DataFrame, grid: DataFrame, base: str, ic: str, naive: str, ridge: str, label: str, most: int = 5, least: int = 5, positive_only: bool = True) -> DataFrame:
    """(date, weights, quantiles, picks): per date and list the first ``most`` (code, ret) by score. Rows without a score or a
    label don't count. The score's quantile cuts first, then the ridge's among what is left. The grid is a table of
    parameters; only its distinct weights and quantiles come to the driver."""
    pairs = sorted({(r.ic_weight, r.naive_weight) for r in grid.select("ic_weight", "naive_weight").distinct().collect()})
    null_first = lambda q: (q is not None, q or 0.0)
    upper, lower = (sorted({r[0] for r in grid.select(c).distinct().collect()}, key=null_first) for c in ("pred_quantile", "ridge_quantile"))
    scored = [F.struct(F.lit(a).alias("ic_weight"), F.lit(b).alias("naive_weight"), F.round(F.col(base) + a * F.col(ic) + b * F.col(naive), DIGITS).alias("score")) for a, b in pairs]
    x = pred.select("date", "code", F.col(label).alias("ret"), F.round(ridge, DIGITS).alias("ridge"), F.explode(F.array(*scored)).alias("s")).select("date", "code", "ret", "ridge", "s.*")
    x = x.filter(F.col("score").isNotNull() & F.col("ret").isNotNull() & ((F.col("score") > 0) if positive_only else F.lit(True)))
    # one shuffle: what follows is keyed by these and more
    part = ["date", "ic_weight", "naive_weight"]
    x = _cut(F.col("score"), x.repartition(*part), part, "pred_quantile", upper, least)
    part = [*part, "pred_quantile"]
    x = _cut(F.col("ridge"), x, part, "ridge_quantile", lower, least)
    part = [*part, "ridge_quantile"]
    nth = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("score"), "code"))
    top = x.withColumn("n", nth).filter(F.col("n") <= most)
    return top.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("n", "code", "ret"))).alias("picks"))


def list_days(lists: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(list, top_n, date, held, earned, moved): per date with any name the names held, the sum of their labels, and half the
    names that changed and the change of their number, against the list's date before. In units of one slot."""
    by = Window.partitionBy(*LIST).orderBy("date")
    codes = F.transform("picks", lambda p: p["code"])
    x = lists.select(*LIST, "date", codes.alias("codes"), F.transform("picks", lambda p: p["ret"]).alias("rets"))
    x = x.withColumn("was", F.coalesce(F.lag("codes").over(by), F.array().cast("array<string>")))
    x = x.withColumn("top_n", F.explode(F.array(*map(F.lit, sizes))))
    now, was = F.slice("codes", 1, F.col("top_n")), F.slice("was", 1, F.col("top_n"))
    earned = F.aggregate(F.slice("rets", 1, F.col("top_n")), F.lit(0.0), lambda a, r: a + r)
    changed = F.size(now) + F.size(was) - 2 * F.size(F.array_intersect(now, was))
    return x.select(*LIST, "top_n", "date", F.size(now).alias("held"), earned.alias("earned"), ((changed + F.abs(F.size(now) - F.size(was))) / 2).alias("moved"))


def grid_metrics(days: DataFrame, grid: DataFrame, exposures: Sequence[float], horizon: int, cost: float = 0.002) -> DataFrame:
    """One row for each row of the grid that ever holds a name: compounded return, volatility, Sharpe (of the compounded and of
    the mean return), drawdown, share of winning days, mean turnover and holdings. A day's net is exposure / top_n times what the slots earned less their cost,
    -99 % at least; a label of h sessions makes 252 / h periods a year."""
    key = [*LIST, "top_n"]
    run = Window.partitionBy(*key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    year = 252 / horizon
    net = [F.greatest(F.lit(e) / F.col("top_n") * (F.col("earned") - cost * F.col("moved")), F.lit(-0.99)) for e in exposures]
    x = days.select(*key, "date", "held", "moved", *(v.alias(f"net{i}") for i, v in enumerate(net)))
    x = x.withColumns({f"nav{i}": F.exp(F.sum(F.log1p(f"net{i}")).over(run)) for i in range(len(exposures))})
    x = x.withColumns({f"dd{i}": F.col(f"nav{i}") / F.greatest(F.max(f"nav{i}").over(run), F.lit(1.0)) - 1 for i in range(len(exposures))})
    n = F.count("*")
    one = lambda i, e: F.struct(
        F.lit(e).alias("gross_exposure"),
        (F.exp(F.sum(F.log1p(f"net{i}")) * year / n) - 1).alias("annual"),
        (F.stddev_samp(f"net{i}") * year**0.5).alias("vol"),
        (F.avg(f"net{i}") * year).alias("mean"),
        F.min(f"dd{i}").alias("max_dd"),
        F.avg((F.col(f"net{i}") > 0).cast("double")).alias("win_rate"),
        (F.avg("moved") * e / F.first("top_n")).alias("turnover"),
    )
    m = x.groupBy(*key).agg(n.alias("n"), F.avg("held").alias("holdings"), F.array(*(one(i, e) for i, e in enumerate(exposures))).alias("m"))
    m = m.select(*key, "n", "holdings", F.explode("m").alias("m")).select(*key, "n", "holdings", "m.*")
    ratio = lambda c: F.try_divide(c, F.nullif("vol", F.lit(0.0)))
    m = m.withColumns({"sharpe": ratio("annual"), "mean_sharpe": ratio("mean")}).drop("mean")
    # the grid may lack some of the combinations
    g = grid.select("gross_exposure", *key)
    same = F.lit(True)
    for c in g.columns:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}"))
    return m.alias("m").join(F.broadcast(g.alias("g")), same, "left_semi")


def neighbours(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The rows of a grid around its best one (by the mean return's Sharpe, then the parameters): each limited parameter at most so far away,
    and the same exposure. A null parameter of the best row limits nothing; a null in another row is outside."""
    order = F.struct(F.round("mean_sharpe", DIGITS), *(-F.coalesce(c, F.lit(-1.0)) for c in ("gross_exposure", "top_n", *LIST)))
    best = metrics.filter("mean_sharpe is not null").agg(F.max_by(F.struct(*limits, "gross_exposure"), order).alias("best"))
    near = F.abs(F.col("gross_exposure") - F.col("best.gross_exposure")) <= 1e-12
    for c, most in limits.items():
        near = near & (F.col(f"best.{c}").isNull() | F.coalesce(F.abs(F.col(c) - F.col(f"best.{c}")) <= most + 1e-12, F.lit(False)))
    return metrics.crossJoin(F.broadcast(best)).filter(near).drop("best")  # one row
