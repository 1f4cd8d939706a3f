"""The full short grid: 8,100 rows with their metrics, the neighbourhood of the best, promotion on a holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.operators import evaluation as ev
from tessera.operators import gridrun as gr
from tessera.plans.q_xsec import z
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

BOUNDARY, TRIALS = "1996-06-01", 20
LIMITS = {"ic_weight": 0.03, "top_n": 1.0, "ridge_quantile": 0.05, "pred_quantile": 0.05, "naive_weight": 0.10}
SIZES, EXPOSURES = ev.SHORT["top_n"], ev.SHORT["gross_exposure"]


def _days(t: Tables) -> DataFrame:
    legs = {n: cross.zscore(c, population=True, zero=True) for n, c in (("base", "lgbm_pred"), ("ic", "vol"), ("naive", "rule_score"))}
    pred = t.predictions.select("date", "code", "ret", "ridge_pred", *(v.alias(n) for n, v in legs.items()))
    return gr.list_days(gr.ranked_lists(pred, ev.parameter_grid(t.spark, "short"), "base", "ic", "naive", "ridge_pred", "ret"), SIZES)


def _numbers(values) -> str:
    return "[" + ", ".join("NULL::DOUBLE" if v is None else f"{v}::DOUBLE" for v in values) + "]"


_PQ, _RQ = [q for q in ev.SHORT["pred_quantile"] if q is not None], ev.SHORT["ridge_quantile"]
_LIST = "ic_weight, naive_weight, pred_quantile, ridge_quantile"
DAYS = f"""zd AS (SELECT date, code, ret, round(ridge_pred, 9) AS ridge, coalesce({z('lgbm_pred', 'stddev_pop')}, 0) AS base, coalesce({z('vol', 'stddev_pop')}, 0) AS ic, coalesce({z('rule_score', 'stddev_pop')}, 0) AS naive FROM predictions),
wt AS (SELECT a.x AS ic_weight, b.x AS naive_weight FROM (SELECT unnest({_numbers(ev.SHORT['ic_weight'])}) AS x) a, (SELECT unnest({_numbers(ev.SHORT['naive_weight'])}) AS x) b),
sc AS (SELECT date, code, ret, ridge, ic_weight, naive_weight, round(base + ic_weight * ic + naive_weight * naive, 9) AS score FROM zd, wt WHERE round(base + ic_weight * ic + naive_weight * naive, 9) > 0),
c1 AS (SELECT date, ic_weight, naive_weight, count(*) AS n, quantile_cont(score, {_numbers(_PQ)}) AS c FROM sc GROUP BY ALL),
d1 AS (SELECT date, ic_weight, naive_weight, n, unnest({_numbers(_PQ)}) AS pred_quantile, unnest(c) AS c FROM c1 UNION ALL SELECT date, ic_weight, naive_weight, 0, NULL, NULL FROM c1),
f1 AS (SELECT sc.*, pred_quantile FROM sc JOIN d1 USING (date, ic_weight, naive_weight) WHERE pred_quantile IS NULL OR n < 5 OR score >= round(c, 9)),
c2 AS (SELECT date, ic_weight, naive_weight, coalesce(pred_quantile, -1) AS pq, count(ridge) AS n, quantile_cont(ridge, {_numbers(_RQ)}) AS c FROM f1 GROUP BY ALL),
d2 AS (SELECT date, ic_weight, naive_weight, pq, n, unnest({_numbers(_RQ)}) AS ridge_quantile, unnest(c) AS c FROM c2),
f2 AS (SELECT f1.*, ridge_quantile FROM f1 JOIN d2 ON f1.date = d2.date AND f1.ic_weight = d2.ic_weight AND f1.naive_weight = d2.naive_weight AND coalesce(f1.pred_quantile, -1) = d2.pq WHERE d2.n < 5 OR ridge >= round(d2.c, 9)),
tp AS (SELECT *, row_number() OVER (PARTITION BY date, {_LIST} ORDER BY score DESC, code) AS rn FROM f2 QUALIFY rn <= 5),
ls AS (SELECT date, {_LIST}, list(code ORDER BY rn) AS codes, list(ret ORDER BY rn) AS rets FROM tp GROUP BY ALL),
lw AS (SELECT *, coalesce(lag(codes) OVER (PARTITION BY {_LIST} ORDER BY date), []) AS was FROM ls),
dy AS (SELECT {_LIST}, k AS top_n, date, len(codes[1:k]) AS held, list_sum(rets[1:k]) AS earned,
         (len(codes[1:k]) + len(was[1:k]) - 2 * len(list_intersect(codes[1:k], was[1:k])) + abs(len(codes[1:k]) - len(was[1:k]))) / 2.0 AS moved FROM lw, (SELECT unnest([1, 2, 3, 4, 5]) AS k))"""


def metrics_sql(name: str, where: str = "TRUE") -> str:
    """Common table expressions up to ``name``, the metrics of all rows over some of the days."""
    k = f"{_LIST}, top_n, gross_exposure"
    return f"""{name}n AS (SELECT {k}, date, held, moved, greatest(gross_exposure / top_n * (earned - 0.002 * moved), -0.99) AS net FROM dy, (SELECT unnest({_numbers(EXPOSURES)}) AS gross_exposure) WHERE {where}),
{name}v AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM {name}n),
{name}d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd FROM {name}v),
{name}m AS (SELECT {k}, count(*) AS n, avg(held) AS holdings, exp(sum(ln(1 + net)) * 84.0 / count(*)) - 1 AS annual, stddev_samp(net) * sqrt(84.0) AS vol, avg(net) * 84.0 AS mean, min(dd) AS max_dd, avg((net > 0)::DOUBLE) AS win_rate, avg(moved) * gross_exposure / top_n AS turnover FROM {name}d GROUP BY {k}),
{name} AS (SELECT *, annual / nullif(vol, 0) AS sharpe, mean / nullif(vol, 0) AS mean_sharpe FROM {name}m)"""


COLUMNS = f"{_LIST}, top_n, gross_exposure, n, holdings, annual, vol, max_dd, win_rate, turnover, sharpe, mean_sharpe"


def full_metrics(t: Tables, where: str | None = None) -> DataFrame:
    days = _days(t)
    return gr.grid_metrics(days.filter(where) if where else days, ev.parameter_grid(t.spark, "short"), EXPOSURES, 3)


@query("b11_full_grid", f"WITH {DAYS}, {metrics_sql('gm')} SELECT {COLUMNS} FROM gm")
def full_grid(t: Tables) -> DataFrame:
    """All 8,100 rows of the short grid with their metrics."""
    return full_metrics(t).select(*COLUMNS.split(", "))


_ORDER = "round(mean_sharpe, 9) DESC NULLS LAST, gross_exposure, top_n, coalesce(ic_weight, -1), coalesce(naive_weight, -1), coalesce(pred_quantile, -1), coalesce(ridge_quantile, -1)"
_NEAR = " AND ".join(f"(b.{c} IS NULL OR coalesce(abs(gm.{c} - b.{c}) <= {v} + 1e-12, FALSE))" for c, v in LIMITS.items())


@query("b10_grid_neighbours", f"WITH {DAYS}, {metrics_sql('gm')}, b AS (SELECT * FROM gm ORDER BY {_ORDER} LIMIT 1) SELECT {', '.join(f'gm.{c}' for c in COLUMNS.split(', '))} FROM gm, b WHERE abs(gm.gross_exposure - b.gross_exposure) <= 1e-12 AND {_NEAR}")
def grid_neighbours(t: Tables) -> DataFrame:
    """The rows around the best of the grid."""
    return gr.neighbours(full_metrics(t), LIMITS).select(*COLUMNS.split(", "))


@query("b18_full_promotion", f"""WITH {DAYS}, {metrics_sql('early', "date < DATE '1996-06-01'")}, {metrics_sql('late', "date >= DATE '1996-06-01'")},
best AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS trial FROM early QUALIFY trial <= {TRIALS}),
bs AS (SELECT mean_sharpe, max_dd FROM late WHERE ic_weight = 0 AND naive_weight = 0 AND pred_quantile IS NULL AND ridge_quantile = 0.45 AND top_n = 5 AND gross_exposure = 0.18),
x AS (SELECT trial, {', '.join(f'best.{c}' for c in (_LIST + ', top_n, gross_exposure').split(', '))}, best.mean_sharpe AS selection_sharpe, late.mean_sharpe - bs.mean_sharpe AS sharpe_gain, late.max_dd - bs.max_dd AS dd_change
  FROM best LEFT JOIN late ON {' AND '.join(f'best.{c} IS NOT DISTINCT FROM late.{c}' for c in (_LIST + ', top_n, gross_exposure').split(', '))} LEFT JOIN bs ON TRUE),
y AS (SELECT *, coalesce(round(sharpe_gain, 9) >= 0.1 AND dd_change >= -0.02, FALSE) AS promote FROM x)
SELECT *, promote AND sum(promote::INTEGER) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) = 1 AS chosen FROM y""")
def full_promotion(t: Tables) -> DataFrame:
    """The best twenty of the grid (by the Sharpe of mean returns: compounding the given prices leaves any scale) before the boundary against its plainest row behind it; the first that passes is chosen."""
    early = f"date < date'{BOUNDARY}'"
    key = [*gr.LIST, "top_n", "gross_exposure"]
    first = [F.desc_nulls_last(F.round("mean_sharpe", gr.DIGITS)), "gross_exposure", "top_n", *(F.coalesce(c, F.lit(-1.0)) for c in gr.LIST)]
    best = full_metrics(t, early).orderBy(*first).limit(TRIALS)
    best = best.select(*key, F.col("mean_sharpe").alias("selection_sharpe"), F.row_number().over(Window.orderBy(*first)).alias("trial"))
    late = full_metrics(t, f"not ({early})").select(*key, "mean_sharpe", "max_dd")
    base = late.filter("ic_weight = 0 and naive_weight = 0 and pred_quantile is null and ridge_quantile = 0.45 and top_n = 5 and gross_exposure = 0.18").agg(F.first("mean_sharpe").alias("bs"), F.first("max_dd").alias("bd"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"l.{c}"))
    x = best.alias("b").join(late.alias("l"), same, "left")
    x = x.crossJoin(F.broadcast(base)).select("trial", *(f"b.{c}" for c in key), "selection_sharpe", (F.col("mean_sharpe") - F.col("bs")).alias("sharpe_gain"), (F.col("max_dd") - F.col("bd")).alias("dd_change"))
    x = x.withColumn("promote", F.coalesce((F.round("sharpe_gain", gr.DIGITS) >= 0.1) & (F.col("dd_change") >= -0.02), F.lit(False)))
    return x.withColumn("chosen", F.col("promote") & (F.sum(F.col("promote").cast("int")).over(Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)) == 1))
