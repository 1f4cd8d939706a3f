"""Reranks of a pool and weights gated by the day's state, selected and tested on a holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.rolling import wc
from tessera.operators import stategates as sg
from tessera.plans.q_backtest import metrics_sql
from tessera.plans.q_xsec import D, z
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

BOUNDARY, LABELS = "1996-06-01", {h: f"ret_{h}" for h in (1, 2, 3)}


def frame(t: Tables) -> DataFrame:
    """(code, date, champion, leg, ret_1..3)."""
    ret = t.bars.select("code", "date", *((F.lead("close", h).over(wc()) / F.col("close") - 1).alias(c) for h, c in LABELS.items()))
    champion = cross.zscore("lgbm_pred", population=True, zero=True) + 0.5 * cross.zscore("rule_score", population=True, zero=True)
    return t.predictions.select("code", "date", F.round(champion, 9).alias("champion"), F.round("ridge_pred", 9).alias("leg")).join(ret, ["code", "date"])


def _state(x: str, name: str) -> str:
    gap = f"list_avg(list_reverse_sort(list({x}) FILTER ({x} IS NOT NULL))[1:2]) - median({x})"
    return f"stddev_pop({x}) AS {name}_s, CASE WHEN stddev_pop({x}) > 1e-12 THEN ({gap}) / stddev_pop({x}) WHEN count({x}) > 0 THEN 0 END AS {name}_g"


_FRAME = f"""rt AS (SELECT code, date, lead(close, 1) OVER w / close - 1 AS ret_1, lead(close, 2) OVER w / close - 1 AS ret_2, lead(close, 3) OVER w / close - 1 AS ret_3 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
f0 AS (SELECT code, date, round(coalesce({z('lgbm_pred', 'stddev_pop')}, 0) + 0.5 * coalesce({z('rule_score', 'stddev_pop')}, 0), 9) AS champion, round(ridge_pred, 9) AS leg FROM predictions),
f1 AS (SELECT f0.*, ret_1, ret_2, ret_3, champion > 0 AND row_number() OVER ({D} ORDER BY CASE WHEN champion > 0 THEN champion END DESC NULLS LAST, code) <= 10 AS p FROM f0 JOIN rt USING (code, date)),
fr AS (SELECT *, CASE WHEN p THEN leg END AS pl FROM f1),
st0 AS (SELECT date, count(pl) / nullif(count(*) FILTER (p), 0) AS cover, {_state('pl', 'a')}, {_state('leg', 'b')} FROM fr GROUP BY date),
st1 AS (SELECT *, CASE WHEN count(b_s) OVER w >= 20 THEN quantile_cont(b_s, 0.5) OVER w END AS usual FROM st0 WINDOW w AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
st AS (SELECT date, round(cover, 12) AS pool_coverage, round(a_s, 12) AS pool_dispersion, round(a_g, 12) AS pool_gap_z, round(b_s / nullif(usual, 0), 12) AS dispersion_ratio, round(b_g, 12) AS gap_z FROM st1)"""


@query("x21_gate_states", f"WITH {_FRAME} SELECT * FROM st")
def gate_states(t: Tables) -> DataFrame:
    return sg.state_features(frame(t), "champion", "leg", 10)


_FEATURES = ("pool_coverage", "pool_dispersion", "pool_gap_z", "dispersion_ratio", "gap_z")
_LONG = " UNION ALL ".join(f"SELECT date, '{f}' AS feature, {f} AS value FROM st" for f in _FEATURES)
_PICKS = " UNION ALL ".join(
    f"SELECT '{family}' AS family, {w}::DOUBLE AS weight, {h} AS horizon, date, list(code ORDER BY score DESC, code) AS now, list_sum(list(ret)) AS earned FROM (SELECT date, code, {c} AS ret, round(champion + {w} * {zed}, 9) AS score FROM zz WHERE {own} AND {c} IS NOT NULL AND round(champion + {w} * {zed}, 9) > 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, code) <= 3) GROUP BY date"
    for family, zed, own in (("pool", "zp", "p"), ("full", "zf", "TRUE"))
    for w in (0.0, 0.03, 0.05, 0.10)
    for h, c in LABELS.items()
)


def _zed(x: str) -> str:
    return f"coalesce(CASE WHEN stddev_pop({x}) OVER ({D}) > 1e-12 THEN ({x} - avg({x}) OVER ({D})) / stddev_pop({x}) OVER ({D}) END, 0)"


GATES_SQL = f"""WITH {_FRAME}, lo AS ({_LONG}),
gt0 AS (SELECT 1 AS o, 'pool' AS family, 'always' AS feature, NULL::DOUBLE AS quantile, unnest([0.0::DOUBLE, 0.03, 0.05, 0.10]) AS high),
gates AS (SELECT row_number() OVER (ORDER BY o, f, quantile, high, low)::INTEGER AS gate, family, feature, quantile, high, low FROM (
  SELECT o, 0 AS f, family, feature, quantile, high, high AS low FROM gt0
  UNION ALL SELECT 2, f.i, 'pool', f.n, q, 0.05, 0.0 FROM (VALUES (1, 'pool_coverage'), (2, 'pool_dispersion'), (3, 'pool_gap_z')) AS f(i, n), (SELECT unnest([0.6::DOUBLE, 0.7, 0.8]) AS q)
  UNION ALL SELECT 3, 0, 'full', 'always', NULL, 0.0, 0.0
  UNION ALL SELECT 4, f.i, 'full', f.n, q, hi, lw FROM (VALUES (1, 'dispersion_ratio'), (2, 'gap_z')) AS f(i, n), (SELECT unnest([0.5::DOUBLE, 0.6, 0.7]) AS q), (SELECT unnest([0.05::DOUBLE, 0.10]) AS hi), (SELECT unnest([0.0::DOUBLE, 0.03]) AS lw))),
cq AS (SELECT feature, quantile_cont(value, [0.5, 0.6, 0.7, 0.8]) FILTER (date < DATE '1996-06-01') AS cuts, count(DISTINCT value) FILTER (date < DATE '1996-06-01') AS kinds FROM lo GROUP BY feature),
ct AS (SELECT gate, kinds, round(cuts[list_position([0.5::DOUBLE, 0.6, 0.7, 0.8], quantile)], 12) AS threshold FROM gates JOIN cq USING (feature)),
dl AS (SELECT gate, family, date, date < DATE '1996-06-01' AS early, CASE WHEN coalesce(value >= threshold, FALSE) THEN high ELSE low END AS weight FROM gates JOIN ct USING (gate) JOIN lo USING (feature) WHERE kinds >= 2
       UNION ALL SELECT gate, family, date, date < DATE '1996-06-01', high FROM gates, st WHERE feature = 'always'),
zz AS (SELECT *, {_zed('pl')} AS zp, {_zed('leg')} AS zf FROM fr), pk AS ({_PICKS}),
sr AS (SELECT gate, early, horizon, date, earned, now, coalesce(lag(now) OVER (PARTITION BY gate, early, horizon ORDER BY date), []) AS was FROM dl JOIN pk USING (family, weight, date)),
nt AS (SELECT gate, early, horizon, date, greatest((earned / horizon - 0.002 * (len(now) + len(was) - 2 * len(list_intersect(now, was)) + abs(len(now) - len(was))) / 2) / 3, -0.99) AS net FROM sr),
mt AS ({metrics_sql('nt', 'gate, early, horizon')}),
ms AS (SELECT gate, avg(sharpe) FILTER (early) AS selection_sharpe, min(max_dd) FILTER (early) AS selection_dd, avg(sharpe) FILTER (NOT early) AS holdout_sharpe, min(max_dd) FILTER (NOT early) AS holdout_dd FROM mt GROUP BY gate),
al AS (SELECT gates.*, CASE WHEN feature <> 'always' THEN threshold END AS threshold, ms.* EXCLUDE (gate) FROM gates JOIN ms USING (gate) LEFT JOIN ct USING (gate)),
rk AS (SELECT al.*, b.holdout_sharpe AS bh, round(al.selection_sharpe, 9) > round(b.selection_sharpe, 9) AND round(al.selection_dd, 9) >= round(b.selection_dd - 0.02, 9) AS ok FROM al JOIN al AS b ON b.family = al.family AND b.feature = 'always' AND b.high = 0),
sl AS (SELECT *, coalesce(ok, FALSE) AND row_number() OVER (PARTITION BY family ORDER BY CASE WHEN ok THEN round(selection_sharpe, 9) END DESC NULLS LAST, gate) = 1 AS selected FROM rk)
SELECT gate, family, feature, quantile, high, low, threshold, selection_sharpe, selection_dd, holdout_sharpe, holdout_dd, selected, selected AND coalesce(round(holdout_sharpe, 9) > round(bh, 9), FALSE) AS confirmed FROM sl"""


@query("b24_state_gates", GATES_SQL)
def state_gates(t: Tables) -> DataFrame:
    """Four constant reranks of the pool (B23), its nine gates, and the twenty-four gates of the whole list beside its baseline."""
    return sg.evaluate_gates(frame(t), "champion", "leg", LABELS, sg.gate_table(t.spark), BOUNDARY)
