"""Regressions on several columns per date, orthogonal legs and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.rolling import wc
from tessera.operators import crossfit as cf
from tessera.operators import evaluation as ev
from tessera.plans.q_xsec import D, rank, z
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

#: Slopes of y on a and b from sums of centred products; a dependent column gets none.
SLOPES = """CASE WHEN aa * bb - ab * ab > 1e-10 * aa * bb THEN (ay * bb - bz * ab) / (aa * bb - ab * ab) WHEN aa > 1e-24 THEN ay / aa ELSE 0 END AS s1,
CASE WHEN aa * bb - ab * ab > 1e-10 * aa * bb THEN (bz * aa - ay * ab) / (aa * bb - ab * ab) WHEN aa > 1e-24 THEN 0 WHEN bb > 1e-24 THEN bz / bb ELSE 0 END AS s2"""


@query("x06_neutralise", f"""WITH p AS (SELECT code, date, industry, ridge_pred AS y, vol, rule_score, count(*) OVER ({D}) AS n FROM predictions JOIN securities USING (code)),
c AS (SELECT *, y - avg(y) OVER g AS cy, vol - avg(vol) OVER g AS a, rule_score - avg(rule_score) OVER g AS b FROM p WINDOW g AS (PARTITION BY date, industry)),
s AS (SELECT date, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * cy) AS ay, sum(b * cy) AS bz, count(DISTINCT industry) AS k FROM c GROUP BY date), t AS (SELECT date, k, {SLOPES} FROM s)
SELECT code, date, CASE WHEN n > 3 + k + 1 + 2 THEN cy - s1 * a - s2 * b ELSE y END AS x FROM c JOIN t USING (date)""")
def neutralise(t: Tables) -> DataFrame:
    """Residuals on a constant, volatility, the rule and the industries; dates with too few rows keep their values."""
    p = t.predictions.join(t.securities.select("code", "industry"), "code")
    return cf.residuals(p, ["ridge_pred"], ["vol", "rule_score"], "industry").select("code", "date", F.col("ridge_pred").alias("x"))


@query("x08_orthogonal_to_two", f"""WITH r AS (SELECT code, date, {rank('ridge_pred')} / count(*) OVER ({D}) AS y, {rank('lgbm_pred')} / count(*) OVER ({D}) AS u, {rank('vol')} / count(*) OVER ({D}) AS v, count(*) OVER ({D}) AS n FROM predictions),
c AS (SELECT *, y - avg(y) OVER ({D}) AS cy, u - avg(u) OVER ({D}) AS a, v - avg(v) OVER ({D}) AS b FROM r),
s AS (SELECT date, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * cy) AS ay, sum(b * cy) AS bz FROM c GROUP BY date), t AS (SELECT date, {SLOPES} FROM s),
e AS (SELECT code, date, n, cy - s1 * a - s2 * b AS e FROM c JOIN t USING (date))
SELECT code, date, CASE WHEN n >= 15 THEN CASE WHEN stddev_pop(e) OVER ({D}) > 1e-12 THEN e / stddev_pop(e) OVER ({D}) ELSE 0 END END AS x FROM e""")
def orthogonal_to_two(t: Tables) -> DataFrame:
    return cf.orthogonal_increment(t.predictions, "ridge_pred", ["lgbm_pred", "vol"], "x", 15).select("code", "date", "x")


WEIGHTS, HORIZONS, BOUNDARY = (0.0, 0.03, 0.05, 0.10), (1, 2, 3), "1996-06-01"


def increment_frame(t: Tables) -> DataFrame:
    """(code, date, champion, increment, ret_1..3): the champion's score, the momentum leg orthogonal to it, and returns."""
    close = F.col("close")
    ret = t.bars.select("code", "date", *((F.lead("close", h).over(wc()) / close - 1).alias(f"ret_{h}") for h in HORIZONS))
    p = t.predictions.withColumn("champion", cross.zscore("lgbm_pred", population=True, zero=True) + 0.5 * cross.zscore("rule_score", population=True, zero=True))
    return cf.orthogonal_increment(p, "ridge_pred", ["champion"], "increment", 10).select("code", "date", "champion", "increment").join(ret, ["code", "date"])


_LEGS = f"""fr AS (SELECT code, date, coalesce({z('lgbm_pred', 'stddev_pop')}, 0) + 0.5 * coalesce({z('rule_score', 'stddev_pop')}, 0) AS champion, ridge_pred FROM predictions),
rk AS (SELECT code, date, champion, {rank('ridge_pred')} / count(*) OVER ({D}) AS y, {rank('champion')} / count(*) OVER ({D}) AS u, count(*) OVER ({D}) AS n FROM fr),
ct AS (SELECT *, y - avg(y) OVER ({D}) AS cy, u - avg(u) OVER ({D}) AS a FROM rk),
rs AS (SELECT *, cy - coalesce(sum(a * cy) OVER ({D}) / nullif(sum(a * a) OVER ({D}), 0), 0) * a AS e FROM ct),
ic AS (SELECT code, date, champion, CASE WHEN n >= 10 THEN CASE WHEN stddev_pop(e) OVER ({D}) > 1e-12 THEN e / stddev_pop(e) OVER ({D}) ELSE 0 END END AS increment FROM rs),
rt AS (SELECT code, date, lead(close, 1) OVER w / close - 1 AS ret_1, lead(close, 2) OVER w / close - 1 AS ret_2, lead(close, 3) OVER w / close - 1 AS ret_3 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
lg AS (SELECT * FROM ic JOIN rt USING (code, date))"""


@query("x08_increment_legs", f"WITH {_LEGS} SELECT code, date, champion, increment FROM lg")
def increment_legs(t: Tables) -> DataFrame:
    return increment_frame(t).select("code", "date", "champion", "increment")


_DAYS = " UNION ALL ".join(
    f"SELECT {h} AS horizon, {w}::DOUBLE AS weight, date, avg(ret_{h}) / {h} AS net FROM (SELECT date, ret_{h} FROM lg WHERE ret_{h} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(champion + {w} * coalesce(increment, 0), 9) DESC, code) <= 5) GROUP BY date"
    for h in HORIZONS
    for w in WEIGHTS
)


def _side(cond: str, name: str) -> str:
    return f"{name}_h AS (SELECT horizon, weight, avg(net) * 252 / nullif(stddev_samp(net) * sqrt(252), 0) AS sharpe FROM ds WHERE {cond} GROUP BY ALL), {name} AS (SELECT weight, avg(sharpe) AS sharpe, min(sharpe) AS worst FROM {name}_h GROUP BY weight)"


@query("b22_orthogonal_leg", f"""WITH {_LEGS}, ds AS ({_DAYS}), {_side("date < DATE '1996-06-01'", "sel")}, {_side("date >= DATE '1996-06-01'", "hld")},
m AS (SELECT weight, sel.sharpe AS selection_sharpe, hld.sharpe AS holdout_sharpe, hld.worst AS holdout_worst FROM sel LEFT JOIN hld USING (weight)),
r AS (SELECT m.*, row_number() OVER (ORDER BY CASE WHEN m.weight > 0 AND round(m.selection_sharpe, 9) > round(b.selection_sharpe, 9) THEN round(m.selection_sharpe, 9) END DESC NULLS LAST, m.weight) = 1 AS selected, b.holdout_sharpe AS base FROM m, (SELECT * FROM m WHERE weight = 0) AS b)
SELECT weight, selection_sharpe, holdout_sharpe, holdout_worst, selected, selected AND weight > 0 AND coalesce(round(holdout_sharpe, 9) > round(base, 9), FALSE) AS confirmed FROM r""")
def orthogonal_leg(t: Tables) -> DataFrame:
    """Weights of the orthogonal leg beside the champion: selected before the boundary over all horizons, confirmed behind it."""
    return ev.leg_over_horizons(increment_frame(t), "champion", "increment", {h: f"ret_{h}" for h in HORIZONS}, WEIGHTS, BOUNDARY)
