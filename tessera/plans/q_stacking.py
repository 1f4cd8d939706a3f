"""Stacked weights of three legs (M13) and their walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import stacking as sk
from tessera.plans.q_xsec import D
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

LEGS = ["ridge_pred", "lgbm_pred", "rule"]


def three_legs(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", "ret", "ridge_pred", "lgbm_pred", (F.col("rule_score") * 0.1).alias("rule"))


@query("m13_stacked_weights")
def stacked_weights(t: Tables) -> DataFrame:
    """The weight of each leg by clipped error over all rows, and the loss."""
    w, loss = sk.stack(three_legs(t), LEGS, "ret")
    return t.spark.createDataFrame([(c, float(v), loss) for c, v in zip(LEGS, w, strict=True)], "leg string, weight double, loss double")


_CLIP = "greatest(least(coalesce({0}, 0.5), 1.0), 0.0)"
_T = _CLIP.format("(ur - vr - uv + vv) / nullif(uu - 2 * uv + vv, 0)")
_LOSS = "round({0} * {0} * uu + 2 * {0} * {1} * uv + {1} * {1} * vv - 2 * {0} * ur - 2 * {1} * vr, 12)"
_EDGES = [(_CLIP.format("ur / nullif(uu, 0)"), "0.0"), ("0.0", _CLIP.format("vr / nullif(vv, 0)")), (_T, f"(1 - {_T})")]
_STRUCTS = ", ".join(f"{{'l': {_LOSS.format(a, b)}, 'i': {i}, 'a': {a}, 'b': {b}}}" for i, (a, b) in enumerate(_EDGES))

WALK3 = f"""lg AS (SELECT code, date, ret, ridge_pred AS x1, lgbm_pred AS x2, rule_score * 0.1 AS x3 FROM predictions),
dy AS (SELECT date, sum((x1 - x3) * (x1 - x3)) AS uu, sum((x1 - x3) * (x2 - x3)) AS uv, sum((x2 - x3) * (x2 - x3)) AS vv, sum((x1 - x3) * (ret - x3)) AS ur, sum((x2 - x3) * (ret - x3)) AS vr FROM lg GROUP BY date),
wn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, sum(uu) OVER b AS uu, sum(uv) OVER b AS uv, sum(vv) OVER b AS vv, sum(ur) OVER b AS ur, sum(vr) OVER b AS vr FROM dy WINDOW b AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
ft AS (SELECT *, uu * vv - uv * uv AS det, (ur * vv - vr * uv) / nullif(uu * vv - uv * uv, 0) AS ia, (vr * uu - ur * uv) / nullif(uu * vv - uv * uv, 0) AS ib, list_min([{_STRUCTS}]) AS e FROM wn),
wt AS (SELECT date, i, CASE WHEN i >= 60 AND (i - 60) % 5 = 0 THEN CASE WHEN coalesce(det > 1e-12 * uu * vv AND ia >= 0 AND ib >= 0 AND ia + ib <= 1, FALSE) THEN [round(ia, 9), round(ib, 9), round(1 - ia - ib, 9)] ELSE [round(e.a, 9), round(e.b, 9), round(1 - e.a - e.b, 9)] END END AS w FROM ft),
hl AS (SELECT date, i, last_value(w IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM wt),
rk AS (SELECT date, w, ret, row_number() OVER ({D} ORDER BY round(w[1] * x1 + w[2] * x2 + w[3] * x3, 9) DESC, code) AS a, row_number() OVER ({D} ORDER BY round((x1 + x2 + x3) / 3, 9) DESC, code) AS b FROM lg JOIN hl USING (date) WHERE i >= 60)"""


@query("b27_three_leg_walk", f"WITH {WALK3} SELECT date, w[1] AS w_1, w[2] AS w_2, w[3] AS w_3, avg(ret) FILTER (a <= 10) - 0.002 AS candidate, avg(ret) FILTER (b <= 10) - 0.002 AS baseline FROM rk GROUP BY date, w")
def three_leg_walk(t: Tables) -> DataFrame:
    """The walk of three weights, refitted every five dates on sixty, with the days of the candidate and of equal weights."""
    p = three_legs(t)
    out = sk.simplex_days(p, sk.walk_forward_simplex(p, LEGS, "ret"), LEGS, "ret")
    return out.select("date", *(F.col("weights")[i].alias(f"w_{i + 1}") for i in range(3)), "candidate", "baseline")
