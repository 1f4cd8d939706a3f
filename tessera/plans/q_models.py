"""Queries of model training (M) and walk-forward evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.operators import factor_stats as fs
from tessera.operators import models as md
from tessera.operators import portfolio as pf
from tessera.plans.q_stats import IC
from tessera.plans.q_xsec import D, rank
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

X = ["ridge_pred", "lgbm_pred"]
STARTS = ["1996-01-01", "1996-07-01", "1997-01-01", "1997-07-01", "1998-01-01", "1999-01-01"]


def ridge_sql(name: str, where: str, alpha: float = 10.0) -> str:
    """DuckDB text of the closed-form ridge with two features and a free intercept."""
    s = f"SELECT count(*) AS n, avg(ridge_pred) AS m1, avg(lgbm_pred) AS m2, avg(ret) AS my, covar_pop(ridge_pred, ridge_pred) * count(*) + {alpha} AS a, covar_pop(lgbm_pred, lgbm_pred) * count(*) + {alpha} AS d, covar_pop(ridge_pred, lgbm_pred) * count(*) AS b, covar_pop(ridge_pred, ret) * count(*) AS y1, covar_pop(lgbm_pred, ret) * count(*) AS y2 FROM predictions WHERE {where}"
    return f"{name} AS (SELECT (d * y1 - b * y2) / (a * d - b * b) AS b1, (a * y2 - b * y1) / (a * d - b * b) AS b2, my - (d * y1 - b * y2) / (a * d - b * b) * m1 - (a * y2 - b * y1) / (a * d - b * b) * m2 AS b0 FROM ({s}))"


@query("m01_ridge", f"WITH {ridge_sql('m', 'TRUE')} SELECT code, date, b0 + b1 * ridge_pred + b2 * lgbm_pred AS pred FROM predictions, m")
def ridge(t: Tables) -> DataFrame:
    p = t.predictions
    beta, bias = md.ridge(p, X, "ret", 10.0)
    return p.select("code", "date", (F.lit(bias) + sum(b * F.col(c) for b, c in zip(beta, X, strict=True))).alias("pred"))


@query("m03_ic_score", f"WITH {IC}, s AS (SELECT factor, avg(ic) / nullif(stddev_samp(ic), 0) AS w FROM ic GROUP BY factor) SELECT l.code, l.date, sum(w * value) AS score FROM long l JOIN s USING (factor) GROUP BY ALL")
def ic_score(t: Tables) -> DataFrame:
    factors = ["ridge_pred", "lgbm_pred", "rule_score", "vol"]
    p = t.predictions
    w = fs.ic_summary(fs.daily_ic(p, factors, "ret")).select("factor", "icir")
    long = p.select("code", "date", *factors).unpivot(["code", "date"], factors, "factor", "value")
    return long.join(F.broadcast(w), "factor").groupBy("code", "date").agg(F.sum(F.col("icir") * F.col("value")).alias("score"))


@query("m04_rank_vote", f"SELECT code, date, 0.7 * ({rank('ridge_pred')} / count(*) OVER ({D}) - 0.5) + 0.3 * ({rank('lgbm_pred')} / count(*) OVER ({D}) - 0.5) AS score FROM predictions")
def rank_vote(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", (0.7 * (cross.rank_pct("ridge_pred") - 0.5) + 0.3 * (cross.rank_pct("lgbm_pred") - 0.5)).alias("score"))


@query("m02_elastic_net")
def elastic_net(t: Tables) -> DataFrame:
    return md.predict(md.train(t.predictions, X, "ret", "elastic_net"), t.predictions, X).select("code", "date", "pred")


def _weighted(p: DataFrame) -> DataFrame:
    """Rows weighted by age; those from 1997 on are for validation."""
    return md.decay_weights(p).withColumn("held", F.col("date") >= F.lit("1997-01-01").cast("date"))


@query("m05_classifier")
def classifier(t: Tables) -> DataFrame:
    p = t.predictions.withColumn("up", (F.col("ret") > 0).cast("double"))
    return md.predict(md.train(md.decay_weights(p, minority="up"), X, "up", "logistic", "weight"), p, X).select("code", "date", "pred")


@query("m06_boosted_trees")
def boosted_trees(t: Tables) -> DataFrame:
    return md.predict(md.train(_weighted(t.predictions), [*X, "vol"], "ret", "boosted_trees", "weight", "held"), t.predictions, [*X, "vol"]).select("code", "date", "pred")


@query("m07_bagged_trees")
def bagged_trees(t: Tables) -> DataFrame:
    return md.predict(md.train(_weighted(t.predictions), [*X, "vol"], "ret", "bagged_trees", "weight"), t.predictions, [*X, "vol"]).select("code", "date", "pred")


@query("m08_rank_labels")
def rank_labels(t: Tables) -> DataFrame:
    """Learning to rank, pointwise: boosted trees on per-date relevance grades."""
    p = t.predictions.withColumn("grade", cross.relevance("ret", 5).cast("double"))
    return md.predict(md.train(_weighted(p), X, "grade", "boosted_trees", "weight", "held"), p, X).select("code", "date", "pred")


def _windows(select: str) -> str:
    heads = [ridge_sql(f"m{i}", f"date < DATE '{a}' - 7") for i, a in enumerate(STARTS[:-1])]
    parts = [f"SELECT code, date, b0 + b1 * ridge_pred + b2 * lgbm_pred AS pred, ret, '{a}' AS win FROM predictions, m{i} WHERE date >= DATE '{a}' AND date < DATE '{z}'" for i, (a, z) in enumerate(zip(STARTS[:-1], STARTS[1:], strict=True))]
    return f"WITH {', '.join(heads)}, walk AS ({' UNION ALL '.join(parts)}) {select}"


@query("b06_walk_forward", _windows("SELECT code, date, pred, win FROM walk"))
def walk_forward(t: Tables) -> DataFrame:
    return md.walk_forward(t.predictions, X, "ret", STARTS).select("code", "date", "pred", F.col("window").alias("win"))


@query("m10_walk_forward_ic")
def walk_forward_ic(t: Tables) -> DataFrame:
    """The walk-forward predictions' daily rank IC and the metrics of their portfolio."""
    p = md.walk_forward(t.predictions, X, "ret", STARTS)
    ic = fs.ic_summary(fs.daily_ic(p, ["pred"], "ret"))
    return ic.crossJoin(pf.return_metrics(pf.portfolio(p, "pred")).withColumnRenamed("n", "days").withColumnRenamed("win_rate", "day_win_rate"))
