"""Queries of the cross-sections per date (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.rolling import wd
from tessera.operators.selection import bounded
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

D = "PARTITION BY date"


def rank(x: str, by: str = "date") -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE)"


def z(x: str, f: str = "stddev_samp") -> str:
    return f"({x} - avg({x}) OVER ({D})) / nullif({f}({x}) OVER ({D}), 0)"


@query("x01_winsor", f"SELECT code, date, greatest(least(ridge_pred, quantile_cont(ridge_pred, 0.99) OVER ({D})), quantile_cont(ridge_pred, 0.01) OVER ({D})) AS x FROM predictions")
def winsor(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", cross.winsor("ridge_pred").alias("x"))


@query("x02_zscore", f"SELECT code, date, {z('ridge_pred')} AS z, coalesce({z('ridge_pred')}, 0) AS z0, coalesce({z('ridge_pred', 'stddev_pop')}, 0) AS zp FROM predictions")
def zscore(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", cross.zscore("ridge_pred").alias("z"), cross.zscore("ridge_pred", zero=True).alias("z0"), cross.zscore("ridge_pred", population=True, zero=True).alias("zp"))


@query("x06_size_neutral", f"SELECT code, date, ridge_pred - regr_slope(ridge_pred, vol) OVER ({D}) * vol - regr_intercept(ridge_pred, vol) OVER ({D}) AS x FROM predictions")
def size_neutral(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", cross.size_neutral("ridge_pred", "vol").alias("x"))


@query("x06_industry_neutral", "SELECT code, date, ridge_pred - avg(ridge_pred) OVER (PARTITION BY date, industry) AS x FROM predictions JOIN securities USING (code)")
def industry_neutral(t: Tables) -> DataFrame:
    p = t.predictions.join(t.securities, "code")
    return p.select("code", "date", (F.col("ridge_pred") - F.avg("ridge_pred").over(Window.partitionBy("date", "industry"))).alias("x"))


@query("x08_orthogonal", f"WITH r AS (SELECT code, date, {rank('ridge_pred')} AS a, {rank('lgbm_pred')} AS b FROM predictions), e AS (SELECT code, date, a - avg(a) OVER ({D}) - coalesce(covar_pop(a, b) OVER ({D}) / nullif(var_pop(b) OVER ({D}), 0), 0) * (b - avg(b) OVER ({D})) AS e FROM r) SELECT code, date, e / nullif(stddev_pop(e) OVER ({D}), 0) AS x FROM e WHERE date IN (SELECT date FROM predictions GROUP BY date HAVING count(*) >= 5)")
def orthogonal(t: Tables) -> DataFrame:
    p = t.predictions.withColumn("n", F.count("*").over(wd())).filter("n >= 5")
    r = p.select("code", "date", cross.avg_rank("ridge_pred").alias("a"), cross.avg_rank("lgbm_pred").alias("b"))
    slope = F.coalesce(F.try_divide(F.covar_pop("a", "b").over(wd()), F.nullif(F.var_pop("b").over(wd()), F.lit(0.0))), F.lit(0.0))
    e = r.withColumn("e", F.col("a") - F.avg("a").over(wd()) - slope * (F.col("b") - F.avg("b").over(wd())))
    return e.select("code", "date", F.try_divide("e", F.nullif(F.stddev_pop("e").over(wd()), F.lit(0.0))).alias("x"))


@query("x09_buckets", f"WITH r AS (SELECT code, date, row_number() OVER ({D} ORDER BY ridge_pred, code) AS rn, count(*) OVER ({D}) AS n FROM predictions) SELECT code, date, CASE WHEN n > 1 THEN CAST(greatest(ceil((rn - 1) * 5 / (n - 1)) - 1, 0) AS INTEGER) END AS bucket FROM r")
def buckets(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", cross.quantile_bucket("ridge_pred", 5).alias("bucket"))


@query("x10_one_hot", "SELECT code, (industry = 'R0')::INTEGER AS is_r0, (industry = 'R1')::INTEGER AS is_r1, (industry = 'R2')::INTEGER AS is_r2, (industry = 'R3')::INTEGER AS is_r3, (industry = 'R4')::INTEGER AS is_r4 FROM securities")
def one_hot(t: Tables) -> DataFrame:
    s = t.securities
    values = [r[0] for r in bounded(s.select("industry").distinct().orderBy("industry"), 1000, "categories")]
    return s.select("code", *(F.coalesce((F.col("industry") == v).cast("int"), F.lit(0)).alias(f"is_{v.lower()}") for v in values))


@query("x11_crosses", "SELECT code, date, ridge_pred * lgbm_pred AS ridge_x_lgbm, ridge_pred * vol AS ridge_x_vol, lgbm_pred * vol AS lgbm_x_vol FROM predictions")
def crosses(t: Tables) -> DataFrame:
    from itertools import combinations

    names = {"ridge_pred": "ridge", "lgbm_pred": "lgbm", "vol": "vol"}
    return t.predictions.select("code", "date", *((F.col(a) * F.col(b)).alias(f"{names[a]}_x_{names[b]}") for a, b in combinations(names, 2)))


@query("x13_prepare", f"WITH w AS (SELECT code, date, vol, greatest(least(ridge_pred, quantile_cont(ridge_pred, 0.99) OVER ({D})), quantile_cont(ridge_pred, 0.01) OVER ({D})) AS x FROM predictions), v AS (SELECT code, date, x, greatest(least(vol, quantile_cont(vol, 0.99) OVER ({D})), quantile_cont(vol, 0.01) OVER ({D})) AS s FROM w), n AS (SELECT code, date, x - regr_slope(x, s) OVER ({D}) * s - regr_intercept(x, s) OVER ({D}) AS r FROM v WHERE date IN (SELECT date FROM v GROUP BY date HAVING count(*) >= 5)) SELECT code, date, {z('r')} AS z FROM n")
def prepare(t: Tables) -> DataFrame:
    p = t.predictions.withColumn("n", F.count("*").over(wd())).filter("n >= 5")
    w = p.select("code", "date", cross.winsor("ridge_pred").alias("x"), cross.winsor("vol").alias("s"))
    n = w.select("code", "date", cross.size_neutral("x", "s").alias("r"))
    return n.select("code", "date", cross.zscore("r").alias("z"))


@query("x15_rank_pct", f"SELECT code, date, {rank('ridge_pred')} / count(ridge_pred) OVER ({D}) AS pct FROM predictions")
def rank_pct(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", cross.rank_pct("ridge_pred").alias("pct"))


@query("x16_relevance", f"WITH r AS (SELECT code, date, row_number() OVER ({D} ORDER BY ret, code) AS rn, count(*) OVER ({D}) AS n FROM predictions) SELECT code, date, CAST(least(floor(rn / n * 5), 4) AS INTEGER) AS relevance FROM r WHERE n >= 2")
def relevance(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", cross.relevance("ret", 5).alias("relevance")).filter("relevance is not null")


@query("x17_blend", "SELECT code, date, (CASE WHEN ridge_pred > 0 THEN 0.6 * ridge_pred ELSE 0 END + 0.4 * lgbm_pred) / (CASE WHEN ridge_pred > 0 THEN 0.6 ELSE 0 END + 0.4) AS score FROM predictions")
def blend(t: Tables) -> DataFrame:
    p = t.predictions.withColumn("a", F.when(F.col("ridge_pred") > 0, F.col("ridge_pred")))
    return p.select("code", "date", cross.blend({"a": 0.6, "lgbm_pred": 0.4}).alias("score"))


@query("x18_score", f"SELECT code, date, coalesce({z('ridge_pred', 'stddev_pop')}, 0) + 0.5 * coalesce({z('lgbm_pred', 'stddev_pop')}, 0) + 0.1 * coalesce({z('rule_score', 'stddev_pop')}, 0) AS score FROM predictions")
def score(t: Tables) -> DataFrame:
    legs = {"ridge_pred": 1.0, "lgbm_pred": 0.5, "rule_score": 0.1}
    return t.predictions.select("code", "date", sum(w * cross.zscore(c, True, True) for c, w in legs.items()).alias("score"))


@query("x19_agreement", f"SELECT code, date, 1 - abs({rank('ridge_pred')} / count(*) OVER ({D}) - {rank('lgbm_pred')} / count(*) OVER ({D})) AS confidence FROM predictions")
def agreement(t: Tables) -> DataFrame:
    return t.predictions.select("code", "date", (1 - F.abs(cross.rank_pct("ridge_pred") - cross.rank_pct("lgbm_pred"))).alias("confidence"))


@query("x20_pool_rerank", f"WITH p AS (SELECT * FROM (SELECT *, row_number() OVER ({D} ORDER BY ridge_pred DESC, code) AS rn FROM predictions) WHERE rn <= 8), s AS (SELECT code, date, coalesce({z('ridge_pred', 'stddev_pop')}, 0) + 0.5 * coalesce({z('lgbm_pred', 'stddev_pop')}, 0) AS s FROM p) SELECT code, date, row_number() OVER ({D} ORDER BY s DESC, code) AS place FROM s")
def pool_rerank(t: Tables) -> DataFrame:
    pool = t.predictions.withColumn("rn", F.row_number().over(wd().orderBy(F.desc("ridge_pred"), "code"))).filter("rn <= 8")
    s = pool.select("code", "date", (cross.zscore("ridge_pred", True, True) + 0.5 * cross.zscore("lgbm_pred", True, True)).alias("s"))
    return s.select("code", "date", F.row_number().over(wd().orderBy(F.desc("s"), "code")).alias("place"))


@query("x21_state", "SELECT date, count(ridge_pred) AS n, stddev_pop(ridge_pred) AS dispersion, (list_avg(list_reverse_sort(list(ridge_pred))[1:2]) - median(ridge_pred)) / nullif(stddev_pop(ridge_pred), 0) AS lead FROM predictions GROUP BY date")
def state(t: Tables) -> DataFrame:
    top = F.slice(F.sort_array(F.collect_list("ridge_pred"), asc=False), 1, 2)
    mean = F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / F.size(top)
    d = F.stddev_pop("ridge_pred")
    return t.predictions.groupBy("date").agg(F.count("ridge_pred").alias("n"), d.alias("dispersion"), F.try_divide(mean - F.median("ridge_pred"), F.nullif(d, F.lit(0.0))).alias("lead"))


@query("x22_live_rank", f"WITH p AS (SELECT * FROM predictions WHERE date = (SELECT max(date) FROM predictions)), s AS (SELECT code, ridge_pred + lgbm_pred AS score, row_number() OVER (ORDER BY ridge_pred + lgbm_pred DESC, code) AS place, count(*) OVER () AS n FROM p) SELECT code, score, place, CASE WHEN n > 1 THEN 1 - (place - 1) / (n - 1) END AS rank_pct FROM s")
def live_rank(t: Tables) -> DataFrame:
    p = t.predictions
    last = p.join(F.broadcast(p.agg(F.max("date").alias("date"))), "date").withColumn("score", F.col("ridge_pred") + F.col("lgbm_pred"))
    s = last.select("code", "score", F.row_number().over(wd().orderBy(F.desc("score"), "code")).alias("place"), F.count("*").over(wd()).alias("n"))
    return s.select("code", "score", "place", F.when(F.col("n") > 1, 1 - (F.col("place") - 1) / (F.col("n") - 1)).alias("rank_pct"))


@query("x24_labels", f"SELECT code, date, CASE WHEN p >= 0.9 THEN 'strong' WHEN p >= 0.6 THEN 'watch' WHEN p >= 0.3 THEN 'hold' ELSE 'avoid' END AS label FROM (SELECT code, date, {rank('ridge_pred')} / count(*) OVER ({D}) AS p FROM predictions)")
def labels(t: Tables) -> DataFrame:
    p = F.col("p")
    x = t.predictions.select("code", "date", cross.rank_pct("ridge_pred").alias("p"))
    return x.select("code", "date", F.when(p >= 0.9, "strong").when(p >= 0.6, "watch").when(p >= 0.3, "hold").otherwise("avoid").alias("label"))


@query("x25_candidates", f"WITH r AS (SELECT date, code, industry, row_number() OVER ({D} ORDER BY ridge_pred DESC, code) AS a, row_number() OVER (PARTITION BY date, industry ORDER BY ridge_pred DESC, code) AS b FROM predictions JOIN securities USING (code)) SELECT date, code, 'all' AS grp, a AS place FROM r WHERE a <= 5 UNION ALL SELECT date, code, industry, b FROM r WHERE b <= 2")
def candidates(t: Tables) -> DataFrame:
    p = t.predictions.join(t.securities, "code")
    r = p.select("date", "code", "industry", F.row_number().over(wd().orderBy(F.desc("ridge_pred"), "code")).alias("a"), F.row_number().over(Window.partitionBy("date", "industry").orderBy(F.desc("ridge_pred"), "code")).alias("b"))
    return r.filter("a <= 5").select("date", "code", F.lit("all").alias("grp"), F.col("a").alias("place")).union(r.filter("b <= 2").select("date", "code", "industry", "b"))


@query("x30_sector_strength", "SELECT b.date, s.industry, avg(b.close / b.open - 1) AS strength, count(*) AS n FROM bars b JOIN securities s USING (code) GROUP BY ALL")
def sector_strength(t: Tables) -> DataFrame:
    return t.bars.join(t.securities, "code").groupBy("date", "industry").agg(F.avg(F.col("close") / F.col("open") - 1).alias("strength"), F.count("*").alias("n"))
