"""Legs that are weighted by the state of a day: thresholds frozen on a selection period, tested behind it.

A gate turns a feature of the day (no label in it) into one of two weights. The days' portfolios depend on the weight alone,
so each of the few weights is ranked once; a gate is a table of one weight per date that picks among them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rolling import wd
from tessera.operators.portfolio import return_metrics

#: Digits to which scores, features and figures are compared, so that the order of a sum decides nothing.
DIGITS, STATE_DIGITS = 9, 12
GATE = "gate int, family string, feature string, quantile double, high double, low double"


def gate_table(spark) -> DataFrame:
    """Constant weights in the pool (4), the pool's gates (9), the whole list's baseline and gates (1 + 24)."""
    rows = [("pool", "always", None, w, w) for w in (0.0, 0.03, 0.05, 0.10)]
    rows += [("pool", f, q, 0.05, 0.0) for f, q in product(("pool_coverage", "pool_dispersion", "pool_gap_z"), (0.6, 0.7, 0.8))]
    rows += [("full", "always", None, 0.0, 0.0)]
    rows += [("full", f, q, hi, lo) for f, q, hi, lo in product(("dispersion_ratio", "gap_z"), (0.5, 0.6, 0.7), (0.05, 0.10), (0.0, 0.03))]
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], GATE)


def in_pool(champion: str, size: int) -> Column:
    """Whether a row is among the first of its date by a positive champion's score; ties by code."""
    nth = F.row_number().over(wd().orderBy(F.desc_nulls_last(F.when(F.col(champion) > 0, F.round(champion, DIGITS))), "code"))
    return F.coalesce((F.col(champion) > 0) & (nth <= size), F.lit(False))


def state_features(frame: DataFrame, champion: str, leg: str, size: int, trailing: int = 60, least: int = 20) -> DataFrame:
    """(date, pool_coverage, pool_dispersion, pool_gap_z, dispersion_ratio, gap_z): coverage of the leg in the pool, its
    population deviation, how far the mean of its two best lies above the median in such deviations (0 if that is 0), and for
    all rows the deviation against the median of the dates before. Empty pools give no pool features."""

    def of(x: Column) -> tuple[Column, Column]:
        spread = F.stddev_pop(x)
        best = F.slice(F.sort_array(F.collect_list(x), asc=False), 1, 2)
        gap = F.aggregate(best, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(best), F.lit(0)) - F.median(x)
        return spread, F.when(spread > 1e-12, gap / spread).when(F.count(x) > 0, 0.0)

    own = frame.select("date", F.col(leg).alias("x"), in_pool(champion, size).alias("p"))
    pooled = F.when(F.col("p"), F.col("x"))
    (s1, g1), (s2, g2) = of(pooled), of(F.col("x"))
    cover = F.try_divide(F.count(pooled), F.nullif(F.count_if("p"), F.lit(0)))
    day = own.groupBy("date").agg(cover.alias("pool_coverage"), s1.alias("pool_dispersion"), g1.alias("pool_gap_z"), s2.alias("s"), g2.alias("gap_z"))
    before = Window.orderBy("date").rowsBetween(-trailing, -1)  # one row per date
    usual = F.when(F.count("s").over(before) >= least, F.percentile("s", 0.5).over(before))
    day = day.withColumn("dispersion_ratio", F.try_divide("s", F.nullif(usual, F.lit(0.0))))
    names = ("pool_coverage", "pool_dispersion", "pool_gap_z", "dispersion_ratio", "gap_z")
    return day.select("date", *(F.round(n, STATE_DIGITS).alias(n) for n in names))


def daily_weights(states: DataFrame, gates: DataFrame, boundary: str) -> DataFrame:
    """(gate, family, date, early, threshold, weight): the high weight where the feature reaches its quantile over the dates
    before the boundary, else the low one. Gates on a feature without two values there are left out."""
    early = F.col("date") < F.lit(boundary).cast("date")
    features = [c for c in states.columns if c != "date"]
    long = states.unpivot(["date"], features, "feature", "value")
    seen = F.when(early, F.col("value"))
    qs = sorted({r[0] for r in gates.select("quantile").distinct().collect()} - {None})
    cut = long.groupBy("feature").agg(F.percentile(seen, F.array(*map(F.lit, qs))).alias("cuts"), F.count_distinct(seen).alias("kinds")).filter("kinds >= 2")
    cut = cut.select("feature", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("quantile"), "cuts")).alias("c")).select("feature", "c.quantile", F.round("c.cuts", STATE_DIGITS).alias("threshold"))
    gated = F.broadcast(gates.join(cut, ["feature", "quantile"]))  # a table of parameters
    weight = F.when(F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)), F.col("high")).otherwise(F.col("low"))
    out = long.join(gated, "feature").select("gate", "family", "date", early.alias("early"), "threshold", weight.alias("weight"))
    fixed = states.select("date").crossJoin(F.broadcast(gates.filter("quantile is null")))
    return out.union(fixed.select("gate", "family", "date", early.alias("early"), F.lit(None).cast("double").alias("threshold"), F.col("high").alias("weight")))


def weighted_picks(frame: DataFrame, champion: str, leg: str, labels: Mapping[int, str], weights: Sequence[float], size: int, top_n: int) -> DataFrame:
    """(family, weight, horizon, date, picks): the first (code, ret) by champion + weight * z of the leg, positive scores only;
    in the pool the z is the pool's and only it is ranked. A null or constant leg adds nothing."""
    p = frame.withColumn("__p", in_pool(champion, size))
    x = F.when(F.col("__p"), F.col(leg))

    def zed(v: Column) -> Column:
        spread = F.stddev_pop(v).over(wd())
        return F.coalesce(F.when(spread > 1e-12, (v - F.avg(v).over(wd())) / spread), F.lit(0.0))

    p = p.withColumns({"__zp": zed(x), "__zf": zed(F.col(leg))})
    one = lambda family, z, w, h, c: F.struct(F.lit(family).alias("family"), F.lit(float(w)).alias("weight"), F.lit(h).alias("horizon"), F.round(F.col(champion) + w * F.col(z), DIGITS).alias("score"), F.col(c).alias("ret"))
    some = [F.when(F.col("__p") if f == "pool" else F.lit(True), one(f, z, w, h, c)) for (f, z), w, (h, c) in product((("pool", "__zp"), ("full", "__zf")), weights, labels.items())]
    long = p.select("date", "code", F.explode(F.array_compact(F.array(*some))).alias("s")).select("date", "code", "s.*").filter("score > 0 and ret is not null")
    key = ["family", "weight", "horizon", "date"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "code"))
    return long.withColumn("n", nth).filter(F.col("n") <= top_n).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "code", "ret"))).alias("picks"))


def evaluate_gates(frame: DataFrame, champion: str, leg: str, labels: Mapping[int, str], gates: DataFrame, boundary: str, size: int = 10, top_n: int = 3, cost: float = 0.002, most_worse: float = 0.02) -> DataFrame:
    """One row per gate: threshold, mean Sharpe over horizons and worst drawdown on both sides of the boundary, whether its
    family selects it (best Sharpe before, above weight 0, drawdown not much worse), and whether it beats weight 0 behind, too.
    Both sides start without holdings; a slot is 1 / top_n; labels of h sessions count by 1/h."""
    daily = daily_weights(state_features(frame, champion, leg, size), gates, boundary)
    weights = sorted({v for r in gates.select("high", "low").distinct().collect() for v in r})
    picks = weighted_picks(frame, champion, leg, labels, weights, size, top_n)
    x = daily.join(picks, ["family", "weight", "date"])
    by = Window.partitionBy("gate", "early", "horizon").orderBy("date")
    codes = F.transform("picks", lambda v: v["code"])
    x = x.withColumn("now", codes).withColumn("was", F.coalesce(F.lag("now").over(by), F.array().cast("array<string>")))
    moved = (F.size("now") + F.size("was") - 2 * F.size(F.array_intersect("now", "was")) + F.abs(F.size("now") - F.size("was"))) / 2
    earned = F.aggregate(F.transform("picks", lambda v: v["ret"]), F.lit(0.0), lambda a, v: a + v)
    x = x.select("gate", "early", "horizon", "date", F.greatest((earned / F.col("horizon") - cost * moved) / top_n, F.lit(-0.99)).alias("net"))
    m = return_metrics(x, ["gate", "early", "horizon"])
    side = lambda c, early: F.when(F.col("early") == early, F.col(c))
    m = m.groupBy("gate").agg(F.avg(side("sharpe", True)).alias("selection_sharpe"), F.min(side("max_dd", True)).alias("selection_dd"), F.avg(side("sharpe", False)).alias("holdout_sharpe"), F.min(side("max_dd", False)).alias("holdout_dd"))
    cuts = daily.groupBy("gate").agg(F.max("threshold").alias("threshold"))
    m = gates.join(m, "gate").join(cuts, "gate")
    plain = m.filter("feature = 'always' and high = 0").select("family", F.col("selection_sharpe").alias("__s"), F.col("selection_dd").alias("__d"), F.col("holdout_sharpe").alias("__h"))
    m = m.join(F.broadcast(plain), "family")  # two rows
    ok = (F.round("selection_sharpe", DIGITS) > F.round("__s", DIGITS)) & (F.round("selection_dd", DIGITS) >= F.round(F.col("__d") - most_worse, DIGITS))
    nth = F.row_number().over(Window.partitionBy("family").orderBy(F.desc_nulls_last(F.when(ok, F.round("selection_sharpe", DIGITS))), "gate"))
    m = m.withColumn("selected", F.coalesce(ok, F.lit(False)) & (nth == 1))
    confirmed = F.col("selected") & F.coalesce(F.round("holdout_sharpe", DIGITS) > F.round("__h", DIGITS), F.lit(False))
    return m.select(*gates.columns, "threshold", "selection_sharpe", "selection_dd", "holdout_sharpe", "holdout_dd", "selected", confirmed.alias("confirmed"))
