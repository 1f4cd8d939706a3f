"""Choosing between parameters, legs and weights: grids, promotion on a holdout, walk-forward weights, lookups.

What is evaluated comes in with one row per date and candidate; the tables of candidates are parameters and small by
construction. Windows over dates alone order one row per date.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.rolling import wd
from tessera.operators.portfolio import return_metrics

#: Digits to which figures are compared, so that the order of a sum decides nothing.
DIGITS = 9
# The parameter grids.
SHORT = {
    "ic_weight": [0.0, 0.03, 0.06, 0.10, 0.15],
    "top_n": [1, 2, 3, 4, 5],
    "gross_exposure": [0.18, 0.24, 0.30],
    "ridge_quantile": [0.45, 0.50, 0.55, 0.60, 0.65, 0.70],
    "pred_quantile": [None, 0.50, 0.55, 0.60, 0.65, 0.70],
    "naive_weight": [0.0, 0.1, 0.2],
}
SWING = {
    "ic_weight": [0.0, 0.05, 0.10, 0.15],
    "max_weight": [0.07, 0.08, 0.09, 0.10],
    "ridge_quantile": [0.30, 0.35, 0.40, 0.45],
    "pred_quantile": [None, 0.55, 0.60],
    "naive_weight": [0.0, 0.1, 0.2],
}


def parameter_grid(spark: SparkSession, kind: str, template: DataFrame | None = None) -> DataFrame:
    """All combinations of a grid ("short": 8,100, "swing": 576), with the rows of a template that it lacks."""
    choices = SHORT if kind == "short" else SWING
    out = spark.range(1).select()
    for name, values in choices.items():
        items = F.array(*(F.lit(v).cast("int" if name == "top_n" else "double") for v in values))
        out = out.select("*", F.explode(items).alias(name))
    if kind == "short":
        out = out.withColumn("slot_weight", F.col("gross_exposure") / F.col("top_n"))
    if template is None:
        return out
    known = [c for c in out.columns if c in template.columns]
    more = template.select(*known).distinct()
    return out.unionByName(more, allowMissingColumns=True).distinct()


def slots_filled(pred: DataFrame, grid: DataFrame, ridge: str, leg: str, least: int = 5) -> DataFrame:
    """For each row of a grid the days on which its two filters leave at least ``top_n`` names, and the slots they fill.

    The filters of all rows are few pairs of quantiles: what each pair leaves is counted once per date, the counts become a
    histogram, and only that meets the grid; the panel never does.
    """
    cuts = [r for r in grid.select("ridge_quantile", "pred_quantile").distinct().collect()]
    first = sorted({r.ridge_quantile for r in cuts})
    then = sorted({r.pred_quantile for r in cuts}, key=lambda q: (q is not None, q))
    n = F.count(ridge).over(wd())
    alive = pred.select("date", F.col(ridge).alias("x"), F.col(leg).alias("y"), n.alias("n"), F.percentile(ridge, F.array(*map(F.lit, first))).over(wd()).alias("cut"))
    alive = alive.select("date", "x", "y", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, first)).alias("ridge_quantile"), "cut")).alias("c"))
    alive = alive.filter((F.col("n") < least) | (F.col("x") >= F.col("c.cut"))).select("date", F.col("c.ridge_quantile").alias("ridge_quantile"), "y")
    part = Window.partitionBy("date", "ridge_quantile")
    known = [q for q in then if q is not None]
    alive = alive.select("date", "ridge_quantile", "y", F.count("y").over(part).alias("n"), F.percentile("y", F.array(*map(F.lit, known))).over(part).alias("cut"))
    left = [F.struct(F.lit(q).cast("double").alias("pred_quantile"), F.count("*" if q is None else F.when((F.col("n") < least) | (F.col("y") >= F.col("cut")[known.index(q)]), 1)).alias("left")) for q in then]
    days = alive.groupBy("date", "ridge_quantile").agg(F.array(*left).alias("all")).select("ridge_quantile", F.explode("all").alias("a")).select("ridge_quantile", "a.*")
    often = days.groupBy("ridge_quantile", "pred_quantile", "left").agg(F.count("*").alias("days")).withColumnsRenamed({"ridge_quantile": "__r", "pred_quantile": "__p"})
    met = grid.join(often, (F.col("ridge_quantile") == F.col("__r")) & F.col("pred_quantile").eqNullSafe(F.col("__p")))
    return met.groupBy(*grid.columns).agg(F.sum(F.when(F.col("left") >= F.col("top_n"), F.col("days")).otherwise(0)).alias("full_days"), F.sum(F.least("left", "top_n") * F.col("days")).alias("slots"))


def holdout_boundaries(train_end: str, valid_end: str, predict_start: str) -> tuple[dt.date, dt.date, dt.date]:
    """The three boundaries as dates; an error where one lacks or they are not strictly in order."""
    if not all((train_end, valid_end, predict_start)):
        raise ValueError("train_end, valid_end and predict_start are all needed")
    a, b, c = (dt.date.fromisoformat(x) for x in (train_end, valid_end, predict_start))
    if not a < b < c:
        raise ValueError("train_end < valid_end < predict_start is needed")
    return a, b, c


def promotion_trials(returns: DataFrame, boundary: str, baseline: int, trials: int, least_gain: float = 0.1, most_worse: float = 0.02) -> DataFrame:
    """(trial, param_id, selection_sharpe, sharpe_gain, dd_change, promote, chosen): the best parameters before a boundary,
    in their order, against a baseline after it; the first that passes is chosen."""
    early = return_metrics(returns.filter(F.col("date") < F.lit(boundary).cast("date")), ["param_id"])
    late = return_metrics(returns.filter(F.col("date") >= F.lit(boundary).cast("date")), ["param_id"])
    nth = Window.orderBy(F.round("sharpe", DIGITS).desc_nulls_last(), "param_id")
    best = early.select("param_id", F.col("sharpe").alias("selection_sharpe"), F.row_number().over(nth).alias("trial")).filter(F.col("trial") <= trials)
    base = late.filter(F.col("param_id") == baseline).select(F.col("sharpe").alias("b_sharpe"), F.col("max_dd").alias("b_dd"))
    out = best.join(late, "param_id").crossJoin(F.broadcast(base)).select("trial", "param_id", "selection_sharpe", (F.col("sharpe") - F.col("b_sharpe")).alias("sharpe_gain"), (F.col("max_dd") - F.col("b_dd")).alias("dd_change"))
    out = out.withColumn("promote", F.coalesce((F.round("sharpe_gain", DIGITS) >= least_gain) & (F.col("dd_change") >= -most_worse), F.lit(False)))
    return out.withColumn("chosen", F.col("promote") & (F.sum(F.col("promote").cast("int")).over(Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)) == 1))


def optional_leg(returns: DataFrame, params: DataFrame, boundary: str, weight: str, most_worse: float = 0.02) -> DataFrame:
    """(weight, selection_sharpe, selection_dd, holdout_sharpe, holdout_dd, selected): the weight of a leg with the best Sharpe
    before a boundary, where it beats weight 0 and its drawdown is not much worse; 0 where none does."""
    early, late = (return_metrics(returns.filter(c), ["param_id"]).select("param_id", F.col("sharpe").alias(f"{n}_sharpe"), F.col("max_dd").alias(f"{n}_dd")) for n, c in (("selection", F.col("date") < F.lit(boundary).cast("date")), ("holdout", F.col("date") >= F.lit(boundary).cast("date"))))
    m = params.select("param_id", F.col(weight).alias("weight")).join(early, "param_id").join(late, "param_id", "left")
    base = m.filter("weight = 0").select(F.col("selection_sharpe").alias("bs"), F.col("selection_dd").alias("bd"))
    ok = (F.col("weight") > 0) & (F.round("selection_sharpe", DIGITS) > F.round("bs", DIGITS)) & (F.col("selection_dd") >= F.col("bd") - most_worse)
    m = m.crossJoin(F.broadcast(base)).withColumn("__rank", F.when(F.coalesce(ok, F.lit(False)), F.round("selection_sharpe", DIGITS)))
    nth = F.row_number().over(Window.orderBy(F.desc_nulls_last("__rank"), "weight"))
    return m.select("weight", "selection_sharpe", "selection_dd", "holdout_sharpe", "holdout_dd", (nth == 1).alias("selected"))


def leg_over_horizons(frame: DataFrame, base: str, leg: str, labels: Mapping[int, str], weights: Sequence[float], boundary: str, top_n: int = 5) -> DataFrame:
    """(weight, selection_sharpe, holdout_sharpe, holdout_worst, selected, confirmed): the mean Sharpe over horizons of the
    top n by base + weight * leg. The best weight before the boundary is selected where it beats weight 0, else 0; it is
    confirmed where it beats weight 0 behind the boundary, too. Labels of h sessions count by 1/h; a null leg adds nothing.

    The panel is ranked once for each weight and horizon (a dozen); one row for each date goes on."""
    scored = [(h, w, F.round(F.col(base) + w * F.coalesce(leg, F.lit(0.0)), DIGITS)) for h in labels for w in weights]
    picks = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(float(w)).alias("weight"), s.alias("score"), (F.col(labels[h]) / h).alias("net")) for h, w, s in scored))
    long = frame.select("date", "code", F.explode(picks).alias("p")).select("date", "code", "p.*").filter("net is not null")
    nth = F.row_number().over(Window.partitionBy("horizon", "weight", "date").orderBy(F.desc("score"), "code"))
    day = long.withColumn("__n", nth).filter(F.col("__n") <= top_n).groupBy("horizon", "weight", "date").agg(F.avg("net").alias("net"))
    early = F.col("date") < F.lit(boundary).cast("date")
    sharpe = lambda x: F.try_divide(F.avg(x) * 252, F.nullif(F.stddev_samp(x) * 252**0.5, F.lit(0.0)))
    by_h = day.groupBy("horizon", "weight").agg(sharpe(F.when(early, F.col("net"))).alias("sel"), sharpe(F.when(~early, F.col("net"))).alias("hld"))
    m = by_h.groupBy("weight").agg(F.avg("sel").alias("selection_sharpe"), F.avg("hld").alias("holdout_sharpe"), F.min("hld").alias("holdout_worst"))
    base_row = m.filter("weight = 0").select(F.col("selection_sharpe").alias("__bs"), F.col("holdout_sharpe").alias("__bh"))
    m = m.crossJoin(F.broadcast(base_row))  # one row
    better = (F.col("weight") > 0) & (F.round("selection_sharpe", DIGITS) > F.round("__bs", DIGITS))
    first = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.when(better, F.round("selection_sharpe", DIGITS))), "weight")) == 1
    m = m.withColumn("selected", first)
    holds = F.coalesce(F.round("holdout_sharpe", DIGITS) > F.round("__bh", DIGITS), F.lit(False))
    return m.select("weight", "selection_sharpe", "holdout_sharpe", "holdout_worst", "selected", (F.col("selected") & (F.col("weight") > 0) & holds).alias("confirmed"))


def walk_forward_weights(pred: DataFrame, one: str, two: str, label: str, train_days: int = 60, every: int = 5) -> DataFrame:
    """(date, weight): the least-squares weight of ``two`` beside 1 - weight of ``one``, within 0 and 1, refitted every few
    dates on the ``train_days`` dates before. The sums of a date are one aggregate; the windows are over dates alone."""
    d = F.col(two) - F.col(one)
    day = pred.groupBy("date").agg(F.sum(d * (F.col(label) - F.col(one))).alias("num"), F.sum(d * d).alias("den"))
    order = Window.orderBy("date")
    before = order.rowsBetween(-train_days, -1)
    day = day.select("date", (F.row_number().over(order) - 1).alias("i"), F.sum("num").over(before).alias("num"), F.sum("den").over(before).alias("den"))
    fit = F.coalesce(F.try_divide("num", F.nullif("den", F.lit(0.0))), F.lit(0.5))
    fit = F.when((F.col("i") >= train_days) & ((F.col("i") - train_days) % every == 0), F.greatest(F.least(fit, F.lit(1.0)), F.lit(0.0)))
    held = F.last(fit, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return day.select("date", "i", held.alias("weight")).filter(F.col("i") >= train_days).drop("i")


def top_mean(score: Column, label: str, n: int, name: str) -> tuple[Column, Column]:
    """The rank column of a score within its date, and the mean of ``label`` over the first n of it."""
    return F.row_number().over(wd().orderBy(score.desc(), "code")).alias(f"__{name}"), F.avg(F.when(F.col(f"__{name}") <= n, F.col(label))).alias(name)


def weighted_days(pred: DataFrame, weights: DataFrame, one: str, two: str, label: str, top_n: int = 10, cost: float = 0.002, fixed: float = 0.5) -> DataFrame:
    """(date, weight, candidate, baseline): mean return of the top n by the date's weight and by a fixed one, less cost."""
    blend = lambda w: (1 - w) * F.col(one) + w * F.col(two)
    (r1, a1), (r2, a2) = top_mean(blend(F.col("weight")), label, top_n, "candidate"), top_mean(blend(F.lit(fixed)), label, top_n, "baseline")
    day = pred.join(weights, "date").select("date", "weight", label, r1, r2).groupBy("date", "weight").agg(a1, a2)
    return day.select("date", "weight", (F.col("candidate") - cost).alias("candidate"), (F.col("baseline") - cost).alias("baseline"))


def weight_gate(day: DataFrame, fixed: float = 0.5, least_days: int = 120, sharpe_gain: float = 0.1, hit_delta: float = 0.0, most_worse: float = 0.02, most_step: float = 0.2, last: int = 20) -> DataFrame:
    """One row: why the candidate's weights are not promoted (empty: they are), and whether its last days call for a
    rollback, that is, have a lower mean and a lower total than the baseline's. A side without figures fails every gate; an empty
    table gives one row with all reasons but the Sharpe's, which needs a baseline."""
    long = day.unpivot(["date"], ["candidate", "baseline"], "run", "net")
    m = return_metrics(long, ["run"]).join(long.groupBy("run").agg(F.avg("net").alias("mean")), "run")
    side = {r: F.max(F.when(F.col("run") == r, F.struct("n", "mean", "sharpe", "win_rate", "max_dd"))).alias(r) for r in ("candidate", "baseline")}
    m = m.agg(*side.values())
    nth = F.row_number().over(Window.orderBy(F.desc("date")))
    total = lambda c: (F.exp(F.sum(F.log1p(F.greatest(F.col(c), F.lit(-0.99))))) - 1)
    recent = day.withColumn("k", nth).filter(F.col("k") <= last).agg(F.count("*").alias("k"), F.max_by("weight", "date").alias("weight"), total("candidate").alias("current_return"), total("baseline").alias("previous_return"), F.avg("candidate").alias("a"), F.avg("baseline").alias("b"))
    c, b = (lambda f: F.col(f"candidate.{f}")), (lambda f: F.col(f"baseline.{f}"))
    reasons = {
        "insufficient_oos_days": c("n") < least_days,
        "mean_return_not_improved": c("mean") <= b("mean"),
        "sharpe_not_improved": b("sharpe").isNotNull() & F.coalesce(c("sharpe") < b("sharpe") + sharpe_gain, F.lit(True)),
        "hit_rate_gate": c("win_rate") < b("win_rate") + hit_delta,
        "drawdown_gate": c("max_dd") < b("max_dd") - most_worse,
        "weight_step_gate": F.abs(F.col("weight") - fixed) > most_step,
    }
    # what can't be compared is not promoted
    why = F.concat_ws(",", *(F.when(F.coalesce(test, F.lit(name != "sharpe_not_improved")), F.lit(name)) for name, test in reasons.items()))
    back = (F.col("k") >= last) & (F.col("a") < F.col("b")) & (F.col("current_return") < F.col("previous_return"))
    return m.crossJoin(F.broadcast(recent)).select(F.coalesce(c("n"), F.lit(0)).alias("days"), why.alias("reasons"), F.coalesce(back, F.lit(False)).alias("rollback"), "current_return", "previous_return")


def lookup(evaluated: DataFrame, asked: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """The rows of an evaluation (keys, horizon, sharpe) that have the asked keys (``ask_<key>``); where none has, the best of
    each horizon. ``recommended`` marks the best horizon of each request. Both tables are of parameters, and small."""
    by = [f"ask_{k}" for k in keys]
    x = evaluated.crossJoin(F.broadcast(asked))
    hit = F.lit(True)
    for k in keys:
        hit = hit & F.coalesce(F.abs(F.col(k) - F.col(f"ask_{k}")) < tolerance, F.col(k).isNull() & F.col(f"ask_{k}").isNull())
    x = x.withColumn("matched", hit)
    x = x.withColumn("__any", F.max("matched").over(Window.partitionBy(*by))).withColumn("__n", F.row_number().over(Window.partitionBy(*by, "horizon").orderBy(F.desc_nulls_last("sharpe"), *keys)))
    x = x.filter(F.when(F.col("__any"), F.col("matched")).otherwise(F.col("__n") == 1)).drop("__any", "__n")
    return x.withColumn("recommended", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("sharpe"), "horizon", *keys)) == 1)


def stability(day: DataFrame, least_gain: float = 0.5, most_decline: float = 0.5) -> DataFrame:
    """From (horizon, date, candidate, baseline), per horizon: Sharpe on every h-th date of both, its gain, whether that is
    significant and within the allowed decline, and the months that the candidate wins."""
    nth = F.row_number().over(Window.partitionBy("horizon").orderBy("date")) - 1
    day = day.withColumn("__own", nth % F.col("horizon") == 0)
    year = 252 / F.col("horizon")

    def sharpe(c: str) -> Column:
        x = F.when(F.col("__own"), F.greatest(F.col(c), F.lit(-0.99)))
        return F.try_divide(F.exp(F.sum(F.log1p(x)) * year / F.count(x)) - 1, F.nullif(F.stddev_samp(x) * F.sqrt(year), F.lit(0.0)))

    main = day.groupBy("horizon").agg(F.count_if("__own").alias("n"), sharpe("candidate").alias("candidate_sharpe"), sharpe("baseline").alias("baseline_sharpe"))
    month = day.groupBy("horizon", F.date_format("date", "yyyy-MM").alias("month")).agg(*(F.sum(F.log1p(F.greatest(F.col(c), F.lit(-0.99)))).alias(c) for c in ("candidate", "baseline")))
    wins = month.groupBy("horizon").agg(F.count_if(F.col("candidate") > F.col("baseline")).alias("monthly_wins"), F.count("*").alias("months"))
    gain = F.col("candidate_sharpe") - F.col("baseline_sharpe")
    return main.join(wins, "horizon").select("*", gain.alias("sharpe_gain"), F.coalesce(gain >= least_gain, F.lit(False)).alias("significant"), F.coalesce(gain >= -most_decline, F.lit(False)).alias("acceptable"))


def first_column(columns: Sequence[str], patterns: Sequence[str]) -> Column:
    """The first column that the first matching pattern finds; null where none matches any."""
    for p in patterns:
        for c in columns:
            if re.search(p, c):
                return F.col(c)
    return F.lit(None).cast("double")


def feature_groups(columns: Sequence[str], rules: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The columns of each group whose name holds one of its parts; groups without columns are left out."""
    found = {name: [c for c in columns if any(p in c for p in parts)] for name, parts in rules.items()}
    return {name: cs for name, cs in found.items() if cs}


def selection_manifest(chosen: DataFrame, label: str, train_end: str, valid_end: str, predict_start: str) -> DataFrame:
    """One row on a selection of factors (one row each, few by construction): label, boundaries, count and digest of the names."""
    names = F.array_join(F.array_sort(F.collect_list("factor")), "\n")
    return chosen.agg(F.lit(label).alias("label_col"), F.lit(train_end).alias("train_end"), F.lit(valid_end).alias("valid_end"), F.lit(predict_start).alias("predict_start"), F.count("*").alias("selected_count"), F.sha2(names, 256).alias("selected_sha256"))


def provenance_faults(manifest: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """The rows of a manifest with their ``faults``, joined by commas: more than one row, another label, another number or
    digest of factors, boundaries out of order."""
    now = selection_manifest(chosen, label, "", "", "").select(F.col("selected_count").alias("__n"), F.col("selected_sha256").alias("__h"))
    rows = manifest.agg(F.count("*").alias("__rows"))  # one row, as the one above
    x = manifest.crossJoin(F.broadcast(now)).crossJoin(F.broadcast(rows))
    ordered = F.coalesce((F.to_date("train_end") < F.to_date("valid_end")) & (F.to_date("valid_end") < F.to_date("predict_start")), F.lit(False))
    tests = {"rows": F.col("__rows") != 1, "label": ~F.col("label_col").eqNullSafe(label), "count": ~F.col("selected_count").eqNullSafe(F.col("__n")), "digest": ~F.col("selected_sha256").eqNullSafe(F.col("__h")), "boundaries": ~ordered}
    return x.withColumn("faults", F.concat_ws(",", *(F.when(t, F.lit(n)) for n, t in tests.items()))).drop("__n", "__h", "__rows")
