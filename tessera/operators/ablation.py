"""Which groups of features a ridge gains from: greedy forward selection on one period, confirmation on a later one.

The training rows of a period are read once: all features' products are one aggregate of k * k numbers, and every subset is
the solution of a part of that matrix. A step scores all its candidates over the test rows in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cross import avg_rank, correlation
from tessera.operators.portfolio import return_metrics


@dataclass(frozen=True)
class Period:
    """Rows before ``train_end`` train, but for the last dates whose labels reach it; rows of [start, end) test."""

    train_end: str
    start: str
    end: str


def _between(a: str | None, b: str) -> object:
    before = F.col("date") < F.lit(b).cast("date")
    return before & (F.col("date") >= F.lit(a).cast("date")) if a else before


def products(df: DataFrame, features: Sequence[str], label: str, train_end: str, horizon: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Covariance sums of features and label over the rows before a boundary, their means, and how many rows there are. The
    last ``horizon`` dates before it are left out, as their labels reach it; rows with any null, too."""
    cols = [*features, label]
    early = df.filter(_between(None, train_end))
    last = early.select("date").distinct().orderBy(F.desc("date")).limit(horizon).agg(F.min("date").alias("d")).first()["d"]
    rows = (early.filter(F.col("date") < F.lit(last)) if last is not None else early).dropna(subset=cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    r = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    n, gram = r["n"], np.zeros((len(cols), len(cols)))
    if n:
        for i, j in pairs:
            gram[i, j] = gram[j, i] = n * r[f"c{i}_{j}"]
    return gram, np.array([r[f"m{i}"] or 0.0 for i in range(len(cols))]), n


def sub_solve(gram: np.ndarray, mean: np.ndarray, at: Sequence[int], alpha: float) -> tuple[np.ndarray, float]:
    """Ridge coefficients and intercept of a subset of the features; the label is the matrix's last row."""
    at = list(at)
    beta = np.linalg.solve(gram[np.ix_(at, at)] + alpha * np.eye(len(at)), gram[at, -1]) if at else np.zeros(0)
    return beta, float(mean[-1] - beta @ mean[at])


def score_variants(df: DataFrame, variants: Mapping[str, tuple[Sequence[str], np.ndarray, float]], label: str, horizon: int, top_n: int, cost: float) -> tuple[dict[str, dict], DataFrame]:
    """For each variant the mean daily rank IC, Sharpe and drawdown over some rows, and its daily net returns. The variants of
    a step are columns of one pass; a day's net is the mean label of its first ``top_n`` by h, less cost."""
    pred = lambda fs, beta, bias: F.lit(bias) + sum((float(b) * F.col(f) for f, b in zip(fs, beta, strict=True)), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(name).alias("variant"), F.round(pred(*v), 12).alias("pred")) for name, v in variants.items()))
    features = sorted({f for fs, _, _ in variants.values() for f in fs})
    rows = df.dropna(subset=[*features, label]).select("date", "code", F.col(label).alias("y"), F.explode(each).alias("v")).select("date", "code", "y", "v.*")
    by = ("variant", "date")
    ranked = rows.select(*by, "code", "y", avg_rank("pred", by).alias("a"), avg_rank("y", by).alias("b"), F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pred"), "code")).alias("n"))
    day = ranked.groupBy(*by).agg(correlation("a", "b").alias("ic"), (F.avg(F.when(F.col("n") <= top_n, F.col("y"))) / horizon - cost).alias("net")).cache()
    m = return_metrics(day, ["variant"]).join(day.groupBy("variant").agg(F.avg("ic").alias("rank_ic")), "variant")
    return {r["variant"]: r.asDict() for r in m.collect()}, day


def monthly_win_rate(day: DataFrame, candidate: str, baseline: DataFrame, base: str) -> float | None:
    """In which share of the months that both have the candidate compounds to more."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    total = lambda d, v, name: d.filter(F.col("variant") == v).groupBy(month).agg(F.sum(F.log1p(F.greatest("net", F.lit(-0.99)))).alias(name))
    both = total(day, candidate, "a").join(total(baseline, base, "b"), "month")
    return both.agg(F.avg((F.col("a") > F.col("b")).cast("double"))).first()[0]


def _compare(c: dict | None, b: dict | None, wins: float | None) -> dict:
    if c is None or b is None:
        return {"rank_ic_gain": None, "sharpe_gain": None, "monthly_win_rate": None, "drawdown_change": None}
    gap = lambda k: (c[k] or 0.0) - (b[k] or 0.0)
    return {"rank_ic_gain": gap("rank_ic"), "sharpe_gain": gap("sharpe"), "monthly_win_rate": wins, "drawdown_change": None if c["max_dd"] is None or b["max_dd"] is None else gap("max_dd")}


def passes(m: dict, sharpe: float, wins: float, worse: float) -> bool:
    """Whether a comparison gains rank IC and keeps within the limits; what is missing fails."""
    return bool((m["rank_ic_gain"] or 0.0) > 0 and (m["sharpe_gain"] or 0.0) >= sharpe and (m["monthly_win_rate"] or 0.0) >= wins and m["drawdown_change"] is not None and m["drawdown_change"] >= -worse)


STEP = "stage string, step int, `group` string, rank_ic_gain double, sharpe_gain double, monthly_win_rate double, drawdown_change double, passed boolean, winner boolean"


def forward_groups(df: DataFrame, base: Sequence[str], groups: Mapping[str, Sequence[str]], label: str, horizon: int, selection: Period, confirmation: Period, alpha: float = 10.0, top_n: int = 3, cost: float = 0.002, most: int = 3) -> DataFrame:
    """One row per candidate of each step against the step before, then one of all selected groups against the base features in
    the confirmation period (``group``: their names). A step's winner passes the selection limits with the best IC gain plus
    a hundredth of the Sharpe gain (ties by name); without one the selection ends, and nothing is confirmed without any.

    Without training rows nothing passes. Groups are few, and each step is one job over the test rows; what ``df`` is made
    from is read once."""
    names = [*base, *(f for fs in groups.values() for f in fs)]
    at = {f: i for i, f in enumerate(names)}

    def fitted(p: Period, features: Sequence[str], sums: tuple) -> tuple:
        gram, mean, _ = sums
        return features, *sub_solve(gram, mean, [at[f] for f in features], alpha)

    # every job below reads these rows, which may stand at the end of a long plan: it runs once
    df = df.select("date", "code", *dict.fromkeys([*names, label])).persist()
    out: list[tuple] = []
    sums = products(df, names, label, selection.train_end, horizon)
    test = df.filter(_between(selection.start, selection.end))
    chosen: list[str] = []
    if sums[2]:
        found, base_days = score_variants(test, {"": fitted(selection, base, sums)}, label, horizon, top_n, cost)
        current, name, left = found.get(""), "", list(groups)
        for step in range(1, most + 1):
            if not left:
                break
            tried = {g: fitted(selection, [*base, *(f for c in (*chosen, g) for f in groups[c])], sums) for g in left}
            found, days = score_variants(test, tried, label, horizon, top_n, cost)
            rows = {g: _compare(found.get(g), current, monthly_win_rate(days, g, base_days, name)) for g in left}
            good = {g: m["rank_ic_gain"] + 0.01 * m["sharpe_gain"] for g, m in rows.items() if passes(m, 0.0, 0.50, 0.03)}
            winner = min(good, key=lambda g: (-good[g], g)) if good else None
            out += [("selection", step, g, *m.values(), g in good, g == winner) for g, m in rows.items()]
            if winner is None:
                break
            chosen.append(winner)
            left.remove(winner)
            current, base_days, name = found[winner], days, winner
    result, sums = _compare(None, None, None), products(df, names, label, confirmation.train_end, horizon)
    if chosen and sums[2]:
        test = df.filter(_between(confirmation.start, confirmation.end))
        both = {"base": fitted(confirmation, base, sums), "all": fitted(confirmation, [*base, *(f for c in chosen for f in groups[c])], sums)}
        found, days = score_variants(test, both, label, horizon, top_n, cost)
        result = _compare(found.get("all"), found.get("base"), monthly_win_rate(days, "all", days, "base"))
    ok = passes(result, 0.10, 0.55, 0.02)
    out.append(("confirmation", 0, ",".join(chosen), *result.values(), ok, ok))
    df.unpersist()
    return df.sparkSession.createDataFrame(out, STEP)
