"""Weights of several legs on the simplex: by clipped error over all rows, or by least squares in every window of a walk.

Clipped errors have no closed form. Each round scores all its candidates in one pass over the rows, so a fit is some dozens of
jobs that return one number per candidate, whatever the table's size. Least squares needs only the sums of products
of each date; its windows are sums over dates, and the three-leg solution on the simplex is an expression over them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rolling import wd


def on_simplex(w: np.ndarray) -> np.ndarray:
    """Non-negative, with sum 1; equal weights where nothing is left."""
    w = np.maximum(np.asarray(w, float), 0.0)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def losses(df: DataFrame, legs: Sequence[str], label: str, candidates: Sequence[np.ndarray], clip: float = 0.2) -> np.ndarray:
    """The mean squared error of each candidate, errors clipped, over rows where its blend (the weighted mean over the legs that
    have a value) and the label have one; infinite without such rows. Tasks add up all candidates in one pass over their rows,
    and only sums leave them."""
    weights = np.array(candidates, float).T

    def run(batches):
        total, n = np.zeros(weights.shape[1]), np.zeros(weights.shape[1], np.int64)
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            has = np.isfinite(x[:, :-1])
            down = has @ weights
            with np.errstate(divide="ignore", invalid="ignore"):
                error = np.where(has, x[:, :-1], 0.0) @ weights / down - x[:, -1:]
            ok = (down > 0) & np.isfinite(x[:, -1:])
            total += np.where(ok, np.clip(error, -clip, clip) ** 2, 0.0).sum(0)
            n += ok.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(total), pa.array(n)], ["i", "total", "n"])

    numbers = df.select(*(F.col(c).cast("double") for c in (*legs, label)))
    out = np.full(weights.shape[1], np.inf)
    for r in numbers.mapInArrow(run, "i long, total double, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").collect():
        out[r["i"]] = r["total"] / r["n"]
    return out


#: Steps of the descent that are tried at once.
STEPS = (0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0003, 0.0001)


def descend(df: DataFrame, legs: Sequence[str], label: str, start: Sequence[float] | None = None, rounds: int = 40, clip: float = 0.2) -> tuple[np.ndarray, float]:
    """Projected descent by finite differences: a round is one pass for the slope and one for all steps along it; it ends
    where no step gains."""
    k = len(legs)
    w = on_simplex(np.ones(k) if start is None else start)
    for _ in range(rounds):
        shifted = [on_simplex(w + 1e-4 * np.eye(k)[i]) for i in range(k)]
        at = losses(df, legs, label, [w, *shifted], clip)
        if not np.isfinite(at).all():
            return w, float(at[0])
        slope = (at[1:] - at[0]) / 1e-4
        size = np.abs(slope).max()
        if size == 0:
            return w, float(at[0])
        tried = [on_simplex(w - s * slope / size) for s in STEPS]
        found = losses(df, legs, label, tried, clip)
        if found.min() >= at[0] - 1e-15:
            return w, float(at[0])
        w = tried[int(found.argmin())]
    return w, float(losses(df, legs, label, [w], clip)[0])


def stack(df: DataFrame, legs: Sequence[str], label: str, start: Sequence[float] | None = None, generations: int = 12, size: int = 24, elite: int = 6, seed: int = 7, clip: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and loss: a descent, then generations of ``size`` candidates around the best ones, each scored in one pass
    over all rows; the spread shrinks from 0.1 to 0.001. The same rows and seed give the same weights. Without a row that
    has a label and a leg, the start (or equal weights) and an infinite loss."""
    k, rng = len(legs), np.random.default_rng(seed)
    begin = on_simplex(np.ones(k) if start is None else start)
    rows = df.select(*legs, label).cache()
    try:
        best, low = descend(rows, legs, label, begin, clip=clip)
        if not np.isfinite(low):
            return begin, low
        # a leg with weight 0 takes the rows with it that have no other, so corners are not what is near them
        people = [begin, best, *np.eye(k), *rng.dirichlet(np.ones(k), size=size - 2)]
        for g in range(generations):
            found = losses(rows, legs, label, people, clip)
            order = np.argsort(found, kind="stable")[:elite]
            if found[order[0]] < low:
                best, low = people[order[0]], float(found[order[0]])
            spread = 0.1 * 0.01 ** (g / max(generations - 1, 1))
            top = [people[i] for i in order]
            people = [best, *top]
            while len(people) < size:
                a, b = rng.integers(0, len(top), 2)
                people.append(on_simplex((top[a] + top[b]) / 2 + rng.normal(0, spread, k)))
        return best, low
    finally:
        rows.unpersist()


def simplex_weights(s: dict[str, Column]) -> Column:
    """An array of the three weights on the simplex with the least squares, from sums of u = x1 - x3, v = x2 - x3, r = y - x3
    (uu, uv, vv, ur, vr): the inner solution if it lies inside, else the best point of the three edges."""
    clip = lambda x: F.greatest(F.least(F.coalesce(x, F.lit(0.5)), F.lit(1.0)), F.lit(0.0))
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    uu, uv, vv, ur, vr = (s[k] for k in ("uu", "uv", "vv", "ur", "vr"))
    det = uu * vv - uv * uv
    a, b = ratio(ur * vv - vr * uv, det), ratio(vr * uu - ur * uv, det)
    inside = (det > 1e-12 * uu * vv) & (a >= 0) & (b >= 0) & (a + b <= 1)
    t = clip(ratio(ur - vr - uv + vv, uu - 2 * uv + vv))
    zero = F.lit(0.0)
    edges = [(clip(ratio(ur, uu)), zero), (zero, clip(ratio(vr, vv))), (t, 1 - t)]
    loss = lambda p, q: p * p * uu + 2 * p * q * uv + q * q * vv - 2 * p * ur - 2 * q * vr
    best = F.array_min(F.array(*(F.struct(F.round(loss(p, q), 12).alias("l"), F.lit(i).alias("i"), p.alias("a"), q.alias("b")) for i, (p, q) in enumerate(edges))))
    p, q = F.when(inside, a).otherwise(best["a"]), F.when(inside, b).otherwise(best["b"])
    return F.transform(F.array(p, q, 1 - p - q), lambda x: F.round(x, 9))


def walk_forward_simplex(pred: DataFrame, legs: Sequence[str], label: str, train_days: int = 60, every: int = 5) -> DataFrame:
    """(date, weights): three weights on the simplex, refitted every few dates on the ``train_days`` dates before. A date's sums
    are one aggregate, the windows are over dates alone."""
    x1, x2, x3 = (F.col(c) for c in legs)
    u, v, r = x1 - x3, x2 - x3, F.col(label) - x3
    parts = {"uu": u * u, "uv": u * v, "vv": v * v, "ur": u * r, "vr": v * r}
    day = pred.dropna(subset=[*legs, label]).groupBy("date").agg(*(F.sum(e).alias(n) for n, e in parts.items()))
    order = Window.orderBy("date")  # one row per date
    before = order.rowsBetween(-train_days, -1)
    day = day.select("date", (F.row_number().over(order) - 1).alias("i"), *(F.sum(n).over(before).alias(n) for n in parts))
    due = (F.col("i") >= train_days) & ((F.col("i") - train_days) % every == 0)
    fit = F.when(due, simplex_weights({n: F.col(n) for n in parts}))
    held = F.last(fit, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return day.select("date", "i", held.alias("weights")).filter(F.col("i") >= train_days).drop("i")


def simplex_days(pred: DataFrame, weights: DataFrame, legs: Sequence[str], label: str, top_n: int = 10, cost: float = 0.002) -> DataFrame:
    """(date, weights, candidate, baseline): mean label of the first ``top_n`` by the date's weights and by equal ones, less cost."""
    x = pred.dropna(subset=[*legs, label]).join(weights, "date")
    own = F.round(sum((F.col("weights")[i] * F.col(c) for i, c in enumerate(legs)), F.lit(0.0)), 9)
    same = F.round(sum((F.col(c) for c in legs), F.lit(0.0)) / len(legs), 9)
    nth = lambda s: F.row_number().over(wd().orderBy(s.desc(), "code"))
    x = x.select("date", "weights", F.col(label).alias("__y"), nth(own).alias("__a"), nth(same).alias("__b"))
    mean = lambda c: F.avg(F.when(F.col(c) <= top_n, F.col("__y"))) - cost
    return x.groupBy("date", "weights").agg(mean("__a").alias("candidate"), mean("__b").alias("baseline"))
