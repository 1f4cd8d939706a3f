"""The factored grid against evaluating rows of it one by one."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from tessera.operators import evaluation as ev
from tessera.operators import gridrun as gr

ROW = "date int, code string, base double, ic double, naive double, ridge double, ret double"


def panel(seed, days=40, names=30):
    rng, rows = random.Random(seed), []
    for d in range(days):
        for c in range(rng.choice([0, 1, 3, 8, names])):
            v = [None if rng.random() < 0.05 else round(rng.gauss(0, 1), rng.choice([0, 3])) for _ in range(4)]
            rows.append((d, f"{c:06d}", *v, None if rng.random() < 0.05 else rng.gauss(0, 0.05)))
    return rows


def one_by_one(rows, ic_weight, naive_weight, pred_quantile, ridge_quantile, top_n, exposure, horizon=3, cost=0.002):
    """The metrics of one row of the grid, straight from its rules."""
    days = defaultdict(list)
    for d, code, base, ic, naive, ridge, ret in rows:
        if None not in (base, ic, naive, ret) and (s := round(base + ic_weight * ic + naive_weight * naive, 9)) > 0:
            days[d].append((s, code, ridge, ret))
    nets, held, moved, was = [], [], [], set()
    for d in sorted(days):
        left = days[d]
        if pred_quantile is not None and len(left) >= 5:
            cut = round(np.quantile([x[0] for x in left], pred_quantile), 9)
            left = [x for x in left if x[0] >= cut]
        if ridge_quantile is not None:
            left = [x for x in left if x[2] is not None]
            if len(left) >= 5:
                cut = round(np.quantile([round(x[2], 9) for x in left], ridge_quantile), 9)
                left = [x for x in left if round(x[2], 9) >= cut]
        picks = sorted(left, key=lambda x: (-x[0], x[1]))[:top_n]
        if not picks:
            continue
        w, now = exposure / top_n, {x[1] for x in picks}
        turnover = (w * len(now ^ was) + abs(w * len(now) - w * len(was))) / 2
        nets.append(max(sum(w * x[3] for x in picks) - cost * turnover, -0.99))
        held.append(len(picks))
        moved.append(turnover)
        was = now
    if not nets:
        return None
    nav = np.exp(np.cumsum(np.log1p(nets)))
    year = 252 / horizon
    vol = np.std(nets, ddof=1) * year**0.5 if len(nets) > 1 else None
    annual = np.exp(np.log1p(nets).sum() * year / len(nets)) - 1
    return len(nets), annual, vol, min(nav / np.maximum(np.maximum.accumulate(nav), 1) - 1), np.mean(np.array(nets) > 0), np.mean(moved), np.mean(held), annual / vol if vol else None


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_equals_rows_one_by_one(spark, seed):
    rows = panel(seed)
    grid = ev.parameter_grid(spark, "short")
    more = spark.createDataFrame([(0.05, 2, 0.5, None, 0.9, 0.1)], "ic_weight double, top_n int, gross_exposure double, ridge_quantile double, pred_quantile double, naive_weight double")
    grid = grid.select(*more.columns).unionByName(more)
    lists = gr.ranked_lists(spark.createDataFrame(rows, ROW), grid, "base", "ic", "naive", "ridge", "ret")
    got = gr.grid_metrics(gr.list_days(lists, [1, 2, 3, 4, 5]), grid, [0.18, 0.24, 0.30, 0.5], 3).collect()
    assert len(got) == 8101
    every = {(r.ic_weight, r.naive_weight, r.pred_quantile, r.ridge_quantile, r.top_n, r.gross_exposure): r for r in got}
    g = ev.SHORT
    combos = list(product(g["ic_weight"], g["naive_weight"], g["pred_quantile"], g["ridge_quantile"], g["top_n"], g["gross_exposure"]))
    for combo in [*random.Random(seed).sample(combos, 150), (0.05, 0.1, 0.9, None, 2, 0.5)]:
        n, annual, vol, dd, win, moved, held, sharpe = one_by_one(rows, *combo)
        r = every[combo]
        assert r.n == n and np.allclose([r.annual, r.vol, r.max_dd, r.win_rate, r.turnover, r.holdings, r.sharpe], [annual, vol, dd, win, moved, held, sharpe], rtol=1e-7, atol=1e-10)


def test_neighbours_and_empty_panels(spark):
    rows = panel(3)
    grid = ev.parameter_grid(spark, "short")
    lists = gr.ranked_lists(spark.createDataFrame(rows, ROW), grid, "base", "ic", "naive", "ridge", "ret")
    metrics = gr.grid_metrics(gr.list_days(lists, [1, 2, 3, 4, 5]), grid, [0.18, 0.24, 0.30], 3).cache()
    near = gr.neighbours(metrics, {"ic_weight": 0.03, "top_n": 1.0}).collect()
    best = max(metrics.filter("mean_sharpe is not null").collect(), key=lambda r: round(r.mean_sharpe, 9))
    assert round(max(r.mean_sharpe for r in near if r.mean_sharpe is not None), 9) == round(best.mean_sharpe, 9)
    assert {r.gross_exposure for r in near} == {best.gross_exposure} and {abs(r.top_n - best.top_n) <= 1 for r in near} == {True}
    empty = gr.ranked_lists(spark.createDataFrame([], ROW), grid, "base", "ic", "naive", "ridge", "ret")
    assert gr.grid_metrics(gr.list_days(empty, [1, 2]), grid, [0.18], 3).collect() == []
