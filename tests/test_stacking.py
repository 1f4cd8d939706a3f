"""Simplex weights against a fine grid, with nulls and clipped errors; windows against a plain solver."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tessera.operators import stacking as sk

ROW = "date date, code string, a double, b double, c double, y double"


def rows_of(seed, mix, n=600):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        x = rng.normal(0, 0.05, 3)
        y = float(mix @ x + rng.normal(0, 0.02)) if i % 40 else float(rng.normal(0, 3))
        legs = [None if rng.random() < 0.1 else float("nan") if rng.random() < 0.03 else float(v) for v in x]
        out.append((dt.date(2021, 1, 1) + dt.timedelta(days=i // 8), f"{i % 8:06d}", *legs, None if i % 50 == 7 else y))
    return out


def grid_loss(rows, w, clip=0.2):
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows], float)
    has = np.isfinite(x[:, :3])
    down = has @ w
    with np.errstate(all="ignore"):
        e = np.where(has, x[:, :3], 0) @ w / down - x[:, 3]
    ok = (down > 0) & np.isfinite(x[:, 3])
    return float(np.mean(np.clip(e[ok], -clip, clip) ** 2))


@pytest.mark.parametrize(("seed", "mix"), [(1, (0.5, 0.3, 0.2)), (2, (1.2, -0.4, 0.2)), (3, (0.0, 0.0, 1.0))])
def test_stack_is_as_good_as_a_fine_grid(spark, seed, mix):
    rows = rows_of(seed, np.array(mix))
    df = spark.createDataFrame(rows, ROW)
    w, loss = sk.stack(df, ["a", "b", "c"], "y")
    assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all() and abs(loss - grid_loss(rows, w)) < 1e-12
    best = min(grid_loss(rows, np.array([i, j, 200 - i - j]) / 200) for i in range(201) for j in range(201 - i))
    assert loss <= best + 1e-6
    again, _ = sk.stack(df, ["a", "b", "c"], "y")
    assert (again == w).all()


def test_nothing_to_stack(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), "1", None, None, None, 1.0), (dt.date(2021, 1, 1), "2", 1.0, 1.0, 1.0, None)], ROW)
    w, loss = sk.stack(df, ["a", "b", "c"], "y", start=[2.0, 1.0, 1.0])
    assert w.tolist() == [0.5, 0.25, 0.25] and loss == np.inf


def test_walk_equals_a_grid_in_every_window(spark):
    rng, rows = np.random.default_rng(4), []
    for d in range(90):
        mix = np.array([(0.6, 0.3, 0.1), (1.5, -0.2, -0.3), (0.0, 0.7, 0.3)][d // 30])
        for c in range(6):
            x = rng.normal(0, 0.05, 3)
            rows.append((dt.date(2021, 1, 1) + dt.timedelta(days=d), f"{c:06d}", *map(float, x), float(mix @ x + rng.normal(0, 0.01))))
    got = sorted(sk.walk_forward_simplex(spark.createDataFrame(rows, ROW), ["a", "b", "c"], "y", 20, 5).collect(), key=lambda r: r.date)
    assert len(got) == 70
    x = np.array([r[2:] for r in rows])
    grid = np.array([(i, j, 100 - i - j) for i in range(101) for j in range(101 - i)]) / 100
    for k, r in enumerate(got):
        last = 20 + k - k % 5
        part = x[(last - 20) * 6 : last * 6]
        loss = lambda w: ((part[:, :3] @ np.asarray(w) - part[:, 3]) ** 2).sum()  # noqa: B023, E731
        assert min(r.weights) >= 0 and abs(sum(r.weights) - 1) < 1e-8 and loss(r.weights) <= min(map(loss, grid)) + 1e-9
