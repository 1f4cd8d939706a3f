"""Regressions per date against a plain least-squares fit, with nulls, dependent columns, few rows and categories."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import crossfit as cf
from tessera.operators import evaluation as ev

ROW = "code string, date int, y double, z double, a double, b double, c double, ind string"


def frame(rng, dates=(40, 30, 9, 14, 1)):
    rows = []
    for d, n in enumerate(dates):
        for i in range(n):
            a, b = rng.normal(), rng.normal(5, 100)
            y = None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else 3 * a - 0.01 * b + rng.normal() + i % 4
            c = 2 * a if d == 1 else None if rng.random() < 0.2 else rng.normal()
            rows.append((f"{i:06d}", d, y, None if rng.random() < 0.1 else rng.normal(), float("inf") if rng.random() < 0.03 else a, b, c, None if i % 7 == 0 else f"I{i % 4}"))
    return rows


def plain(rows, y, xs, ind):
    """Least squares on the whole matrix of constant, columns and dummies."""
    out = {}
    number = lambda v: v is not None and np.isfinite(v)
    at = {n: i for i, n in enumerate("code date y z a b c ind".split())}
    for d in {r[1] for r in rows}:
        g = [r for r in rows if r[1] == d]
        x = [[1.0, *(r[at[c]] if number(r[at[c]]) else 0.0 for c in xs)] for r in g]
        if ind:
            names = sorted({r[7] for r in g if r[7] is not None})
            x = [[*row, *(float(r[7] == n) for n in names), float(r[7] is None)] for row, r in zip(x, g, strict=True)]
        x, v = np.array(x), np.array([r[at[y]] if number(r[at[y]]) else np.nan for r in g])
        ok = np.isfinite(v)
        e = v - x @ np.linalg.lstsq(x[ok], v[ok], rcond=None)[0] if ok.sum() > x.shape[1] + 2 else v
        out |= {(r[0], d): None if np.isnan(k) else k for r, k in zip(g, e, strict=True)}
    return out


@pytest.mark.parametrize(("xs", "ind"), [(["a", "b", "c"], True), (["a", "b", "c"], False), (["a"], True), ([], True), (["y", "a", "b"], False)])
def test_residuals_equal_least_squares(spark, xs, ind):
    rows = frame(np.random.default_rng(3))
    got = cf.residuals(spark.createDataFrame(rows, ROW), ["y", "z"], xs, "ind" if ind else None, by="date")
    assert got.columns == [c.split()[0] for c in ROW.split(", ")]
    got = got.collect()
    assert len(got) == len(rows)
    for y in ("y", "z"):
        want = plain(rows, y, [x for x in xs if x != y], ind)
        for r in got:
            w = want[r.code, r.date]
            assert (r[y] is None) == (w is None) and (w is None or abs(r[y] - w) < 1e-8)


def test_empty_table_and_no_regressors(spark):
    df = spark.createDataFrame([], ROW)
    assert cf.residuals(df, ["y"], ["a"], "ind").collect() == []
    assert cf.residuals(df, ["y"], []) is df


def test_increment_is_orthogonal_to_its_controls(spark):
    rows = frame(np.random.default_rng(4), (60, 20))
    got = cf.orthogonal_increment(spark.createDataFrame(rows, ROW), "z", ["a", "b", "c"], "inc", 30).toPandas()
    assert got[got.date == 1].inc.isna().all()
    g = got[got.date == 0]
    own = g[["z", "a", "b", "c"]].rank(pct=True)
    keep = own.notna().all(axis=1)
    assert (g.inc.notna() == keep).all()
    e = g.inc[keep]
    assert abs(e.std(ddof=0) - 1) < 1e-9 and abs(e.mean()) < 1e-9
    for c in ("a", "b", "c"):
        assert abs(np.dot(e, own[c][keep] - own[c][keep].mean())) < 1e-7
    same = cf.orthogonal_increment(spark.createDataFrame(rows, ROW), "b", ["b"], "inc", 5).collect()
    assert {r.inc for r in same} == {0.0}


def test_solver_takes_dependent_columns():
    g = np.array([[[4.0, 2.0], [2.0, 1.0]], [[2.0, 0.0], [0.0, 0.0]], [[2.0, 1.0], [1.0, 2.0]]])
    b = np.array([[4.0, 2.0], [2.0, 0.0], [3.0, 3.0]])
    x = cf.solve_symmetric(g, b)
    assert np.allclose(np.einsum("nij,nj->ni", g, x), b) and np.allclose(x[2], [1, 1])


def test_a_leg_must_win_before_and_behind_the_boundary(spark):
    """A leg that knows the return is selected and confirmed; one that knows it only before the boundary isn't confirmed."""
    rng, rows = np.random.default_rng(5), []
    for d in range(60):
        ret = rng.normal(0, 0.02, 20)
        for i in range(20):
            good = float(ret[i])
            rows.append((f"{i:06d}", f"2020-{1 + d // 28:02d}-{1 + d % 28:02d}", float(rng.normal(0, 0.01)), good, good if d < 30 else -good, good, good / 2))
    df = spark.createDataFrame(rows, "code string, date string, base double, leg double, fades double, r1 double, r2 double").selectExpr("code", "cast(date as date) date", "base", "leg", "fades", "r1", "r2")
    labels = {1: "r1", 2: "r2"}
    always = {r.weight: r for r in ev.leg_over_horizons(df, "base", "leg", labels, (0.0, 1.0), "2020-02-03").collect()}
    assert always[1.0].selected and always[1.0].confirmed and not always[0.0].selected
    fades = {r.weight: r for r in ev.leg_over_horizons(df, "base", "fades", labels, (0.0, 1.0), "2020-02-03").collect()}
    assert fades[1.0].selected and not fades[1.0].confirmed
