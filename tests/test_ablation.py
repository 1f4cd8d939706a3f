"""Forward selection of groups against refitting every subset from the rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tessera.operators import ablation as ab

ROW = "date date, code string, a double, good double, noise double, late double, y double"
SEL, CON = ab.Period("2021-04-11", "2021-04-11", "2021-07-20"), ab.Period("2021-07-20", "2021-07-20", "2021-10-28")
GROUPS = {"good": ["good"], "noise": ["noise"], "late": ["late"]}


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(6), []
    for d in range(300):
        day = dt.date(2021, 1, 1) + dt.timedelta(days=d)
        for c in range(12):
            a, good, noise, late = rng.normal(size=4)
            y = 0.01 * a + 0.02 * good + (0.004 * late if d < 200 else -0.03 * late) + rng.normal(0, 0.01)
            out.append((day, f"{c:06d}", float(a), None if rng.random() < 0.03 else float(good), float(noise), float(late), None if rng.random() < 0.03 else float(y)))
    return out


def scratch(rows, period, features, alpha=10.0, horizon=2, top_n=3, cost=0.002):
    """Fit on the rows themselves, predict, and measure."""
    f = pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])
    names, end, start, last = ["a", "good", "noise", "late"], *(dt.date.fromisoformat(x) for x in (period.train_end, period.start, period.end))
    dates = sorted(set(f.date[f.date < end]))
    train = f[f.date < dates[-horizon]].dropna(subset=[*names, "y"])
    x, y = train[features].to_numpy(), train.y.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(features)), xc.T @ yc)
    test = f[(f.date >= start) & (f.date < last)]
    return test, beta, y.mean() - x.mean(0) @ beta


def measured(test, pred, horizon=2, top_n=3, cost=0.002):
    test = test.assign(p=np.round(pred, 12))
    ic, net = [], {}
    for d, g in test.groupby("date"):
        ic.append(g.p.rank().corr(g.y.rank()))
        net[d] = g.sort_values(["p", "code"], ascending=[False, True]).y.head(top_n).mean() / horizon - cost
    net = pd.Series(net)
    nav = np.exp(np.log1p(net).cumsum())
    month = np.log1p(net).groupby([d.strftime("%Y-%m") for d in net.index]).sum()
    return np.mean(ic), net.mean() * 252 / (net.std() * 252**0.5), (nav / np.maximum(nav.cummax(), 1) - 1).min(), month


def test_steps_equal_refits(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    got = ab.forward_groups(df, ["a"], GROUPS, "y", 2, SEL, CON).collect()
    first = {r.group: r for r in got if r.stage == "selection" and r.step == 1}
    assert first.keys() == GROUPS.keys() and first["good"].winner and not first["noise"].winner

    def run(period, features, drop):
        test, beta, bias = scratch(rows, period, features)
        test = test.dropna(subset=[*drop, "y"])
        return measured(test, bias + test[features].to_numpy() @ beta)

    # candidates of a step are compared on the rows that have all of the step's features
    step = ["a", "good", "noise", "late"]
    base = run(SEL, ["a"], ["a"])
    for g, r in first.items():
        c = run(SEL, ["a", g], step)
        wins = (c[3] > base[3]).mean()
        assert np.allclose([r.rank_ic_gain, r.sharpe_gain, r.drawdown_change, r.monthly_win_rate], [c[0] - base[0], c[1] - base[1], c[2] - base[2], wins], atol=1e-8)
    (last,) = [r for r in got if r.stage == "confirmation"]
    chosen = [r.group for r in got if r.winner and r.stage == "selection"]
    assert last.group == ",".join(chosen) and chosen[0] == "good"
    c, b = run(CON, ["a", *chosen], ["a", *chosen]), run(CON, ["a"], ["a", *chosen])
    assert np.allclose([last.rank_ic_gain, last.sharpe_gain, last.drawdown_change, last.monthly_win_rate], [c[0] - b[0], c[1] - b[1], c[2] - b[2], (c[3] > b[3]).mean()], atol=1e-8)


def test_the_rows_are_made_once(spark, rows):
    made = spark.sparkContext.accumulator(0)

    def counted(it):
        for f in it:
            made.add(len(f))
            yield f

    ab.forward_groups(spark.createDataFrame(rows, ROW).mapInPandas(counted, ROW), ["a"], GROUPS, "y", 2, SEL, CON)
    assert made.value == len(rows)


def test_what_fades_is_not_confirmed(spark, rows):
    strong = [(*r[:6], None if r[6] is None else r[6] + (0.01 * r[5] if r[0] < dt.date(2021, 7, 20) else 0.0)) for r in rows]
    got = ab.forward_groups(spark.createDataFrame(strong, ROW), ["a"], {"late": ["late"]}, "y", 2, SEL, CON).collect()
    assert [(r.stage, r.group, r.passed) for r in got] == [("selection", "late", True), ("confirmation", "late", False)]


def test_sub_solve_is_the_refit_of_each_subset(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    gram, mean, n = ab.products(df, ["a", "good", "noise", "late"], "y", SEL.train_end, 2)
    for features in (["a"], ["noise", "late"], ["a", "good", "noise", "late"]):
        _, beta, bias = scratch(rows, SEL, features)
        got, own = ab.sub_solve(gram, mean, [["a", "good", "noise", "late"].index(f) for f in features], 10.0)
        assert np.allclose(got, beta, atol=1e-10) and abs(own - bias) < 1e-10
    assert n > 500


def test_nothing_to_train_on(spark, rows):
    df = spark.createDataFrame(rows, ROW).filter("date >= '2021-04-11'")
    got = ab.forward_groups(df, ["a"], GROUPS, "y", 2, SEL, SEL).collect()
    assert [(r.stage, r.group, r.passed) for r in got] == [("confirmation", "", False)]
    assert [r.passed for r in ab.forward_groups(df.limit(0), ["a"], GROUPS, "y", 2, SEL, CON).collect()] == [False]
