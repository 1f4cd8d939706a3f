"""State gates: states without labels, thresholds frozen before the boundary, and portfolios against a plain loop."""

from __future__ import annotations

import datetime as dt
import random
from statistics import median, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import stategates as sg

ROW = "date date, code string, champion double, leg double, r1 double, r2 double"
BOUNDARY = "2021-03-15"


def panel(seed=1, days=110, names=16):
    rng, rows = random.Random(seed), []
    for d in range(days):
        day, loud = dt.date(2021, 1, 1) + dt.timedelta(days=d), rng.choice([0.3, 2.0])
        for c in range(names if d != 5 else 0):
            leg = None if rng.random() < 0.15 else round(rng.gauss(0, loud), 6)
            ret = (leg or 0.0) * (0.02 if loud > 1 else -0.01) + rng.gauss(0, 0.01)
            rows.append((day, f"{c:06d}", round(rng.gauss(0.2, 1), 6), leg, ret, None if rng.random() < 0.05 else 2 * ret))
    return rows


def by_day(rows):
    days = {}
    for r in rows:
        days.setdefault(r[0], []).append(r)
    return dict(sorted(days.items()))


def pool(day, size):
    return sorted((r for r in day if r[2] > 0), key=lambda r: (-r[2], r[1]))[:size]


def plain_states(rows, size):
    out, spreads = {}, []
    for d, day in by_day(rows).items():
        def gap(v):
            s = pstdev(v)
            return (np.mean(sorted(v)[-2:]) - median(v)) / s if s > 0 else 0.0
        p = pool(day, size)
        own, every = [r[3] for r in p if r[3] is not None], [r[3] for r in day if r[3] is not None]
        before = spreads[-60:]
        usual = median(before) if len(before) >= 20 else None
        spreads.append(pstdev(every))
        out[d] = (len(own) / len(p) if p else None, pstdev(own) if own else None, gap(own) if own else None, spreads[-1] / usual if usual else None, gap(every))
    return out


def plain_run(rows, weight_of, family, horizon, size, top_n, cost=0.002):
    """Net returns of one side of the boundary under a weight per day."""
    nets, was = [], set()
    for d, day in by_day(rows).items():
        members = pool(day, size) if family == "pool" else day
        v = [r[3] for r in members if r[3] is not None]
        m, s = (np.mean(v), pstdev(v)) if v else (0, 0)
        z = lambda r: (r[3] - m) / s if r[3] is not None and s > 1e-12 else 0.0  # noqa: B023, E731
        ranked = [(round(r[2] + weight_of(d) * z(r), 9), r[1], r[3 + horizon]) for r in members if r[3 + horizon] is not None]
        picks = sorted((x for x in ranked if x[0] > 0), key=lambda x: (-x[0], x[1]))[:top_n]
        if picks:
            now = {x[1] for x in picks}
            moved = (len(now ^ was) + abs(len(now) - len(was))) / 2
            nets.append(max((sum(x[2] for x in picks) / horizon - cost * moved) / top_n, -0.99))
            was = now
    return np.array(nets)


@pytest.fixture(scope="module")
def gated(spark):
    rows = panel()
    df = spark.createDataFrame(rows, ROW).cache()
    return rows, df, sg.evaluate_gates(df, "champion", "leg", {1: "r1", 2: "r2"}, sg.gate_table(spark), BOUNDARY, 6, 3).collect()


def test_states_equal_a_plain_count(gated):
    rows, df, _ = gated
    got = {r.date: tuple(r)[1:] for r in sg.state_features(df, "champion", "leg", 6).collect()}
    want = plain_states(rows, 6)
    assert got.keys() == want.keys()
    for d, values in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-9) for a, b in zip(got[d], values, strict=True))
    blind = df.withColumn("r1", F.lit(None).cast("double")).withColumn("r2", F.lit(7.0))
    assert {r.date: tuple(r)[1:] for r in sg.state_features(blind, "champion", "leg", 6).collect()} == got


def test_gates_equal_a_plain_run(gated):
    rows, _, got = gated
    states, at = plain_states(rows, 6), {n: i for i, n in enumerate(("pool_coverage", "pool_dispersion", "pool_gap_z", "dispersion_ratio", "gap_z"))}
    edge = dt.date.fromisoformat(BOUNDARY)
    assert len(got) == 38 and {r.family for r in got if r.selected} == {"pool", "full"}
    for r in random.Random(2).sample(got, 12) + [x for x in got if x.selected]:
        early = [round(v[at[r.feature]], 12) for d, v in states.items() if r.feature in at and d < edge and v[at[r.feature]] is not None]
        cut = round(float(np.quantile(early, r.quantile)), 12) if early else None
        assert (r.threshold is None) == (cut is None) and (cut is None or abs(r.threshold - cut) < 2e-9)

        def weight(d):
            if cut is None:  # noqa: B023
                return r.high  # noqa: B023
            v = states[d][at[r.feature]]  # noqa: B023
            return r.high if v is not None and round(v, 12) >= cut else r.low  # noqa: B023

        for name, part in (("selection", [x for x in rows if x[0] < edge]), ("holdout", [x for x in rows if x[0] >= edge])):
            sharpes, falls = [], []
            for h in (1, 2):
                net = plain_run(part, weight, r.family, h, 6, 3)
                sharpes.append(net.mean() * 252 / (net.std(ddof=1) * 252**0.5))
                nav = np.exp(np.cumsum(np.log1p(net)))
                falls.append(min(nav / np.maximum(np.maximum.accumulate(nav), 1) - 1))
            assert np.allclose([r[f"{name}_sharpe"], r[f"{name}_dd"]], [np.mean(sharpes), min(falls)], rtol=1e-6, atol=1e-9)


def test_what_comes_later_changes_no_choice(spark, gated):
    rows, _, got = gated
    edge = dt.date.fromisoformat(BOUNDARY)
    other = [r if r[0] < edge else (*r[:3], None if r[3] is None else 5 - r[3], r[4] and -r[4], r[5]) for r in rows]
    again = sg.evaluate_gates(spark.createDataFrame(other, ROW), "champion", "leg", {1: "r1", 2: "r2"}, sg.gate_table(spark), BOUNDARY, 6, 3).collect()
    pick = lambda rs: sorted((r.gate, r.threshold, round(r.selection_sharpe, 9), r.selected) for r in rs)
    assert pick(again) == pick(got)


def test_weight_gate_promotes_nothing_without_figures(spark):
    from tessera.operators.evaluation import weight_gate

    walk = "date date, weight double, candidate double, baseline double"
    (empty,) = weight_gate(spark.createDataFrame([], walk)).collect()
    assert empty.days == 0 and not empty.rollback
    assert empty.reasons == "insufficient_oos_days,mean_return_not_improved,hit_rate_gate,drawdown_gate,weight_step_gate"
    rows = [(dt.date(2021, 1, 1) + dt.timedelta(days=i), 0.5, None, 0.001 * (i % 3 - 0.5)) for i in range(130)]
    (one,) = weight_gate(spark.createDataFrame(rows, walk)).collect()
    assert "mean_return_not_improved" in one.reasons and "sharpe_not_improved" in one.reasons
