"""Every SQL query against DuckDB on the smallest tables, hand-made cases, and stream = batch."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import clean, cross
from tessera.functions.rolling import wc
from tessera.operators import asof, evaluation, keyed, models, portfolio, tradability
from tessera.plans.catalog import QUERIES, SQL
from tessera.streaming import ticks
from tests.compare import database, differences

D = dt.date


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert differences([tuple(r) for r in df.collect()], df.columns, con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def bars(spark, rows):
    return spark.createDataFrame([("1", D(2024, 1, i + 1), *r) for i, r in enumerate(rows)], "code string, date date, close double, sellable boolean, ok boolean")


def sell(spark, rows, horizon, cap):
    df = bars(spark, rows).select("date", tradability.rolled_sell("close", "sellable", "ok", horizon, cap).alias("x"))
    return [r.x for r in df.orderBy("date").collect()]


def test_rolled_sell(spark):
    free = [(float(10 + i), True, True) for i in range(6)]
    assert sell(spark, free, 1, 3) == [11, 12, 13, 14, 15, None]
    blocked = [(c, i != 1, ok) for i, (c, _, ok) in enumerate(free)]
    assert sell(spark, blocked, 1, 3)[0] == 12
    assert sell(spark, [(10.0, True, True), (9.9, False, False), (9.8, False, False)], 1, 2)[0] is None


def test_adv_needs_twenty_rows_before(spark):
    rows = [("1", D(2024, 1, 1) + dt.timedelta(i), 1.0, 1.0, 1.0, 1.0, 1.0, 1e8 if i == 20 else 1e6) for i in range(22)]
    b = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")
    got = {r.date: (r.adv20, r.buyable_close) for r in tradability.tradability(b, None, least_adv=2e6).collect()}
    assert got[D(2024, 1, 21)] == (1e6, False) and got[D(2024, 1, 20)][0] is None
    assert {r.date: r.buyable_close for r in tradability.tradability(b, None, least_adv=5e5).collect()}[D(2024, 1, 21)]


def test_industry_at_a_date(spark):
    log = spark.createDataFrame([("1", "Old", D(2024, 1, 1), D(2025, 2, 1), D(2024, 1, 2)), ("1", "New", D(2025, 2, 1), None, D(2025, 3, 1))], "code string, industry string, valid_from date, valid_to date, available_from date")
    days = spark.createDataFrame([("1", D(2025, m, 5)) for m in (1, 2, 3)], "code string, date date")
    assert [r.industry for r in asof.valid_at(days, log, "industry").orderBy("date").collect()] == ["Old", None, "New"]


def test_next_session(spark):
    cal = spark.createDataFrame([(D(2024, 1, 30),), (D(2024, 2, 2),), (D(2024, 2, 3),)], "date date")
    ann = spark.createDataFrame([(D(2024, 1, 30),), (D(2024, 2, 1),)], "ann date")
    assert [r.session for r in asof.next_session(ann, cal, "ann").orderBy("ann").collect()] == [D(2024, 2, 2)] * 2


def test_asof_carries_null_fields(spark):
    left = spark.createDataFrame([("1", D(2024, 1, d)) for d in (1, 2, 3)], "code string, date date")
    right = spark.createDataFrame([("1", D(2024, 1, 2), None, "a"), ("1", D(2024, 1, 1), 5.0, "b")], "code string, d date, x double, y string")
    assert [(r.x, r.y) for r in asof.asof(left, right, "d", ["x", "y"]).orderBy("date").collect()] == [(5, "b"), (None, "a"), (None, "a")]


def test_turnover(spark):
    rows = [(D(2024, 1, 1), "a", 0.15), (D(2024, 1, 1), "b", 0.15), (D(2024, 1, 5), "a", 0.15), (D(2024, 1, 5), "c", 0.15)]
    got = [r.turnover for r in portfolio.turnover(spark.createDataFrame(rows, "date date, code string, weight double")).orderBy("date").collect()]
    assert got == pytest.approx([0.30, 0.15])


def test_holm(spark):
    got = {r.name: r.holm for r in portfolio.holm(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.5)], "name string, p double")).collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.04, "c": 0.5})


def test_buckets_of_seven(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), str(i), float(i)) for i in range(7)], "date date, code string, x double")
    assert [r.b for r in df.select("code", cross.quantile_bucket("x", 5).alias("b")).orderBy("code").collect()] == [0, 0, 1, 2, 3, 4, 4]


def test_numbers_and_codes(spark):
    df = spark.createDataFrame([("12.3%", "SH600000"), ("1,234", "1.SZ"), ("--", "300750"), (None, None)], "x string, c string")
    got = df.select(clean.number(F.col("x")).alias("x"), clean.bare_code(F.col("c")).alias("c")).collect()
    assert [r.x for r in got] == [12.3, 1234.0, None, None] and [r.c for r in got] == ["600000", "000001", "300750", None]


def test_tables(spark, tmp_path):
    from pyspark.sql import types as T

    from tessera.sources import tables

    schema = T.StructType().add("code", "string").add("date", "date").add("x", "long")
    assert tables.load(spark, str(tmp_path), "t", schema).count() == 0
    rows = spark.createDataFrame([("a", D(2024, 1, 5), 1), ("a", D(2024, 2, 5), 2)], schema)
    tables.save(rows, str(tmp_path), "t")
    old = tables.load(spark, str(tmp_path), "t", schema)
    tables.save(keyed.upsert(old, rows.withColumn("x", F.col("x") + 10).filter("x = 12"), ["code", "date"]), str(tmp_path), "t")
    assert sorted(r.x for r in tables.load(spark, str(tmp_path), "t", schema).collect()) == [1, 12]
    path = f"{tmp_path}/months"
    tables.save_months(rows, path)
    tables.save_months(rows.filter("x = 2").withColumn("x", F.lit(7).cast("long")), path)
    assert [r.x for r in tables.load_window(spark, path, "2024-01-01", "2024-03-01", ["x"]).orderBy("x").collect()] == [1, 7]


def test_violations_stop_the_job(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,)], "x double")
    assert keyed.require(df, F.col("x") < -5, "bad").count() == 2
    with pytest.raises(Exception, match="negative"):
        keyed.require(df, F.col("x") < 0, "negative").collect()


def test_no_feature_sees_the_future(spark, sf):
    from tessera.functions.indicators import window_indicators
    from tessera.sources.driver_tables import Tables

    b = Tables(spark, sf).bars
    full = window_indicators(b).filter("date < date'1996-01-01'")
    cut = window_indicators(b.filter("date < date'1996-01-01'"))
    assert full.exceptAll(cut).count() == 0 and full.count() == cut.count()
    assert b.select(F.lag("close").over(wc())).count() == b.count()


def test_stream_equals_batch(spark, sf, tmp_path):
    from tessera.sources.driver_tables import Tables
    from tessera.streaming import ticks as tk

    ticks = Tables(spark, sf).ticks
    ticks.repartition(2).write.parquet(f"{tmp_path}/ticks")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks")
    run = tk.stream_state(stream).writeStream.format("memory").queryName("state").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = {(r.code, r.event_id): (r.prev, r.high, r.low, r.first) for r in spark.table("state").collect()}
    want = {(r.code, r.event_id): (r.prev, r.high, r.low, r.first) for r in tk.intraday_state(ticks).collect()}
    assert got == want


def test_parameter_grids(spark):
    short, swing = (evaluation.parameter_grid(spark, k) for k in ("short", "swing"))
    assert short.count() == short.distinct().count() == 8100 and swing.distinct().count() == 576
    template = spark.createDataFrame([(0.0, 1, 0.18, 0.45, 0.3), (9.0, 1, 0.18, 0.45, 0.3)], "ic_weight double, top_n int, gross_exposure double, ridge_quantile double, naive_weight double")
    assert evaluation.parameter_grid(spark, "short", template).count() == 8102


def test_boundaries_must_be_in_order():
    assert evaluation.holdout_boundaries("2024-01-01", "2024-02-01", "2024-03-01")[2] == D(2024, 3, 1)
    for wrong in (("2024-01-01", "2024-01-01", "2024-03-01"), ("2024-01-01", "", "2024-03-01"), ("2024-03-01", "2024-02-01", "2024-04-01")):
        with pytest.raises(ValueError):
            evaluation.holdout_boundaries(*wrong)


def test_walk_forward_weights_find_the_better_leg(spark):
    rows = [(str(c), D(2024, 1, 1) + dt.timedelta(i), float(c * i % 7), float(c + i % 3), 0.25 * (c * i % 7) + 0.75 * (c + i % 3)) for i in range(12) for c in range(5)]
    p = spark.createDataFrame(rows, "code string, date date, a double, b double, y double")
    got = [r.weight for r in evaluation.walk_forward_weights(p, "a", "b", "y", 6, 2).orderBy("date").collect()]
    assert len(got) == 6 and got == pytest.approx([0.75] * 6)


def test_only_one_trial_is_chosen(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    gain = {1: 0.001, 2: 0.004, 3: 0.003}
    rows = [(p, d, g + 0.002 * (i % 3)) for p, g in gain.items() for i, d in enumerate(days)]
    r = spark.createDataFrame(rows, "param_id int, date date, net double")
    got = [(x.param_id, x.promote, x.chosen) for x in evaluation.promotion_trials(r, "2024-01-20", 1, 3).orderBy("trial").collect()]
    assert got == [(2, True, True), (3, True, False), (1, False, False)]


def test_row_weights_and_validation_reach_the_fit(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(i), float(i % 4), float(i % 4 == 3), i >= 80) for i in range(100)]
    df = models.decay_weights(spark.createDataFrame(rows, "date date, x double, y double, held boolean"), half_life=10.0, minority="y")
    w = {r.date: r.weight for r in df.collect()}
    assert w[D(2024, 4, 9)] == pytest.approx(0.5 / 0.25) and w[D(2024, 1, 1)] == pytest.approx(0.2 * 0.5 / 0.75)
    fit = models.train(df, ["x"], "y", "boosted_trees", "weight", "held").stages[-1]
    assert fit.getWeightCol() == "weight" and fit.getNumTrees < models.ROUNDS


def test_provenance_names_every_fault(spark):
    chosen = spark.createDataFrame([("b",), ("a",)], "factor string")
    good = evaluation.selection_manifest(chosen, "y", "2024-01-01", "2024-02-01", "2024-03-01")
    assert evaluation.provenance_faults(good, chosen, "y").first().faults == ""
    wrong = evaluation.selection_manifest(chosen.filter("factor = 'a'"), "x", "2024-01-01", "2024-01-01", "2024-03-01")
    assert evaluation.provenance_faults(wrong, chosen, "y").first().faults == "label,count,digest,boundaries"


def test_groups_and_first_column():
    assert evaluation.feature_groups(["x_local_decay_7", "n_count", "z"], {"direction": ["_local_decay_"], "none": ["q"]}) == {"direction": ["x_local_decay_7"]}
    assert str(evaluation.first_column(["a", "net_b", "net_c"], ["^q", "^net"])) == str(F.col("net_b"))


def test_cooldown_holds_only_the_last_kept_time(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, i, at(s)) for i, s in enumerate((0, 30, 59, 60, 61, 119, 120))] + [(2, 9, at(61)), (2, 10, None)]
    s = spark.createDataFrame(rows, "code long, event_id long, ts timestamp_ntz")
    assert sorted(r.event_id for r in ticks.cooldown(s, 60).collect()) == [0, 3, 6, 9]
