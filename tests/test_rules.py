"""Tick rules: stream against batch with ticks out of order, repeated and too late; single rules by hand; the ledger over a restart."""

from __future__ import annotations

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.plans import q_rules
from tessera.sources.driver_tables import Tables
from tessera.streaming import rules as ru

QUOTE = f"{ru.TICK}, {ru.REFERENCE}".replace("ts timestamp,", "ts timestamp_ntz,")
DAY0 = dt.datetime(2024, 3, 4, 9, 30)


def quote(i, last, s=None, code=1, amount=None, volume=None, pre=10.0, up=11.0, down=9.0, atr=None, expected=None, hold=None, session=DAY0.date()):
    return code, session, DAY0 + dt.timedelta(seconds=i * 10 if s is None else s), i, last, volume, amount, pre, up, down, atr, expected, hold


def fired(spark, rows, rules):
    return [(r.event_id, r.kind) for r in ru.batch_signals(spark.createDataFrame(rows, QUOTE), rules).orderBy("event_id", "kind").collect()]


def test_limit_moves_by_hand(spark):
    last = [10.5, 11.0, 11.0, 10.95, 10.95, 10.0, 11.0, None, 9.05, 9.0, 9.0, 9.05]
    got = fired(spark, [quote(i, x) for i, x in enumerate(last)], [ru.LimitMoves()])
    assert got == [(1, "limit_up"), (3, "limit_open"), (4, "near_limit_up"), (8, "near_limit_down"), (9, "limit_down"), (11, "near_limit_down")]
    assert fired(spark, [quote(0, 10.0, up=None, down=None), quote(1, 11.0, up=0.0, down=0.0)], [ru.LimitMoves()]) == [(1, "limit_up")]


def test_surges_cool_down_by_direction(spark):
    at = [(0, 10.0), (5, 10.3), (10, 10.0), (15, 10.3), (70, 10.6), (71, 10.0), (71.5, 11.0), (200, 9.0)]
    got = fired(spark, [quote(i, x, s) for i, (s, x) in enumerate(at)], [ru.Surges()])
    assert got == [(1, "surge_up"), (2, "surge_down"), (4, "surge_up"), (5, "surge_down")]


def test_reference_rules_by_hand(spark):
    stop = [quote(0, 10.0, atr=0.5), quote(1, 12.0, atr=0.5), quote(2, 10.6, atr=0.5), quote(3, 10.5, atr=0.5), quote(4, 9.0, atr=0.5), quote(5, 1.0, code=2), quote(6, 1.0, code=3, atr=0.0)]
    assert fired(spark, stop, [ru.Chandelier()]) == [(3, "chandelier_stop")]
    gap = [quote(0, None, expected=0.02), quote(1, 10.12, expected=0.02), quote(2, 10.5, expected=0.02), quote(3, 10.11, code=2, expected=0.02), quote(4, 11.0, code=3), quote(5, 11.0, code=4, expected=-0.1)]
    assert fired(spark, gap, [ru.GapEaten()]) == [(1, "gap_eaten")]
    held = [quote(0, None, hold=1), quote(1, 10.0, hold=1), quote(2, 10.0, code=2, hold=0), quote(3, 10.0, code=3)]
    assert fired(spark, held, [ru.HoldingExpiry()]) == [(0, "holding_expiry")]
    amounts = [None, 100.0, 110.0, 105.0, 134.0, 200.0]
    assert fired(spark, [quote(i, 10.0, amount=a) for i, a in enumerate(amounts)], [ru.VolumeSurge(2.5)]) == [(4, "volume_surge")]
    vwap = [quote(i, x, amount=1000.0, volume=100.0) for i, x in enumerate([10.05, 10.2, 9.8, 10.3, 30.0])] + [quote(40, 10.2, amount=1000.0, volume=100.0), quote(41, 10.2, amount=5.0, volume=0.0)]
    assert fired(spark, vwap, [ru.VwapDeviation()]) == [(1, "vwap_rich"), (2, "vwap_cheap"), (40, "vwap_rich")]


def test_a_price_of_zero_fails_no_division(spark):
    rows = [quote(0, 10.0, amount=1000.0, volume=100.0), quote(1, 0.0, amount=1000.0, volume=100.0), quote(2, 10.2, amount=1000.0, volume=100.0)]
    assert fired(spark, rows, [ru.VwapDeviation()]) == [(1, "vwap_cheap"), (2, "vwap_rich")]
    found = {k for _, k in fired(spark, rows, ru.standard_rules())}
    assert {"vwap_cheap", "vwap_rich", "limit_down"} <= found


def test_reference_holds_nothing_of_its_own_session(spark, sf):
    """Dropping the later ticks of a table changes no earlier signal."""
    t = Tables(spark, sf)
    ticks = t.ticks.withColumn("session", F.to_date(F.date_trunc("week", "ts"))).cache()
    until = dt.datetime(2024, 1, 17, 12)

    def signals(x):
        both = x.join(ru.session_reference(x, 2.5, 0.1, 3, 1.5), ["code", "session"], "left")
        return {tuple(r) for r in ru.batch_signals(both, q_rules.RULES).filter(F.col("ts") <= F.lit(until)).select("event_id", "kind", "value", "against").collect()}

    whole, part = signals(ticks), signals(ticks.filter(F.col("ts") <= F.lit(until)))
    assert whole == part and len(whole) > 100


class Doubled(ru.Rule):
    """A user's own rule: a price that is twice the session's first one."""

    kinds = (ru.Kind("doubled", "info"),)

    def conditions(self):
        return {"doubled": (F.col("last") >= 2 * F.col("first"), F.col("last"), F.col("first"))}

    def on_quote(self, q):
        if q.last is not None and q.first is not None and q.last >= 2 * q.first:
            yield "doubled", q.last, q.first


KEY = ["code", "event_id", "kind", "level", "value", "against"]


def _feed(spark, sf, folder, repeats=True):
    """Ticks as files in rough order of time: some come in a later file, some twice; prices and amounts are null here and there."""
    rng = random.Random(11)
    ticks = Tables(spark, sf).ticks.withColumn("session", F.to_date(F.date_trunc("week", "ts"))).orderBy("ts", "event_id")
    rows = [tuple(r) for r in ticks.select("code", "session", "ts", "event_id", "last", "volume", "amount").collect()]
    rows = [(*r[:4], None if rng.random() < 0.05 else r[4], r[5], None if rng.random() < 0.05 else r[6]) for r in rows]
    files: list[list] = [[] for _ in range(5)]
    per = len(rows) // 4 + 1
    for i, r in enumerate(rows):
        k = i // per
        files[k + (1 if i % per > per - 40 and rng.random() < 0.5 else 0)].append(r)
        if repeats and rng.random() < 0.1:
            files[k].append(r)
    end = (-1, None, dt.datetime(2024, 3, 1), -1, 1.0, None, None)
    for k, part in enumerate(files):
        rng.shuffle(part)
        more = [end] if k == 4 else []
        path = f"{folder}/{k}"
        spark.createDataFrame(part + more, ru.TICK.replace("ts timestamp,", "ts timestamp_ntz,")).coalesce(1).write.parquet(path)
        (name,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{path}/{name}", f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.createDataFrame(rows, ru.TICK.replace("ts timestamp,", "ts timestamp_ntz,"))


@pytest.fixture
def feed(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ticks = _feed(spark, sf, tmp_path)
    reference = ru.session_reference(ticks, 2.5, 0.1, 3, 1.5).cache()
    rules = [*q_rules.RULES, Doubled()]
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = ru.stream_signals(stream, reference, rules, "4 days", 7 * 86_400_000)
    want = ru.batch_signals(ticks.join(reference, ["code", "session"], "left"), rules)
    return found, want


def test_stream_equals_batch_and_ledger_survives_a_restart(spark, feed, tmp_path):
    found, want = feed
    write, seen = ru.ledger_writer(f"{tmp_path}/ledger"), []

    def failing(batch, batch_id):
        write(batch, batch_id)
        seen.append(batch_id)
        if batch_id == 2 and seen.count(2) == 1:
            raise RuntimeError("lost after the write")

    def run():
        return found.writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after the write"):
        run().awaitTermination(300)
    run().awaitTermination(300)
    assert seen.count(2) == 2
    ledger = ru.read_ledger(spark, f"{tmp_path}/ledger")
    got = Counter(tuple(r) for r in ledger.select(*KEY).collect())
    assert got == Counter(tuple(r) for r in want.select(*KEY).collect())
    kinds = {k[2] for k in got}
    assert {"limit_up", "limit_open", "limit_down", "surge_up", "surge_down", "volume_surge", "vwap_cheap", "vwap_rich", "chandelier_stop", "doubled"} <= kinds
    assert ledger.filter(F.col("day") != F.to_date("ts")).count() == 0
