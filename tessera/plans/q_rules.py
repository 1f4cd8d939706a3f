"""Queries of the tick rules, their notifications and the ledger (T05-T13, S17), in batch form.

The given ticks come hours apart, so a session is a week here and the spans of the rules are days; limits are 2.5 times and a
tenth of the last close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.q_stream import DAY, cooldown_sql
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables
from tessera.streaming import rules as ru

AGAIN = 2 * DAY
RULES = [ru.LimitMoves(0.05), ru.Surges(0.02, 1, DAY, AGAIN), ru.VolumeSurge(3.0), ru.VwapDeviation(0.01, AGAIN), ru.Chandelier(0.5), ru.GapEaten(0.6), ru.HoldingExpiry(2)]

#: Ticks by session, the reference from earlier sessions, the state as of each tick.
_STATE = """tk AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS session FROM ticks),
dy AS (SELECT code, session, max(last) AS hi, min(last) AS lo, arg_max(last, {'a': ts, 'b': event_id}) AS cl, arg_min(last, {'a': ts, 'b': event_id}) AS op FROM tk GROUP BY ALL),
dz AS (SELECT *, lag(cl) OVER w AS pre_close, row_number() OVER w AS n FROM dy WINDOW w AS (PARTITION BY code ORDER BY session)),
dr AS (SELECT *, greatest(hi - lo, abs(hi - pre_close), abs(lo - pre_close)) AS tr, cl / nullif(pre_close, 0) - 1 AS gain, CASE WHEN cl >= 1.5 * op THEN n END AS entered FROM dz),
rf AS (SELECT code, session, pre_close, pre_close * 2.5 AS high_limit, pre_close * 0.1 AS low_limit, avg(tr) OVER b AS atr, avg(gain) OVER b AS expected,
         n - max(entered) OVER (PARTITION BY code ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hold_days FROM dr WINDOW b AS (PARTITION BY code ORDER BY session ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
qa AS (SELECT tk.*, pre_close, high_limit, low_limit, atr, expected, hold_days, coalesce(last >= high_limit - 0.001, FALSE) AS up, coalesce(last <= low_limit + 0.001, FALSE) AS down,
         lag(last) OVER w AS prev, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_s, max(last) OVER s AS high, first_value(last) OVER s AS first, amount - lag(amount) OVER w AS delta,
         CASE WHEN amount <> 0 AND (NOT coalesce(last > 0, FALSE) OR amount / nullif(volume, 0) / last BETWEEN 0.5 AND 2) THEN amount / nullif(volume, 0) END AS vwap
       FROM tk LEFT JOIN rf USING (code, session) WINDOW w AS (PARTITION BY code, session ORDER BY ts, event_id), s AS (PARTITION BY code, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
qb AS (SELECT *, coalesce(max(up) OVER p, FALSE) AS was_up, first_value(CASE WHEN delta > 0 THEN delta END IGNORE NULLS) OVER (PARTITION BY code, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS base
       FROM qa WINDOW p AS (PARTITION BY code, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
qc AS (SELECT *, coalesce(max(NOT up AND was_up) OVER (PARTITION BY code, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS had_opened FROM qb)"""

#: kind: (how often, condition, value, what it is held against)
_KINDS = {
    "limit_up": ("once", "up", "last", "high_limit"),
    "limit_open": ("once", "NOT up AND was_up AND NOT had_opened", "last", "high_limit"),
    "near_limit_up": ("every", "NOT up AND NOT (was_up AND NOT had_opened) AND high_limit <> 0 AND last >= high_limit * 0.95", "last", "high_limit"),
    "limit_down": ("once", "down", "last", "low_limit"),
    "near_limit_down": ("every", "NOT down AND low_limit <> 0 AND last <= low_limit * 1.05", "last", "low_limit"),
    "surge_up": ("spaced", f"gap_s BETWEEN 1 AND {DAY} AND (last - prev) / nullif(prev, 0) >= 0.02", "(last - prev) / nullif(prev, 0)", "prev"),
    "surge_down": ("spaced", f"gap_s BETWEEN 1 AND {DAY} AND (last - prev) / nullif(prev, 0) <= -0.02", "(last - prev) / nullif(prev, 0)", "prev"),
    "volume_surge": ("once", "delta > 0 AND delta >= base * 3.0", "delta / nullif(base, 0)", "base"),
    "vwap_cheap": ("spaced", "vwap > 0 AND (last - vwap) / nullif(vwap, 0) <= -0.01", "(last - vwap) / nullif(vwap, 0)", "vwap"),
    "vwap_rich": ("spaced", "vwap > 0 AND (last - vwap) / nullif(vwap, 0) >= 0.01", "(last - vwap) / nullif(vwap, 0)", "vwap"),
    "chandelier_stop": ("once", "atr <> 0 AND last <= high - 0.5 * atr", "last", "high - 0.5 * atr"),
    "gap_eaten": ("once", "expected > 0 AND pre_close <> 0 AND (first / nullif(pre_close, 0) - 1) / nullif(expected, 0) >= 0.6", "(first / nullif(pre_close, 0) - 1) / nullif(expected, 0)", "expected"),
    "holding_expiry": ("once", "hold_days >= 2", "hold_days", "2"),
}
_LEVELS = {k.name: k.level for r in RULES for k in r.kinds}
COLUMNS = "code, session, event_id, kind, level, value, against"


def signals_sql(kinds: list[str]) -> str:
    """Common table expressions up to ``sig``, the signals of some kinds."""
    found = " UNION ALL ".join(f"SELECT code, session, ts, event_id, '{k}' AS kind, '{_LEVELS[k]}' AS level, CAST({v} AS DOUBLE) AS value, CAST({a} AS DOUBLE) AS against, '{how}' AS how FROM qc WHERE {c}" for k, (how, c, v, a) in _KINDS.items() if k in kinds)
    columns = f"{COLUMNS}, ts"
    once = f"SELECT {columns} FROM cand WHERE how = 'once' QUALIFY row_number() OVER (PARTITION BY code, session, kind ORDER BY ts, event_id) = 1"
    spaced = cooldown_sql("SELECT * FROM cand WHERE how = 'spaced'", "code, session, kind", AGAIN, columns, "a")
    head, _, last = spaced.rpartition(") SELECT ")
    return f"{_STATE}, cand AS MATERIALIZED ({found}), {head}), sig AS MATERIALIZED (SELECT {last} UNION ALL SELECT {columns} FROM cand WHERE how = 'every' UNION ALL {once})"


def _sql(kinds: list[str]) -> str:
    return f"WITH RECURSIVE {signals_sql(kinds)} SELECT {COLUMNS} FROM sig"


def quotes(t: Tables) -> DataFrame:
    """Ticks with their session and what is known before it."""
    ticks = t.ticks.withColumn("session", F.to_date(F.date_trunc("week", "ts")))
    return ticks.join(ru.session_reference(ticks, 2.5, 0.1, 3, 1.5), ["code", "session"], "left")


def signals(t: Tables, kinds: list[str]) -> DataFrame:
    rules = [r for r in RULES if any(k.name in kinds for k in r.kinds)]
    return ru.batch_signals(quotes(t), rules).filter(F.col("kind").isin(kinds))


def _register(name: str, kinds: list[str], says: str):
    def run(t: Tables) -> DataFrame:
        return signals(t, kinds).select(*COLUMNS.split(", "))

    run.__doc__ = says
    query(name, _sql(kinds))(run)


ALL = list(_KINDS)
_register("t05_limit_watch", ALL[:5], "Sealed at, opened from and near the limits.")
_register("t06_surges", ["surge_up", "surge_down"], "Moves against the previous tick, by direction, two days apart.")
_register("t07_volume_surges", ["volume_surge"], "The first growth of the amount in a session by three times the first one.")
_register("t08_vwap_deviation", ["vwap_cheap", "vwap_rich"], "Prices off the volume-weighted one, by side, two days apart.")
_register("t09_chandelier", ["chandelier_stop"], "The first fall in a session below the high so far, by the range of earlier sessions.")
_register("t10_gap_consumption", ["gap_eaten"], "Openings that used up the return expected before the session.")
_register("t11_holding_expiry", ["holding_expiry"], "Holdings at their age limit, on the session's first tick.")
_register("t12_dispatch", ALL, "All rules over one state.")

PASSED_ON = ["limit_up", "limit_open", "limit_down", "surge_up", "surge_down", "chandelier_stop", "gap_eaten", "holding_expiry"]
_LISTED = ", ".join(f"'{k}'" for k in PASSED_ON)
_PASSED = cooldown_sql(f"SELECT * FROM sig WHERE kind IN ({_LISTED})", "code, kind", 7 * DAY, "code, event_id, kind", "b")


@query("t13_notify", f"WITH RECURSIVE {signals_sql(ALL)}, {_PASSED}")
def notify(t: Tables) -> DataFrame:
    """Signals of the listed kinds, a week apart for each code and kind, over all sessions."""
    return ru.notifications(signals(t, ALL), PASSED_ON, 7 * DAY).select("code", "event_id", "kind")


_HEAD, _, _LAST = _PASSED.rpartition(") SELECT ")


@query("s17_ledger", f"WITH RECURSIVE {signals_sql(ALL)}, {_HEAD}), ntf AS (SELECT {_LAST}) SELECT CAST(ts AS DATE) AS day, sig.code, sig.event_id, sig.kind, level, value, ntf.kind IS NOT NULL AS notified FROM sig LEFT JOIN ntf ON ntf.code = sig.code AND ntf.event_id = sig.event_id AND ntf.kind = sig.kind")
def ledger(t: Tables) -> DataFrame:
    """Every signal under its day, with whether it was passed on."""
    all_ = signals(t, ALL)
    told = ru.notifications(all_, PASSED_ON, 7 * DAY).select("code", "event_id", "kind", F.lit(True).alias("told"))
    out = all_.join(told, ["code", "event_id", "kind"], "left")
    return out.select(F.to_date("ts").alias("day"), "code", "event_id", "kind", "level", "value", F.coalesce("told", F.lit(False)).alias("notified"))
