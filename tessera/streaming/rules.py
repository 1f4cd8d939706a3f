"""Rules over quotes: one list of rules serves a table of ticks and a stream of ticks.

A rule names the kinds of signal it gives, each with a level and how often it may come: every tick, once in a session, or
again after some seconds. Its batch form is a condition over columns, its stream form a method over one quote; both see the
same state (:data:`STATE`), which holds nothing later than the tick. What a rule must know of earlier sessions comes from a
reference table joined by (code, session), see :func:`session_reference`.

The stream form is a ``StatefulProcessor``. Ticks wait in a list until the watermark has passed them, then an event-time
timer hands them to the rules in the order of (time, id); so ticks that come out of order within the delay give the signals
they give in a table, repeated ones count once, and later ones are dropped by the watermark. A session's state is cleared by
the next session's first tick, or by a timer once the session has ended.

A null price gives no price signal but is the previous price of the next tick; null amounts give no volume signal. Ticks
with a null time are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.ticks import cooldown

#: What a tick must carry, and what the reference adds; all nullable.
TICK = "code long, session date, ts timestamp, event_id long, last double, volume double, amount double"
REFERENCE = "pre_close double, high_limit double, low_limit double, atr double, expected double, hold_days long"
#: The state that both forms keep for a code and session, as of the tick.
STATE = ("prev", "gap_s", "high", "first", "delta", "base", "vwap", "was_up", "had_opened")

EVERY, ONCE = 0, -1


@dataclass(frozen=True)
class Kind:
    """A kind of signal; ``again`` is EVERY, ONCE a session, or the seconds that must pass."""

    name: str
    level: str
    again: int = ONCE


class Rule:
    """Subclass it, give ``kinds``, and write both forms."""

    kinds: tuple[Kind, ...] = ()

    def conditions(self) -> dict[str, tuple[Column, Column, Column]]:
        """By kind: the condition, the value that met it, and what it was held against."""
        raise NotImplementedError

    def on_quote(self, q: SimpleNamespace) -> Iterator[tuple[str, float | None, float | None]]:
        """The same over one quote with its state: kind, value, what it was held against."""
        raise NotImplementedError


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, b)


def is_up() -> Column:
    return F.coalesce(F.col("last") >= F.col("high_limit") - 0.001, F.lit(False))


def is_down() -> Column:
    return F.coalesce(F.col("last") <= F.col("low_limit") + 0.001, F.lit(False))


@dataclass
class LimitMoves(Rule):
    """Sealed at the limit, opened after a seal, and near the limit; down without the opening."""

    near: float = 0.01
    kinds: tuple[Kind, ...] = (Kind("limit_up", "strong"), Kind("limit_open", "strong"), Kind("near_limit_up", "warn", EVERY), Kind("limit_down", "strong"), Kind("near_limit_down", "warn", EVERY))

    def conditions(self):
        last, hi, lo = F.col("last"), F.col("high_limit"), F.col("low_limit")
        opens = ~is_up() & F.col("was_up") & ~F.col("had_opened") & last.isNotNull()
        close_up = ~is_up() & ~opens & (hi != 0) & (last >= hi * (1 - self.near))
        close_down = ~is_down() & (lo != 0) & (last <= lo * (1 + self.near))
        return {"limit_up": (is_up(), last, hi), "limit_open": (opens, last, hi), "near_limit_up": (close_up, last, hi), "limit_down": (is_down(), last, lo), "near_limit_down": (close_down, last, lo)}

    def on_quote(self, q):
        if q.last is None:
            return
        if q.up:
            yield "limit_up", q.last, q.high_limit
        elif q.was_up and not q.had_opened:
            yield "limit_open", q.last, q.high_limit
        elif q.high_limit and q.last >= q.high_limit * (1 - self.near):
            yield "near_limit_up", q.last, q.high_limit
        if q.down:
            yield "limit_down", q.last, q.low_limit
        elif q.low_limit and q.last <= q.low_limit * (1 + self.near):
            yield "near_limit_down", q.last, q.low_limit


@dataclass
class Surges(Rule):
    """A move of ``share`` or more against the previous tick, ``least_s`` to ``most_s`` after it."""

    share: float = 0.02
    least_s: float = 1.0
    most_s: float = 60.0
    again: int = 60

    @property
    def kinds(self):
        return Kind("surge_up", "warn", self.again), Kind("surge_down", "warn", self.again)

    def conditions(self):
        move, timely = _share(F.col("last"), F.col("prev")), F.col("gap_s").between(self.least_s, self.most_s)
        return {"surge_up": (timely & (move >= self.share), move, F.col("prev")), "surge_down": (timely & (move <= -self.share), move, F.col("prev"))}

    def on_quote(self, q):
        if q.last is None or not q.prev or not self.least_s <= q.gap_s <= self.most_s:
            return
        move = (q.last - q.prev) / q.prev
        if move >= self.share:
            yield "surge_up", move, q.prev
        elif move <= -self.share:
            yield "surge_down", move, q.prev


@dataclass
class VolumeSurge(Rule):
    """An amount that grows by ``times`` the first growth of the session or more."""

    times: float = 3.0
    kinds: tuple[Kind, ...] = (Kind("volume_surge", "warn"),)

    def conditions(self):
        return {"volume_surge": ((F.col("delta") > 0) & (F.col("delta") >= F.col("base") * self.times), F.try_divide("delta", "base"), F.col("base"))}

    def on_quote(self, q):
        if q.base is not None and q.delta is not None and q.delta > 0 and q.delta >= q.base * self.times:
            yield "volume_surge", q.delta / q.base, q.base


@dataclass
class VwapDeviation(Rule):
    """A price ``share`` or more away from the volume-weighted one, cheap or rich."""

    share: float = 0.01
    again: int = 300

    @property
    def kinds(self):
        return Kind("vwap_cheap", "info", self.again), Kind("vwap_rich", "info", self.again)

    def conditions(self):
        off = _share(F.col("last"), F.col("vwap"))
        return {"vwap_cheap": ((F.col("vwap") > 0) & (off <= -self.share), off, F.col("vwap")), "vwap_rich": ((F.col("vwap") > 0) & (off >= self.share), off, F.col("vwap"))}

    def on_quote(self, q):
        if q.last is None or q.vwap is None or q.vwap <= 0:
            return
        off = (q.last - q.vwap) / q.vwap
        if off <= -self.share:
            yield "vwap_cheap", off, q.vwap
        elif off >= self.share:
            yield "vwap_rich", off, q.vwap


@dataclass
class Chandelier(Rule):
    """A price ``k`` true ranges of earlier sessions below the session's high so far."""

    k: float = 3.0
    kinds: tuple[Kind, ...] = (Kind("chandelier_stop", "strong"),)

    def conditions(self):
        line = F.col("high") - self.k * F.col("atr")
        return {"chandelier_stop": ((F.col("atr") != 0) & (F.col("last") <= line), F.col("last"), line)}

    def on_quote(self, q):
        if q.last is not None and q.high is not None and q.atr:
            line = q.high - self.k * q.atr
            if q.last <= line:
                yield "chandelier_stop", q.last, line


@dataclass
class GapEaten(Rule):
    """An opening that has used up ``share`` of the expected return, known before the session, or more."""

    share: float = 0.6
    kinds: tuple[Kind, ...] = (Kind("gap_eaten", "warn"),)

    def conditions(self):
        eaten = (F.try_divide("first", "pre_close") - 1) / F.nullif("expected", F.lit(0.0))
        return {"gap_eaten": ((F.col("expected") > 0) & (F.col("pre_close") != 0) & (eaten >= self.share), eaten, F.col("expected"))}

    def on_quote(self, q):
        if q.first is not None and q.pre_close and q.expected and q.expected > 0:
            eaten = (q.first / q.pre_close - 1) / q.expected
            if eaten >= self.share:
                yield "gap_eaten", eaten, q.expected


@dataclass
class HoldingExpiry(Rule):
    """A holding that is ``sessions`` old or older; what isn't held has no age."""

    sessions: int = 1
    kinds: tuple[Kind, ...] = (Kind("holding_expiry", "strong"),)

    def conditions(self):
        return {"holding_expiry": (F.col("hold_days") >= self.sessions, F.col("hold_days").cast("double"), F.lit(float(self.sessions)))}

    def on_quote(self, q):
        if q.hold_days is not None and q.hold_days >= self.sessions:
            yield "holding_expiry", float(q.hold_days), float(self.sessions)


def standard_rules() -> list[Rule]:
    return [LimitMoves(), Surges(), VolumeSurge(), VwapDeviation(), Chandelier(), GapEaten(), HoldingExpiry()]


# ---- reference and batch form ----------------------------------------------------------------------------------------


def session_reference(ticks: DataFrame, up: float, down: float, sessions: int, entry: float) -> DataFrame:
    """(code, session, pre_close, limits, atr, expected, hold_days), all from earlier sessions: the last close, that close
    times ``up`` and ``down`` as limits, means of true range and return over ``sessions`` of them, and the age of a holding
    that was entered in the latest one that closed ``entry`` times its first price or higher."""
    at = F.struct("ts", "event_id")
    price = F.when(F.col("last").isNotNull(), at)
    day = ticks.groupBy("code", "session").agg(F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", price).alias("close"), F.min_by("last", price).alias("open"))
    w = Window.partitionBy("code").orderBy("session")
    before = w.rowsBetween(-sessions, -1)
    day = day.withColumns({"pre_close": F.lag("close").over(w), "n": F.row_number().over(w)})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pre_close")), F.abs(F.col("low") - F.col("pre_close")))
    entered = F.when(F.col("close") >= entry * F.col("open"), F.col("n"))
    day = day.withColumns({"tr": tr, "gain": F.try_divide("close", "pre_close") - 1, "entered": entered})
    return day.select(
        "code", "session", "pre_close", (F.col("pre_close") * up).alias("high_limit"), (F.col("pre_close") * down).alias("low_limit"),
        F.avg("tr").over(before).alias("atr"), F.avg("gain").over(before).alias("expected"),
        (F.col("n") - F.max("entered").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("long").alias("hold_days"),
    )


def with_state(quotes: DataFrame) -> DataFrame:
    """Adds the columns of :data:`STATE` to ticks that carry their reference. One sort by code and session."""
    w = Window.partitionBy("code", "session").orderBy("ts", "event_id")
    past, sofar = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    v = F.try_divide("amount", F.nullif("volume", F.lit(0.0)))
    # both sides of the "or" may be computed for every row, so a price of zero must not fail the division
    sane = ~F.coalesce(F.col("last") > 0, F.lit(False)) | F.try_divide(v, "last").between(0.5, 2.0)
    q = quotes.filter("ts is not null").withColumns(
        {
            "prev": F.lag("last").over(w),
            "gap_s": (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1e6,
            "high": F.max("last").over(sofar),
            "first": F.first("last", ignorenulls=True).over(sofar),
            "delta": F.col("amount") - F.lag("amount").over(w),
            "vwap": F.when((F.col("amount") != 0) & sane, v),
            "was_up": F.coalesce(F.max(is_up()).over(past), F.lit(False)),
        }
    )
    opens = ~is_up() & F.col("was_up") & F.col("last").isNotNull()
    return q.withColumns({"base": F.first(F.when(F.col("delta") > 0, F.col("delta")), ignorenulls=True).over(sofar), "had_opened": F.coalesce(F.max(opens).over(past), F.lit(False))})


SIGNAL = "code long, session date, ts timestamp, event_id long, kind string, level string, value double, against double"


def batch_signals(quotes: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """All signals of a table of ticks with their reference."""
    hits, often = [], {}
    for rule in rules:
        levels = {k.name: k for k in rule.kinds}
        for kind, (condition, value, against) in rule.conditions().items():
            often[kind] = levels[kind].again
            hits.append(F.when(condition, F.struct(F.lit(kind).alias("kind"), F.lit(levels[kind].level).alias("level"), value.cast("double").alias("value"), against.cast("double").alias("against"))))
    found = with_state(quotes).select("code", "session", "ts", "event_id", F.explode(F.array_compact(F.array(*hits))).alias("s")).select("code", "session", "ts", "event_id", "s.*")
    of = lambda keep: [k for k, a in often.items() if keep(a)]
    out = found.filter(F.col("kind").isin(of(lambda a: a == EVERY)))
    first = F.row_number().over(Window.partitionBy("code", "session", "kind").orderBy("ts", "event_id"))
    out = out.union(found.filter(F.col("kind").isin(of(lambda a: a == ONCE))).withColumn("__n", first).filter("__n = 1").drop("__n"))
    for seconds in sorted({a for a in often.values() if a > 0}):
        spaced = found.filter(F.col("kind").isin(of(lambda a: a == seconds)))  # noqa: B023
        out = out.union(cooldown(spaced, seconds, ("code", "session", "kind")))
    return out


def notifications(signals: DataFrame, kinds: Iterable[str], seconds: int) -> DataFrame:
    """The signals that are passed on: of the listed kinds, and not within ``seconds`` after one of the code and kind."""
    return cooldown(signals.filter(F.col("kind").isin(list(kinds))), seconds, ("code", "kind"))


# ---- stream form -----------------------------------------------------------------------------------------------------

_QUOTE = [c.split()[0] for c in REFERENCE.split(", ")]
_WAITING = f"session int, ts long, event_id long, last double, volume double, amount double, {REFERENCE}"
_OUT = "code long, session int, us long, event_id long, kind string, level string, value double, against double"
_HELD = "session int, last double, ts long, amount double, high double, first double, base double, was_up boolean, had_opened boolean"


@dataclass
class _Held:
    """The state of a session as it is stored."""

    session: int | None = None
    last: float | None = None
    ts: int | None = None
    amount: float | None = None
    high: float | None = None
    first: float | None = None
    base: float | None = None
    was_up: bool = False
    had_opened: bool = False
    fired: dict[str, int] = field(default_factory=dict)

    def take(self, t: tuple) -> SimpleNamespace:
        """The quote of the next tick; this object then holds what the one after it needs."""
        _, ts, _, last, volume, amount, *reference = t
        q = SimpleNamespace(last=last, **dict(zip(_QUOTE, reference, strict=True)))
        q.prev, q.gap_s = self.last, None if self.ts is None else (ts - self.ts) / 1e6
        q.delta = None if amount is None or self.amount is None else amount - self.amount
        if last is not None:
            self.high = last if self.high is None else max(last, self.high)
            self.first = last if self.first is None else self.first
        if self.base is None and q.delta is not None and q.delta > 0:
            self.base = q.delta
        q.high, q.first, q.base, q.vwap = self.high, self.first, self.base, None
        if amount and volume:
            v = amount / volume
            q.vwap = v if last is None or last <= 0 or 0.5 <= v / last <= 2.0 else None
        q.up = last is not None and q.high_limit is not None and last >= q.high_limit - 0.001
        q.down = last is not None and q.low_limit is not None and last <= q.low_limit + 0.001
        q.was_up, q.had_opened = self.was_up, self.had_opened
        self.had_opened = self.had_opened or (self.was_up and not q.up and last is not None)
        self.was_up = self.was_up or q.up
        self.last, self.ts, self.amount = last, ts, amount
        return q


class RuleProcessor(StatefulProcessor):
    """Holds the ticks of a code until the watermark has passed them, then runs the rules over them in order.

    ``session_ms`` is the length of a session: a code that falls silent is forgotten so long after its last tick."""

    def __init__(self, rules: list[Rule], session_ms: int) -> None:
        self.rules, self.session_ms = rules, session_ms
        self.kinds = {k.name: k for r in rules for k in r.kinds}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.held = handle.getValueState("held", _HELD)
        self.fired = handle.getMapState("fired", "kind string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            # a null anywhere in a batch makes floats of whole numbers
            whole = [[None if x is None or x != x else int(x) for x in pdf[c]] for c in ("session", "us", "event_id", "hold_days")]
            prices = [[None if x is None or x != x else float(x) for x in pdf[c]] for c in ("last", "volume", "amount", *_QUOTE[:-1])]
            new += zip(*whole[:3], *prices, whole[3], strict=True)
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(t[1] for t in new) // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted({t[2]: t for t in map(tuple, waiting) if t[1] <= passed}.values(), key=lambda t: t[1:3])
        later = [tuple(t) for t in waiting if t[1] > passed]
        held = _Held(*self.held.get()) if self.held.exists() else _Held()
        held.fired = {k[0]: v[0] for k, v in self.fired.iterator()} if self.fired.exists() else {}
        if not ready:
            if not later and held.ts is not None and held.ts // 1000 + self.session_ms <= timerValues.getCurrentWatermarkInMs():
                self.held.clear()
                self.fired.clear()
            elif later:
                self.handle.registerTimer(min(t[1] for t in later) // 1000 + 1)
            yield pd.DataFrame()
            return
        out = []
        for t in ready:
            if held.session != t[0]:
                held = _Held(session=t[0])
            q = held.take(t)
            for rule in self.rules:
                for kind, value, against in rule.on_quote(q):
                    k, last = self.kinds[kind], held.fired.get(kind)
                    if k.again == EVERY or last is None or (k.again > 0 and t[1] - last >= k.again * 1_000_000):
                        held.fired[kind] = t[1]
                        out.append((key[0], t[0], t[1], t[2], kind, k.level, value, against))
        self.held.update((held.session, held.last, held.ts, held.amount, held.high, held.first, held.base, held.was_up, held.had_opened))
        self.fired.clear()
        for kind, at in held.fired.items():
            self.fired.updateValue((kind,), (at,))
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
            self.handle.registerTimer(min(t[1] for t in later) // 1000 + 1)
        else:
            self.handle.registerTimer(held.ts // 1000 + self.session_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_signals(ticks: DataFrame, reference: DataFrame, rules: list[Rule], delay: str = "10 minutes", session_ms: int = 86_400_000) -> DataFrame:
    """Signals of a stream of ticks (:data:`TICK`); ``reference`` is a table that is joined by code and session."""
    both = ticks.filter("ts is not null and code is not null").join(reference, ["code", "session"], "left")
    timed = both.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # days and microseconds are numbers in the state, so that the session's time zone doesn't matter there
    named = timed.select("ts", "code", F.unix_date("session").alias("session"), F.unix_micros("ts").alias("us"), "event_id", "last", "volume", "amount", *_QUOTE)
    found = named.groupBy("code").transformWithStateInPandas(RuleProcessor(list(rules), session_ms), _OUT, "append", "EventTime")
    return found.select("code", F.date_from_unix_date("session").alias("session"), F.timestamp_micros("us").alias("ts"), "event_id", "kind", "level", "value", "against")


# ---- ledger ----------------------------------------------------------------------------------------------------------


TO_THE_MICROSECOND = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def ledger_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch owns one part of each day (JSON lines under day=.../batch=...) and replaces it when
    it is run again, so a restart in the middle leaves every signal once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(batch_id)})
        rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").mode("overwrite").option("timestampFormat", TO_THE_MICROSECOND).json(folder)

    return write


def read_ledger(spark, folder: str) -> DataFrame:
    """The ledger's signals, with the day they were recorded under."""
    return spark.read.schema(f"{SIGNAL}, day date, batch long").option("timestampFormat", TO_THE_MICROSECOND).json(folder).drop("batch")
