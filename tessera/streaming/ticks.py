"""Tick signals. Each has a batch form over a table of ticks (window functions); the keyed state, and the cooldowns that
depend on order, have a Structured Streaming form over the same columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def wt() -> WindowSpec:
    """The ticks of a code in arrival order."""
    return Window.partitionBy("code").orderBy("ts", "event_id")


def sofar() -> WindowSpec:
    return wt().rowsBetween(Window.unboundedPreceding, 0)


def intraday_state(ticks: DataFrame) -> DataFrame:
    """Adds previous quote and time, high and low so far, first price, volume-weighted price and amount change."""
    v = F.try_divide("amount", F.nullif("volume", F.lit(0.0)))
    near = F.try_divide(v, F.nullif("last", F.lit(0.0))).between(0.5, 2)
    return ticks.withColumns(
        {
            "prev": F.lag("last").over(wt()),
            "prev_ts": F.lag("ts").over(wt()),
            "high": F.max("last").over(sofar()),
            "low": F.min("last").over(sofar()),
            "first": F.first("last").over(sofar()),
            "vwap": F.when(near, v),
            "delta": F.col("amount") - F.lag("amount").over(wt()),
        }
    )


def once(df: DataFrame, condition: Column) -> DataFrame:
    """The first tick of each code for which a condition holds."""
    return df.filter(condition).withColumn("__n", F.row_number().over(wt())).filter("__n = 1").drop("__n")


def surge_candidates(state: DataFrame, share: float, longest_s: int) -> DataFrame:
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("prev_ts").cast("timestamp"))
    change = F.try_divide(F.col("last"), F.nullif("prev", F.lit(0.0))) - 1
    return state.withColumns({"change": change, "gap_s": gap}).filter((F.abs("change") >= share) & (F.col("gap_s") >= 1) & (F.col("gap_s") <= longest_s))


def cooldown(signals: DataFrame, seconds: int, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Drops signals that come within ``seconds`` after one that was kept. A key's signals pass in time order, batch by batch;
    only the last kept time is held, so a key may have any number of them. Null times never come first and are dropped."""
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            keep = []
            for *own, ts in pdf[[*keys, "ts"]].itertuples(index=False):
                if own != key:
                    key, last = own, None
                ok = last is None or (ts - last).total_seconds() >= seconds
                keep.append(ok)
                last = ts if ok else last
            yield pdf[keep]

    timed = signals.filter("ts is not null").repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")
    return timed.mapInPandas(run, signals.schema)


class PreviousTick(StatefulProcessor):
    """Streaming form of :func:`intraday_state` for the previous quote, high, low and first price of a code."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "prev double, high double, low double, first double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prev, high, low, first = self.state.get() if self.state.exists() else (None, None, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            high, low = max(r.last, r.last if high is None else high), min(r.last, r.last if low is None else low)
            first = r.last if first is None else first
            out.append((key[0], r.event_id, prev, high, low, first))
            prev = r.last
        self.state.update((prev, high, low, first))
        yield pd.DataFrame(out, columns=["code", "event_id", "prev", "high", "low", "first"])

    def close(self) -> None:
        pass


STATE = "code long, event_id long, prev double, high double, low double, first double"


def stream_state(ticks: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """The stateful stream: late ticks beyond the watermark are dropped, repeated ones too."""
    timed = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["code", "event_id"])
    return timed.groupBy("code").transformWithStateInPandas(PreviousTick(), STATE, "append", "None")
