"""Queries of the time-series windows (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import indicators
from tessera.functions.ewm import ewm_columns
from tessera.functions.rolling import change, forward, gap, position_in_range, roll, true_range, wc
from tessera.operators import asof
from tessera.operators.tradability import tradability
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

W = "PARTITION BY code ORDER BY date"


def over(f: str, x: str, n: int, least: int | None = None) -> str:
    """DuckDB text of a guarded rolling aggregate."""
    w = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {f}({x}) {w} END"


def ewm(x: str, alpha: float) -> str:
    """DuckDB text of an EWM (adjust=False) without nulls: the weighted list of the last rows, the first row with its full weight."""
    back = int(40 / alpha)
    items = f"list({x}) OVER ({W} ROWS {back} PRECEDING)"
    return f"list_sum(list_transform({items}, lambda v, i: v * pow({1 - alpha!r}, len({items}) - i) * CASE WHEN i = 1 THEN 1 ELSE {alpha!r} END))"


@query("w01_returns", f"SELECT code, date, {', '.join(f'close / lag(close, {n}) OVER ({W}) - 1 AS ret_{n}d' for n in (1, 3, 5, 10, 20, 60))} FROM bars")
def returns(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", *(change("close", n).alias(f"ret_{n}d") for n in (1, 3, 5, 10, 20, 60)))


@query("w02_ma_gap", f"SELECT code, date, {', '.join(f'close / ({over("avg", "close", n)}) - 1 AS gap_{n}' for n in (5, 10, 20, 60))} FROM bars")
def ma_gap(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", *(gap("close", n).alias(f"gap_{n}") for n in (5, 10, 20, 60)))


@query("w03_volatility", f"WITH r AS (SELECT code, date, close / lag(close) OVER ({W}) - 1 AS r FROM bars) SELECT code, date, {over('stddev_samp', 'r', 10)} AS vol_10, {over('stddev_samp', 'r', 20)} AS vol_20 FROM r")
def volatility(t: Tables) -> DataFrame:
    r = t.bars.select("code", "date", change("close", 1).alias("r"))
    return r.select("code", "date", roll(F.stddev_samp, "r", 10).alias("vol_10"), roll(F.stddev_samp, "r", 20).alias("vol_20"))


@query("w04_volume_ratio", f"SELECT code, date, volume / ({over('avg', 'volume', 5)}) AS ratio_5, volume / ({over('avg', 'volume', 20)}) AS ratio_20 FROM bars")
def volume_ratio(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", *(F.try_divide("volume", roll(F.avg, "volume", n)).alias(f"ratio_{n}") for n in (5, 20)))


@query("w05_drawdown_position", f"SELECT code, date, close / ({over('max', 'high', 20)}) - 1 AS drawdown, (close - ({over('min', 'low', 20)})) / nullif(({over('max', 'high', 20)}) - ({over('min', 'low', 20)}), 0) AS position FROM bars")
def drawdown_position(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", (F.try_divide("close", roll(F.max, "high", 20)) - 1).alias("drawdown"), position_in_range("close", "high", "low", 20).alias("position"))


@query("w06_adjusted_return", f"WITH r AS (SELECT code, date, close / lag(close) OVER ({W}) - 1 AS r, close / lag(close, 20) OVER ({W}) - 1 AS r20 FROM bars) SELECT code, date, r20 / nullif({over('stddev_samp', 'r', 20)}, 0) AS x FROM r")
def adjusted_return(t: Tables) -> DataFrame:
    r = t.bars.select("code", "date", change("close", 1).alias("r"), change("close", 20).alias("r20"))
    return r.select("code", "date", F.try_divide("r20", F.nullif(roll(F.stddev_samp, "r", 20), F.lit(0.0))).alias("x"))


@query("w07_ewm", f"SELECT code, date, {ewm('close', 0.15)} AS ewm_15, {ewm('volume', 0.3)} AS ewm_30 FROM bars")
def ewm_query(t: Tables) -> DataFrame:
    return ewm_columns(t.bars.select("code", "date", "close", "volume"), {"ewm_15": ("close", 0.15, 0), "ewm_30": ("volume", 0.3, 0)}).drop("close", "volume")


@query("w08_macd_panel", f"WITH a AS (SELECT code, date, row_number() OVER ({W}) AS n, {ewm('close', 2 / 13)} - {ewm('close', 2 / 27)} AS dif FROM bars), f AS (SELECT * FROM a WHERE n >= 26), b AS (SELECT code, date, n, dif, row_number() OVER ({W}) AS m, {ewm('dif', 0.2)} AS dea FROM f) SELECT code, date, dif, CASE WHEN m >= 9 THEN dea END AS dea, CASE WHEN m >= 9 THEN dif - dea END AS hist FROM b")
def macd_panel(t: Tables) -> DataFrame:
    x = ewm_columns(t.bars.select("code", "date", "close"), {"fast": ("close", 2 / 13, 12), "slow": ("close", 2 / 27, 26)})
    x = x.withColumn("dif", F.col("fast") - F.col("slow"))
    x = ewm_columns(x.filter("dif is not null"), {"dea": ("dif", 0.2, 9)})
    return x.select("code", "date", "dif", "dea", (F.col("dif") - F.col("dea")).alias("hist"))


@query("w09_range_gap", f"WITH g AS (SELECT code, date, (high - low) / close AS range, open / lag(close) OVER ({W}) - 1 AS gap FROM bars) SELECT code, date, range, gap, {over('avg', 'gap', 5, 2)} AS gap_mean, {over('stddev_samp', 'gap', 20, 5)} AS gap_std FROM g")
def range_gap(t: Tables) -> DataFrame:
    g = t.bars.select("code", "date", ((F.col("high") - F.col("low")) / F.col("close")).alias("range"), (F.try_divide("open", F.lag("close").over(wc())) - 1).alias("gap"))
    return g.select("code", "date", "range", "gap", roll(F.avg, "gap", 5, 2).alias("gap_mean"), roll(F.stddev_samp, "gap", 20, 5).alias("gap_std"))


@query("w10_changes", f"SELECT code, date, amount / nullif(lag(amount, 5) OVER ({W}), 0) - 1 AS amount_change, volume - lag(volume, 5) OVER ({W}) AS volume_change FROM bars")
def changes(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", change("amount", 5).alias("amount_change"), (F.col("volume") - F.lag("volume", 5).over(wc())).alias("volume_change"))


_TP = "(high + low + close) / 3"


@query("w13_window_indicators", f"""WITH l AS (SELECT *, {_TP} AS tp, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr, coalesce(sign(close - lag(close) OVER ({W})), 0) AS step FROM bars),
m AS (SELECT *, avg(tp) OVER ({W} ROWS 13 PRECEDING) AS tpm, list(tp) OVER ({W} ROWS 13 PRECEDING) AS tps FROM l)
SELECT code, date, {', '.join(f'{over("avg", "close", n)} AS ma{n}' for n in (5, 10, 20, 60))}, {', '.join(f'100 * (close / ({over("avg", "close", n)}) - 1) AS bias{n}' for n in (6, 12, 24))},
-100 * (1 - (close - ({over('min', 'low', 14)})) / nullif(({over('max', 'high', 14)}) - ({over('min', 'low', 14)}), 0)) AS williams, 100 * (close / lag(close, 12) OVER ({W}) - 1) AS roc12,
CASE WHEN len(tps) = 14 THEN (tp - tpm) / nullif(0.015 * list_avg([abs(v - tpm) FOR v IN tps]), 0) END AS cci14, {over('avg', 'tr', 14)} AS atr14, volume / ({over('avg', 'volume', 5)}) AS volume_ratio, sum(step * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM m""")
def window_indicators(t: Tables) -> DataFrame:
    return indicators.window_indicators(t.bars)


def _rsi(n: int) -> str:
    return f"coalesce(100 - 100 / (1 + ({ewm('up', 1 / n)}) / nullif({ewm('down', 1 / n)}, 0)), 100) AS rsi{n}"


@query("w14_ewm_indicators", f"""WITH x AS (SELECT code, date, close, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr0, high - low AS hl, close - lag(close) OVER ({W}) AS diff, coalesce(100 * (close - min(low) OVER ({W} ROWS 8 PRECEDING)) / nullif(max(high) OVER ({W} ROWS 8 PRECEDING) - min(low) OVER ({W} ROWS 8 PRECEDING), 0), 50) AS rsv FROM bars),
y AS (SELECT *, coalesce(tr0, hl) AS tr, greatest(diff, 0) AS up, greatest(-diff, 0) AS down FROM x),
a AS (SELECT code, date, {ewm('close', 2 / 13)} - {ewm('close', 2 / 27)} AS dif, {ewm('rsv', 1 / 3)} AS k, {ewm('tr', 1 / 14)} AS atr FROM y),
r AS (SELECT code, date, {', '.join(_rsi(n) for n in (6, 12, 24))} FROM y WHERE diff IS NOT NULL),
b AS (SELECT code, date, dif, k, atr, {ewm('dif', 0.2)} AS dea, {ewm('k', 1 / 3)} AS d FROM a)
SELECT code, date, dif, dea, 2 * (dif - dea) AS hist, k, d, 3 * k - 2 * d AS j, coalesce(rsi6, 100) AS rsi6, coalesce(rsi12, 100) AS rsi12, coalesce(rsi24, 100) AS rsi24, atr FROM b LEFT JOIN r USING (code, date)""")
def ewm_indicators(t: Tables) -> DataFrame:
    return indicators.ewm_indicators(t.bars)


@query("w23_sessions_since", f"WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM calendar) SELECT code, date, ord - lag(ord) OVER ({W}) AS sessions FROM bars JOIN c USING (date)")
def sessions_since(t: Tables) -> DataFrame:
    numbered = t.bars.select("code", "date").join(asof.session_number(t.calendar), "date")
    return numbered.select("code", "date", (F.col("ord") - F.lag("ord").over(wc())).cast("long").alias("sessions"))


@query("w24_event_counts", f"WITH e AS (SELECT code, date, count(ann_date) AS n FROM bars LEFT JOIN reports r USING (code) WHERE r.ann_date = bars.date GROUP BY ALL), j AS (SELECT b.code, b.date, coalesce(n, 0) AS n FROM bars b LEFT JOIN e USING (code, date)) SELECT code, date, (sum(n) OVER ({W} ROWS 4 PRECEDING))::BIGINT AS events_5, (sum(n) OVER ({W} ROWS 19 PRECEDING))::BIGINT AS events_20 FROM j")
def event_counts(t: Tables) -> DataFrame:
    e = t.reports.groupBy("code", F.col("ann_date").alias("date")).agg(F.count("*").alias("n"))
    j = t.bars.select("code", "date").join(e, ["code", "date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("code", "date", F.sum("n").over(wc().rowsBetween(-4, 0)).alias("events_5"), F.sum("n").over(wc().rowsBetween(-19, 0)).alias("events_20"))


@query("w25_forward_returns", f"SELECT code, date, {', '.join(f'lead(close, {h}) OVER ({W}) / close - 1 AS target_ret_{h}d' for h in (1, 3, 5))}, lead(open, 4) OVER ({W}) / lead(open, 1) OVER ({W}) - 1 AS open_ret_3d FROM bars")
def forward_returns(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", *(forward("close", h).alias(f"target_ret_{h}d") for h in (1, 3, 5)), forward("open", 4, F.lead("open", 1).over(wc())).alias("open_ret_3d"))


def _sell(h: int, cap: int = 3) -> str:
    first = ", ".join(f"CASE WHEN coalesce(lead(sellable, {k}) OVER w, FALSE) THEN lead(close, {k}) OVER w END" for k in range(h, h + cap))
    last = ", ".join(f"CASE WHEN coalesce(lead(ok, {k}) OVER w, FALSE) THEN lead(close, {k}) OVER w END" for k in range(h + cap - 1, h - 1, -1))
    return f"CASE WHEN lead(close, {h}) OVER w IS NOT NULL THEN coalesce({first}, {last}) END / close - 1 AS tradable_ret_{h}d"


@query("w29_tradability", f"""WITH a AS (SELECT b.*, s.is_suspended, close / lag(close) OVER (PARTITION BY b.code ORDER BY b.date) - 1 AS ret, CASE WHEN count(amount) OVER (PARTITION BY b.code ORDER BY b.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN avg(amount) OVER (PARTITION BY b.code ORDER BY b.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS adv20 FROM bars b LEFT JOIN status s USING (code, date)),
m AS (SELECT *, volume > 0 AND coalesce(NOT is_suspended, FALSE) AS ok, coalesce(close = high AND ret >= 0.095, FALSE) AS sealed, coalesce(close = low AND ret <= -0.095, FALSE) AS down FROM a), n AS (SELECT *, ok AND NOT down AS sellable FROM m)
SELECT code, date, adv20, ok AND NOT sealed AND coalesce(adv20, 0) >= 0 AS buyable_close, coalesce(lead(ok) OVER w AND NOT lead(sealed AND low = high) OVER w, FALSE) AS buyable_next, {_sell(1)}, {_sell(3)}, {_sell(5)} FROM n WINDOW w AS ({W})""")
def tradability_query(t: Tables) -> DataFrame:
    return tradability(t.bars, t.status)


@query("w33_money_flow", f"SELECT code, date, coalesce(sign(close - lag(close) OVER ({W})), 0) * amount AS flow FROM bars")
def money_flow(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", (F.coalesce(F.signum(F.col("close") - F.lag("close").over(wc())), F.lit(0.0)) * F.col("amount")).alias("flow"))


@query("w34_flow_score", f"WITH x AS (SELECT code, date, close / lag(close) OVER ({W}) - 1 AS r1, close / lag(close, 5) OVER ({W}) - 1 AS r5, avg(amount) OVER ({W} ROWS 4 PRECEDING) / avg(amount) OVER ({W} ROWS 19 PRECEDING) AS heat, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM bars) SELECT code, date, least(greatest(CASE WHEN r1 > 0.02 THEN 1 WHEN r1 < -0.02 THEN -1 ELSE 0 END + CASE WHEN r5 > 0.05 THEN 1 WHEN r5 < -0.05 THEN -1 ELSE 0 END + CASE WHEN heat > 1.2 AND r5 > 0 THEN 1 WHEN heat > 1.2 AND r5 < 0 THEN -1 ELSE 0 END, -2), 2) AS score FROM x WHERE n = 1")
def flow_score(t: Tables) -> DataFrame:
    last = Window.partitionBy("code").orderBy(F.desc("date"))
    x = t.bars.select("code", "date", change("close", 1).alias("r1"), change("close", 5).alias("r5"), F.try_divide(F.avg("amount").over(wc().rowsBetween(-4, 0)), F.avg("amount").over(wc().rowsBetween(-19, 0))).alias("heat"), F.row_number().over(last).alias("n"))
    side = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
    score = side(F.col("r1") > 0.02, F.col("r1") < -0.02) + side(F.col("r5") > 0.05, F.col("r5") < -0.05) + side((F.col("heat") > 1.2) & (F.col("r5") > 0), (F.col("heat") > 1.2) & (F.col("r5") < 0))
    return x.filter("n = 1").select("code", "date", F.least(F.greatest(score, F.lit(-2)), F.lit(2)).alias("score"))


@query("w36_risk_levels", f"WITH x AS (SELECT code, date, close, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM bars), y AS (SELECT *, {over('avg', 'tr', 14)} AS atr, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM x) SELECT code, close - 2 * atr AS stop, close + 1.5 * atr AS target_1, close + 3 * atr AS target_2, (3 * atr) / nullif(2 * atr, 0) AS reward_risk FROM y WHERE n = 1")
def risk_levels(t: Tables) -> DataFrame:
    last = Window.partitionBy("code").orderBy(F.desc("date"))
    x = t.bars.select("code", "date", "close", true_range().alias("tr"))
    y = x.select("code", "close", roll(F.avg, "tr", 14).alias("atr"), F.row_number().over(last).alias("n")).filter("n = 1")
    c, a = F.col("close"), F.col("atr")
    return y.select("code", (c - 2 * a).alias("stop"), (c + 1.5 * a).alias("target_1"), (c + 3 * a).alias("target_2"), F.try_divide(3 * a, F.nullif(2 * a, F.lit(0.0))).alias("reward_risk"))


@query("w37_index_trend", f"WITH i AS (SELECT 'ALL' AS code, date, avg(close) AS close FROM bars GROUP BY date), x AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS pct, close / lag(close, 3) OVER (ORDER BY date) - 1 AS cum3, avg(close) OVER (ORDER BY date ROWS 4 PRECEDING) AS ma5 FROM i) SELECT date, pct, cum3, CASE WHEN ma5 > lag(ma5) OVER (ORDER BY date) THEN 'up' WHEN ma5 < lag(ma5) OVER (ORDER BY date) THEN 'down' ELSE 'flat' END AS slope FROM x")
def index_trend(t: Tables) -> DataFrame:
    i = t.bars.groupBy(F.lit("ALL").alias("code"), "date").agg(F.avg("close").alias("close"))
    x = i.select("code", "date", change("close", 1).alias("pct"), change("close", 3).alias("cum3"), F.avg("close").over(wc().rowsBetween(-4, 0)).alias("ma5"))
    before = F.lag("ma5").over(wc())
    return x.select("date", "pct", "cum3", F.when(F.col("ma5") > before, "up").when(F.col("ma5") < before, "down").otherwise("flat").alias("slope"))


@query("w39_sale_marks", "WITH s AS (SELECT code, date AS sold FROM bars WHERE amount > 150000) SELECT s.code, s.sold, b.date, b.close, b.n FROM s JOIN LATERAL (SELECT date, close, row_number() OVER (ORDER BY date) AS n FROM bars WHERE bars.code = s.code AND bars.date >= s.sold) b ON b.n <= 4")
def sale_marks(t: Tables) -> DataFrame:
    """The bar of a sale and the three after it, by one pass of leads over the bars."""
    b = t.bars.select("code", "date", "close", "amount")
    ahead = F.array(*(F.struct(F.lead("date", k).over(wc()).alias("date"), F.lead("close", k).over(wc()).alias("close"), F.lit(k + 1).cast("long").alias("n")) for k in range(4)))
    x = b.select("code", F.col("date").alias("sold"), "amount", ahead.alias("a")).filter("amount > 150000")
    return x.select("code", "sold", F.explode("a").alias("m")).filter("m.date is not null").select("code", "sold", "m.date", "m.close", "m.n")


@query("w40_regimes", "WITH i AS (SELECT date, avg(close) AS c FROM bars GROUP BY date), r AS (SELECT date, c / lag(c) OVER (ORDER BY date) - 1 AS r FROM i), x AS (SELECT date, sum(r) OVER (ORDER BY date ROWS 19 PRECEDING) AS trend, stddev_samp(r) OVER (ORDER BY date ROWS 19 PRECEDING) AS vol FROM r), y AS (SELECT *, CASE WHEN count(vol) OVER (ORDER BY date ROWS 251 PRECEDING) >= 63 THEN quantile_cont(vol, 0.5) OVER (ORDER BY date ROWS 251 PRECEDING) END AS mid FROM x) SELECT date, CASE WHEN mid IS NULL THEN 'unknown' WHEN vol > mid THEN 'stress' WHEN trend > 0 THEN 'up' ELSE 'down' END AS regime FROM y")
def regimes(t: Tables) -> DataFrame:
    i = t.bars.groupBy(F.lit("ALL").alias("code"), "date").agg(F.avg("close").alias("close"))
    r = i.select("code", "date", change("close", 1).alias("r"))
    x = r.select("code", "date", F.sum("r").over(wc().rowsBetween(-19, 0)).alias("trend"), F.stddev_samp("r").over(wc().rowsBetween(-19, 0)).alias("vol"))
    mid = F.when(F.count("vol").over(wc().rowsBetween(-251, 0)) >= 63, F.percentile("vol", 0.5).over(wc().rowsBetween(-251, 0)))
    y = x.withColumn("mid", mid)
    return y.select("date", F.when(F.col("mid").isNull(), "unknown").when(F.col("vol") > F.col("mid"), "stress").when(F.col("trend") > 0, "up").otherwise("down").alias("regime"))


@query("w41_dispersion", "WITH d AS (SELECT date, stddev_pop(ridge_pred) AS d FROM predictions GROUP BY date), x AS (SELECT date, d, CASE WHEN count(d) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 20 THEN quantile_cont(d, 0.5) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS mid FROM d) SELECT date, d / nullif(mid, 0) AS ratio FROM x")
def dispersion(t: Tables) -> DataFrame:
    w = Window.partitionBy("k").orderBy("date").rowsBetween(-60, -1)
    d = t.predictions.groupBy("date", F.lit(0).alias("k")).agg(F.stddev_pop("ridge_pred").alias("d"))
    return d.withColumn("mid", F.when(F.count("d").over(w) >= 20, F.percentile("d", 0.5).over(w))).select("date", F.try_divide("d", F.nullif("mid", F.lit(0.0))).alias("ratio"))


@query("w43_fundamental_change", "WITH r AS (SELECT code, ann_date, value, row_number() OVER (PARTITION BY code ORDER BY ann_date DESC) AS n FROM reports), p AS (SELECT code, max(value) FILTER (n = 1) AS now, max(value) FILTER (n = 2) AS was FROM r WHERE n <= 2 GROUP BY code) SELECT code, now / nullif(was, 0) - 1 AS change, CASE WHEN now / nullif(was, 0) - 1 > 0.2 THEN 2 WHEN now > was THEN 1 WHEN now / nullif(was, 0) - 1 < -0.2 THEN -2 WHEN now < was THEN -1 ELSE 0 END AS score FROM p")
def fundamental_change(t: Tables) -> DataFrame:
    w = Window.partitionBy("code").orderBy(F.desc("ann_date"))
    p = t.reports.withColumn("n", F.row_number().over(w)).filter("n <= 2").groupBy("code").agg(F.max(F.when(F.col("n") == 1, F.col("value"))).alias("now"), F.max(F.when(F.col("n") == 2, F.col("value"))).alias("was"))
    x = F.try_divide("now", F.nullif("was", F.lit(0.0))) - 1
    return p.select("code", x.alias("change"), F.when(x > 0.2, 2).when(F.col("now") > F.col("was"), 1).when(x < -0.2, -2).when(F.col("now") < F.col("was"), -1).otherwise(0).alias("score"))


@query("w45_latest_quote", "SELECT code, arg_max(close, date) AS close, arg_max(close / before - 1, date) AS change FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS before FROM bars) GROUP BY code")
def latest_quote(t: Tables) -> DataFrame:
    x = t.bars.select("code", "date", "close", change("close", 1).alias("change"))
    return x.groupBy("code").agg(F.max_by("close", "date").alias("close"), F.max_by("change", "date").alias("change"))
