"""Technical indicators as columns: moving averages, KDJ, RSI, BIAS, MACD, CCI, Williams, ROC, ATR, OBV.

Window indicators are one select; those with exponential means share one grouped fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ewm import ewm_columns
from tessera.functions.rolling import gap, mean_absolute_deviation, position_in_range, roll, true_range, wc


def window_indicators(bars: DataFrame) -> DataFrame:
    """MA, BIAS, Williams %R, ROC, CCI, SMA-ATR and volume columns beside code and date."""
    c, h, low, v = F.col("close"), F.col("high"), F.col("low"), F.col("volume")
    base = bars.withColumns({"tp": (h + low + c) / 3, "tr": true_range(), "step": F.signum(c - F.lag("close").over(wc()))})
    return base.select(
        "code",
        "date",
        *(roll(F.avg, "close", n).alias(f"ma{n}") for n in (5, 10, 20, 60)),
        *((100 * gap("close", n)).alias(f"bias{n}") for n in (6, 12, 24)),
        (-100 * (1 - position_in_range("close", "high", "low", 14))).alias("williams"),
        (100 * (F.try_divide(c, F.lag("close", 12).over(wc())) - 1)).alias("roc12"),
        F.try_divide(F.col("tp") - roll(F.avg, "tp", 14), 0.015 * mean_absolute_deviation(F.col("tp"), 14)).alias("cci14"),
        roll(F.avg, "tr", 14).alias("atr14"),
        F.try_divide(v, roll(F.avg, "volume", 5)).alias("volume_ratio"),
        F.sum(F.coalesce(F.col("step"), F.lit(0.0)) * v).over(wc().rowsBetween(Window.unboundedPreceding, 0)).alias("obv"),
    )


def ewm_indicators(bars: DataFrame) -> DataFrame:
    """MACD (histogram twice the difference), RSI 6/12/24, KDJ and Wilder's ATR beside code and date."""
    diff = F.col("close") - F.lag("close").over(wc())
    rsv = 100 * F.try_divide(F.col("close") - F.min("low").over(wc().rowsBetween(-8, 0)), F.nullif(F.max("high").over(wc().rowsBetween(-8, 0)) - F.min("low").over(wc().rowsBetween(-8, 0)), F.lit(0.0)))
    x = bars.select("code", "date", "close", F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))).alias("up"), F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))).alias("down"), F.coalesce(rsv, F.lit(50.0)).alias("rsv"), F.coalesce(true_range(), F.col("high") - F.col("low")).alias("tr"))
    spec = {"fast": ("close", 2 / 13, 0), "slow": ("close", 2 / 27, 0), "k": ("rsv", 1 / 3, 0), "atr": ("tr", 1 / 14, 0)}
    for n in (6, 12, 24):
        spec |= {f"up{n}": ("up", 1 / n, 0), f"down{n}": ("down", 1 / n, 0)}
    x = ewm_columns(x, spec).withColumn("dif", F.col("fast") - F.col("slow"))
    x = ewm_columns(x, {"dea": ("dif", 0.2, 0), "d": ("k", 1 / 3, 0)})
    rsi = {f"rsi{n}": F.coalesce(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(f"up{n}", F.nullif(f"down{n}", F.lit(0.0)))), F.lit(100.0)) for n in (6, 12, 24)}
    return x.withColumns({"hist": 2 * (F.col("dif") - F.col("dea")), "j": 3 * F.col("k") - 2 * F.col("d"), **rsi}).select("code", "date", "dif", "dea", "hist", "k", "d", "j", *rsi, "atr")
