"""Executable returns: can a name be bought at the next open, and when can it be sold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rolling import roll, wc


def rolled_sell(close: str, sellable: str, available: str, horizon: int, cap: int) -> Column:
    """The close of the first sellable row from ``horizon`` on within ``cap`` rows; else that of the last available one;
    null where the window starts behind the series."""
    ahead = range(horizon, horizon + cap)
    first = [F.when(F.coalesce(F.lead(sellable, k).over(wc()), F.lit(False)), F.lead(close, k).over(wc())) for k in ahead]
    last = [F.when(F.coalesce(F.lead(available, k).over(wc()), F.lit(False)), F.lead(close, k).over(wc())) for k in reversed(ahead)]
    return F.when(F.lead(close, horizon).over(wc()).isNotNull() | F.lead(available, horizon).over(wc()).isNotNull(), F.coalesce(*first, *last))


def tradability(bars: DataFrame, status: DataFrame | None, horizons: tuple[int, ...] = (1, 3, 5), cap: int = 3, limit: float = 0.095, least_adv: float = 0.0) -> DataFrame:
    """adv20, buyable_close, buyable_next and tradable_ret_{h}d for each row. A row is available if it has volume and is not
    suspended; with a status table, a missing status is not available. A close at the high after a rise of ``limit`` seals
    the buyer out, one at the low after such a fall the seller."""
    b = bars
    if status is not None:
        b = b.join(status.select("code", "date", "is_suspended"), ["code", "date"], "left")
    else:
        b = b.withColumn("is_suspended", F.lit(False))
    b = b.withColumns({"ret": F.try_divide("close", F.lag("close").over(wc())) - 1, "adv20": F.when(F.count("amount").over(wc().rowsBetween(-20, -1)) == 20, F.avg("amount").over(wc().rowsBetween(-20, -1)))})
    ok = (F.coalesce(F.col("volume"), F.lit(0.0)) > 0) & F.coalesce(~F.col("is_suspended"), F.lit(False))
    up = F.coalesce((F.col("close") == F.col("high")) & (F.col("ret") >= limit), F.lit(False))
    down = F.coalesce((F.col("close") == F.col("low")) & (F.col("ret") <= -limit), F.lit(False))
    b = b.withColumns({"ok": ok, "sealed": up, "sellable": ok & ~down})
    liquid = F.coalesce(F.col("adv20"), F.lit(0.0)) >= least_adv
    nxt = F.coalesce(F.lead("ok").over(wc()) & ~(F.lead(F.col("sealed") & (F.col("low") == F.col("high"))).over(wc())), F.lit(False))
    out = {f"tradable_ret_{h}d": F.try_divide(rolled_sell("close", "sellable", "ok", h, cap), F.col("close")) - 1 for h in horizons}
    return b.select("code", "date", "adv20", (F.col("ok") & ~F.col("sealed") & liquid).alias("buyable_close"), nxt.alias("buyable_next"), *(x.alias(n) for n, x in out.items()))
