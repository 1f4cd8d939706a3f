"""Factor statistics: rank IC per date, its summary, layers, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cross import avg_rank, correlation


def daily_ic(panel: DataFrame, factors: Sequence[str], label: str, least: int = 5, distinct: int = 3) -> DataFrame:
    """(date, factor, ic): Spearman correlation of each factor with the label per date, over rows that have both."""
    long = panel.select("date", "code", label, *factors).unpivot(["date", "code", label], list(factors), "factor", "value").dropna()
    by = ("date", "factor")
    ranked = long.select(*by, avg_rank("value", by).alias("a"), avg_rank(label, by).alias("b"), "value", label)
    g = ranked.groupBy(*by).agg(correlation("a", "b").alias("ic"), F.count("*").alias("n"), F.countDistinct("value").alias("u"), F.countDistinct(label).alias("v"))
    return g.filter((F.col("n") >= least) & (F.col("u") >= distinct) & (F.col("v") >= distinct)).select(*by, "ic")


def ic_summary(ic: DataFrame) -> DataFrame:
    std = F.stddev_samp("ic")
    return ic.groupBy("factor").agg(F.avg("ic").alias("mean"), std.alias("std"), F.count("ic").alias("n"), F.try_divide(F.avg("ic"), F.nullif(std, F.lit(0.0))).alias("icir"), F.avg((F.col("ic") > 1e-9).cast("double")).alias("win_rate"), F.avg(F.abs("ic")).alias("abs_mean"))


def layer_returns(panel: DataFrame, factor: str, label: str, q: int) -> DataFrame:
    """(date, layer, mean): label means by the value quantiles of a factor per date, right-closed; equal edges are merged."""
    by = Window.partitionBy("date")
    x = panel.select("date", F.col(factor).alias("x"), F.col(label).alias("y")).dropna()
    edges = F.array_distinct(F.percentile("x", [i / q for i in range(q + 1)]).over(by))
    x = x.withColumns({"e": edges, "n": F.count("x").over(by), "r": F.dense_rank().over(by.orderBy("x"))}).withColumn("u", F.max("r").over(by))
    x = x.filter((F.col("n") >= 3 * q) & (F.col("u") >= q))
    layer = F.greatest(F.size(F.filter("e", lambda v: v < F.col("x"))) - 1, F.lit(0))
    return x.groupBy("date", layer.alias("layer")).agg(F.avg("y").alias("mean"))


def layer_summary(layers: DataFrame) -> DataFrame:
    """Top, bottom and long-short mean over the dates."""
    ends = layers.groupBy("date").agg(F.max_by("mean", "layer").alias("top"), F.min_by("mean", "layer").alias("bottom"))
    return ends.agg(F.avg("top").alias("top"), F.avg("bottom").alias("bottom"), F.avg(F.col("top") - F.col("bottom")).alias("long_short"))


def auc(scored: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """ROC-AUC per group by the rank sum."""
    r = scored.select(by, label, avg_rank(score, (by,)).alias("r"))
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return r.groupBy(by).agg(F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("r"))) - pos * (pos + 1) / 2, pos * neg).alias("auc"))
