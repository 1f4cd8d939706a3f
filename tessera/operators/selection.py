"""Selection under dependence: greedy decorrelation of factors, block bootstrap, ridge-shrunk neutral labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cross import correlation


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by its meaning; more than ``most`` are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def decorrelated(ic: DataFrame, top: int, most: float = 0.85, least: int = 20) -> list[str]:
    """Factors by |ICIR|, dropping those whose IC series correlates with one kept before. The IC table has a row per date and
    factor; the names and the pairs that correlate come to the driver, 10,000 and a million at most, else it fails."""
    scores = ic.groupBy("factor").agg(F.abs(F.try_divide(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0)))).alias("s")).dropna().orderBy(F.desc("s"), "factor")
    rank = bounded(scores, 10_000, "factors")
    other = ic.select("date", F.col("factor").alias("g"), F.col("ic").alias("h"))
    alike = ic.join(other, "date").filter("factor < g").groupBy("factor", "g").agg(correlation("ic", "h").alias("r"), F.count("*").alias("n")).filter((F.col("n") >= least) & (F.abs("r") >= most))
    close = {frozenset((p["factor"], p["g"])) for p in bounded(alike, 1_000_000, "correlated pairs")}
    kept: list[str] = []
    for r in rank:
        if len(kept) < top and not any(frozenset((r["factor"], k)) in close for k in kept):
            kept.append(r["factor"])
    return kept


def block_bootstrap(diff: DataFrame, value: str, draws: int, block: int, seed: int) -> DataFrame:
    """(draw, mean): circular block bootstrap of a daily series. Starts are hashed, rows are met by a join on the day's
    place, so draws spread over the cluster."""
    n = Window.orderBy("date")
    placed = diff.withColumn("k", F.row_number().over(n) - 1)
    size = placed.agg(F.count("*").alias("size"))
    blocks = diff.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))
    blocks = blocks.select("draw", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block).cast("int") - 1)).alias("b"))
    start = F.pmod(F.xxhash64(F.lit(seed), "draw", "b"), F.col("size"))
    days = blocks.select("draw", "size", start.alias("s"), "b", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("i")).filter(F.col("b") * block + F.col("i") < F.col("size"))
    return days.withColumn("k", ((F.col("s") + F.col("i")) % F.col("size")).cast("int")).join(placed.select("k", value), "k").groupBy("draw").agg(F.avg(value).alias("mean"))


def ridge_neutral(df: DataFrame, label: str, size: str, group: str, alpha: float = 5.0, least: int = 20) -> DataFrame:
    """Label residuals per date after size and ridge-shrunk group effects; dates with few rows are demeaned. One date's rows
    are the unit of work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[label].to_numpy(float)
        if len(pdf) < least:
            return pdf.assign(residual=y - y.mean())
        dummies = pd.get_dummies(pdf[group].fillna("UNK")).sort_index(axis=1).to_numpy(float)
        x = np.column_stack([np.ones(len(y)), pdf[size].to_numpy(float), dummies])
        penalty = np.diag([0.0, 0.0, *[alpha] * dummies.shape[1]])
        beta = np.linalg.lstsq(x.T @ x + penalty, x.T @ y, rcond=None)[0]
        return pdf.assign(residual=y - x @ beta)

    schema = df.select("code", "date", label, size, group).schema.add("residual", "double")
    return df.select("code", "date", label, size, group).groupBy("date").applyInPandas(run, schema).select("code", "date", "residual")


def sign_score(*parts: tuple[Column, float, float]) -> Column:
    """Sum of +1 above the upper and -1 below the lower bound of each part; null counts 0."""
    return sum((F.when(x > up, 1).when(x < down, -1).otherwise(0) for x, up, down in parts), F.lit(0))
