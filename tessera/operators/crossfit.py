"""Regressions of one date's rows on several columns and a category, without gathering a date anywhere.

A category's dummies and the constant drop out when everything is taken from its mean within (date, category). What is left
is one small matrix of products per date: covariances by (date, category), which Spark combines before the shuffle, summed
by date, solved for all dates of a batch at once, and joined back. The residuals are an expression over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cross import rank_pct
from tessera.functions.rolling import wd

#: Below this eigenvalue of the scaled matrix, columns count as dependent.
DEPENDENT = 1e-10


def solve_symmetric(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least-norm solutions of many small systems; Cholesky where the columns are independent."""
    scale = np.sqrt(np.einsum("nii->ni", gram))
    scale[~(scale > 0)] = 1.0
    g, r = gram / scale[:, :, None] / scale[:, None, :], right / scale
    values = np.linalg.eigvalsh(g)
    good = values[:, 0] > DEPENDENT
    out = np.zeros_like(r)
    if good.any():
        low = np.linalg.cholesky(g[good])
        half = np.linalg.solve(low, r[good][:, :, None])
        out[good] = np.linalg.solve(low.transpose(0, 2, 1), half)[:, :, 0]
    if not good.all():
        out[~good] = (np.linalg.pinv(g[~good], rcond=DEPENDENT, hermitian=True) @ r[~good][:, :, None])[:, :, 0]
    return out / scale


def _solve(gram: pd.Series, right: pd.Series) -> pd.Series:
    b = np.stack(right.to_numpy()).astype(float)
    k = b.shape[1]
    return pd.Series(list(solve_symmetric(np.stack(gram.to_numpy()).astype(float).reshape(-1, k, k), b)))


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def residuals(df: DataFrame, targets: Sequence[str], regressors: Sequence[str], category: str | None = None, by: str = "date", spare: int = 2) -> DataFrame:
    """Each target in place of it its residual on a constant, the regressors (without itself; null or infinite: 0) and the
    category's dummies (null is a category), fitted per ``by`` on the rows where the target is a number.

    A target stays as it is where a date has no more rows for it than columns (constant, regressors, categories and one for
    null) and ``spare``. A target that isn't a number becomes null."""
    keys = [by, category] if category else [by]
    out, kept, new = df, df.columns, {}
    for nth, y in enumerate(targets):
        xs = [x for x in regressors if x != y]
        if not xs and not category:
            continue
        own = df.select(*keys, _finite(F.col(y)).alias("__y"), *(F.coalesce(_finite(F.col(x)), F.lit(0.0)).alias(f"__x{i}") for i, x in enumerate(xs)))
        ok = F.col("__y").isNotNull()
        cols = [F.when(ok, F.col(f"__x{i}")) for i in range(len(xs))]
        n = F.count("__y")
        product = lambda a, b: F.coalesce(F.covar_pop(a, b), F.lit(0.0)) * F.count("__y")
        k = len(xs)
        gram = F.array(*(product(cols[min(i, j)], cols[max(i, j)]) for i in range(k) for j in range(k)))
        right = F.array(*(product(c, F.col("__y")) for c in cols))
        part = own.groupBy(*keys).agg(n.alias("__n"), F.avg("__y").alias("__my"), F.array(*map(F.avg, cols)).alias("__mx"), gram.alias("__g"), right.alias("__r"))
        total = lambda c, size: F.array(*(F.sum(F.col(c)[i]) for i in range(size)))
        groups = F.count(category) + 1 if category else F.lit(0)
        day = part.groupBy(by).agg(F.sum("__n").alias("__all"), groups.alias("__groups"), total("__g", k * k).alias("__g"), total("__r", k).alias("__r"))
        enough = F.col("__all") > 1 + k + F.col("__groups") + spare
        beta = F.pandas_udf(_solve, "array<double>")("__g", "__r") if k else F.array().cast("array<double>")
        fit = day.select(F.col(by).alias("__by"), enough.alias("__fits"), beta.alias("__b"))
        means = part.select(F.col(by).alias("__by"), *([F.col(category).alias("__cat")] if category else []), "__my", "__mx").join(fit, "__by")
        same = F.col(by).eqNullSafe(F.col("__by"))
        out = out.join(means, same & F.col(category).eqNullSafe(F.col("__cat")) if category else same, "left")
        value = _finite(F.col(y))
        moved = [F.col("__b")[i] * (F.coalesce(_finite(F.col(x)), F.lit(0.0)) - F.col("__mx")[i]) for i, x in enumerate(xs)]
        resid = value - F.col("__my") - sum(moved, F.lit(0.0))
        new[y] = f"__resid{nth}"
        before = [F.col(c) for c in (*kept, *list(new.values())[:-1])]
        out = out.select(*before, F.when(F.col("__fits"), resid).otherwise(value).alias(new[y]))
    return out.select(*(F.col(new[c]).alias(c) if c in new else F.col(c) for c in kept)) if new else df


def orthogonal_increment(df: DataFrame, candidate: str, controls: Sequence[str], name: str, least: int = 30) -> DataFrame:
    """Adds ``name``: per date the average-rank share of a candidate, less what the controls' rank shares explain, in units of
    its population deviation (0 where that is 0). Only rows with all of them count; dates with fewer than ``least`` such rows
    (or than the controls and three) give null."""
    ranked = df.withColumns({"__y": rank_pct(candidate), **{f"__c{i}": rank_pct(c) for i, c in enumerate(controls)}})
    valid = F.col("__y").isNotNull()
    for i in range(len(controls)):
        valid = valid & F.col(f"__c{i}").isNotNull()
    ranked = ranked.withColumn("__v", F.when(valid, F.col("__y"))).withColumn("__n", F.count("__v").over(wd()))
    resid = residuals(ranked, ["__v"], [f"__c{i}" for i in range(len(controls))], spare=-(10**9))
    spread = F.stddev_pop("__v").over(wd())
    # what is left of an exact fit is rounding
    value = F.when(spread > 1e-12, F.col("__v") / spread).otherwise(0.0)
    enough = F.col("__n") >= max(least, len(controls) + 3)
    return resid.select(*df.columns, F.when(enough & F.col("__v").isNotNull(), value).alias(name))
