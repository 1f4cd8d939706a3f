"""Cross-sectional expressions over the rows of one date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.functions.rolling import wd


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def winsor(x: Column | str, low: float = 0.01, high: float = 0.99) -> Column:
    x = _col(x)
    a, b = F.percentile(x, low).over(wd()), F.percentile(x, high).over(wd())
    return F.when(x.isNull(), None).otherwise(F.greatest(F.least(x, b), a))


def zscore(x: Column | str, population: bool = False, zero: bool = False) -> Column:
    """(x - mean) / std of the date; a std of zero gives null, or 0 if ``zero``."""
    x = _col(x)
    s = (F.stddev_pop if population else F.stddev_samp)(x).over(wd())
    z = F.try_divide(x - F.avg(x).over(wd()), F.nullif(s, F.lit(0.0)))
    return F.coalesce(z, F.lit(0.0)) if zero else z


def avg_rank(x: str, by: tuple[str, ...] = ("date",)) -> Column:
    """Average rank (ties share) from 1 over the rows with a value."""
    same = Window.partitionBy(*by, x)
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last()))
    return F.when(F.col(x).isNotNull(), rank + (F.count(x).over(same) - 1) / 2)


def rank_pct(x: str, by: tuple[str, ...] = ("date",)) -> Column:
    return avg_rank(x, by) / F.count(x).over(Window.partitionBy(*by))


def first_rank(x: str, tie: str = "code") -> Column:
    return F.row_number().over(wd().orderBy(F.col(x).asc_nulls_last(), tie))


def quantile_bucket(x: str, q: int, tie: str = "code") -> Column:
    """Bucket 0..q-1 by quantiles of the first-come ranks: ceil((rank - 1) * q / (n - 1)) - 1, at least 0."""
    n = F.count(x).over(wd())
    b = F.ceil((first_rank(x, tie) - 1) * q / (n - 1)) - 1
    return F.when(F.col(x).isNotNull() & (n > 1), F.greatest(b, F.lit(0)).cast("int"))


def relevance(x: str, bins: int, tie: str = "code") -> Column:
    """Rank-relevance label: floor of the first-come rank share times bins, at most bins - 1; null in groups under two."""
    n = F.count(x).over(wd())
    return F.when((n >= 2) & F.col(x).isNotNull(), F.least(F.floor(first_rank(x, tie) / n * bins), F.lit(bins - 1)).cast("int"))


def size_neutral(x: str, size: str) -> Column:
    """Residual of the regression on one column, with a constant, per date."""
    return F.col(x) - F.regr_slope(F.col(x), F.col(size)).over(wd()) * F.col(size) - F.regr_intercept(F.col(x), F.col(size)).over(wd())


def blend(parts: dict[str, float]) -> Column:
    """Weighted mean over the parts that have a value."""
    up = sum((F.when(F.col(c).isNotNull(), w * F.col(c)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    down = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return F.try_divide(up, F.nullif(down, F.lit(0.0)))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
