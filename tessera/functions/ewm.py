"""Exponentially weighted means with pandas' meaning (adjust=False, weights decay across nulls).

``ewm_columns`` runs a fold per entity inside ``applyInPandas``: an entity's own series is the unit of work, which grows
with time and not with the number of entities. All columns of one call share one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ewm_columns(df: DataFrame, specs: Mapping[str, tuple[str, float, int]], key: str = "code", order: str = "date") -> DataFrame:
    """Adds, for each name in specs, the EWM of (column, alpha, min_periods)."""
    schema = T.StructType([*df.schema, *(T.StructField(n, T.DoubleType()) for n in specs)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(**{n: pdf[c].astype(float).ewm(alpha=a, adjust=False, min_periods=m).mean() for n, (c, a, m) in specs.items()})

    return df.groupBy(key).applyInPandas(run, schema)
