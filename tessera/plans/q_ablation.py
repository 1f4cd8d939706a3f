"""Group-wise ablation (B32); its sub-solves have no SQL, the test refits every subset from scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ablation as ab
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

GROUPS = {"rule": ["rule_score"], "risk": ["vol", "quiet"], "mixed": ["calm_momentum", "reversal"]}
SELECTION = ab.Period("1995-07-01", "1995-07-01", "1996-06-01")
CONFIRMATION = ab.Period("1996-06-01", "1996-06-01", "1999-01-01")


@query("b32_group_ablation")
def group_ablation(t: Tables) -> DataFrame:
    """Which of three groups of features the ridge of two legs gains from, step by step, and whether that holds later."""
    more = {"quiet": 1 / (1 + F.col("vol")), "calm_momentum": F.col("ridge_pred") / (1 + F.col("vol")), "reversal": F.col("lgbm_pred") * F.col("rule_score")}
    return ab.forward_groups(t.predictions.withColumns(more), ["ridge_pred", "lgbm_pred"], GROUPS, "ret", 3, SELECTION, CONFIRMATION)
