"""Importance weights for trajectories generated under another prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.functions import scoring as sc


def weight_trajectories(
    rows: DataFrame, low: float = 0.2, high: float = 5.0, length_normalize: bool = False
) -> DataFrame:
    """Row-local: clipped weight for off-context rows, one for the others, applied to
    every valid token's advantage."""
    weight = F.when(
        F.coalesce("off_context", F.lit(False)),
        sc.importance_weight("target", "behavior", "response_mask", low, high, length_normalize),
    ).otherwise(F.lit(1.0))
    return rows.withColumn("weight", weight).withColumn(
        "weighted_advantages", sc.weighted_advantages("advantages", "response_mask", F.col("weight"))
    )


def weight_metrics(weighted: DataFrame) -> DataFrame:
    """Mean, bounds and count of the off-context weights."""
    active = F.when(F.coalesce("off_context", F.lit(False)), F.col("weight"))
    return weighted.agg(
        F.avg(active).alias("is_weight_mean"),
        F.min(active).alias("is_weight_min"),
        F.max(active).alias("is_weight_max"),
        F.count(active).alias("off_context_count"),
    )


def effective_sample_size(weighted: DataFrame, weight: str = "weight") -> DataFrame:
    """``(sum w)^2 / sum w^2``; zero without weights, an error for a negative one."""
    w = F.col(weight)
    bad = F.raise_error(F.lit("importance weights cannot be negative")).cast("double")
    size = F.pow(F.sum(w), F.lit(2)) / F.nullif(F.sum(w * w), F.lit(0.0))
    return weighted.agg(
        F.when(F.count_if(w < 0) > 0, bad).otherwise(F.coalesce(size, F.lit(0.0))).alias("effective_sample_size"),
        F.count(w).alias("weights"),
    )
