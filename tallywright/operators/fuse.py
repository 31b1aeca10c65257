"""Score fusion and composite scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reciprocal_rank_fusion(ranked: DataFrame, key: str, source: str, rank: str, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, rrf, n_sources, ranks) of long rows: the sum of weight / (k + rank); an id that a list repeats counts at its best rank.

    Weights, if given, must be finite and positive, one for each source that occurs.
    """
    weight: Column = F.lit(1.0)
    if weights is not None:
        if any(not 0 < w < float("inf") for w in weights.values()):
            raise ValueError("weights must be positive and finite")
        cases = reduce(lambda c, kv: c.when(F.col(source) == kv[0], F.lit(float(kv[1]))), weights.items(), F.when(F.lit(False), F.lit(0.0)))
        weight = F.coalesce(cases, F.raise_error("a source has no weight").cast("double"))
    best = ranked.groupBy(key, source).agg(F.min(rank).alias("__rank")).withColumn("__part", weight / (k + F.col("__rank")))
    return best.groupBy(key).agg(
        F.round(F.sum("__part"), 9).alias("rrf"),
        F.count("*").alias("n_sources"),
        F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), F.col("__rank").cast("long").alias("rank")))).alias("ranks"),
    )


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def minmax(x: Column, low: Column, high: Column, constant: float = 0.0) -> Column:
    """(x - low) / (high - low); `constant` where all values agree."""
    return F.when(high - low < 1e-12, F.lit(constant)).otherwise((x - low) / (high - low))


def potency_weight(p: Column) -> Column:
    return F.coalesce(0.5 + 0.5 * clip((p - 5) / 3, 0, 1), F.lit(0.5))


def scale_similarity(s: Column, threshold: float) -> Column:
    return clip((s - threshold) / (1 - threshold), 0, 1)


def bayesian_or(p: Column) -> Column:
    """1 less the product of 1 - p over a group; exactly 1 if one is certain."""
    return F.when(F.max(p) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.when(p < 1, F.ln(1 - p)))))
