"""Calibration of scores, and the exact test of paired outcomes."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.rank import global_ranks
from tallywright.sources.files import forget, keep

#: Bounds of the slope and the intercept, and what a slope's square costs.
SLOPE, INTERCEPT, PENALTY = (0.0, 100.0), (-50.0, 50.0), 1e-6


def fit_platt(df: DataFrame, score: str, label: str, weight: str | None = None, rounds: int = 60) -> DataFrame:
    """One row (slope, intercept, weighted_prevalence, n_rows, weight_sum): the logistic curve of least weighted log-loss.

    Newton steps within the bounds, halved until the loss falls; each is one
    aggregation over the rows, which never leave the executors. Rows have to
    have finite scores, labels 0 or 1 of both kinds, and positive finite
    weights (1 where no column is named); else ValueError, null included.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"), w.alias("w"))
    # Every step reads them again: three numbers a row, made once.
    rows = keep(rows, "scores")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    good = finite(F.col("s")) & finite(F.col("w")) & F.coalesce((F.col("w") > 0) & F.col("y").isin(0.0, 1.0), F.lit(False))
    n, bad, total, positive = rows.agg(F.count("*"), F.count_if(~good), F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    if bad or not n or not 0 < positive < total:
        forget(rows)
        raise ValueError("scores and weights have to be finite, weights positive, and labels 0 and 1 both present")
    prevalence = positive / total

    def sums(a: float, b: float) -> list[float]:
        z = F.lit(a) * F.col("s") + F.lit(b)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        # ln(1 + e^z) - y z, without overflow.
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        r, h = p - F.col("y"), p * (F.lit(1.0) - p)
        parts = (loss, r * F.col("s"), r, h * F.col("s") * F.col("s"), h * F.col("s"), h)
        got = rows.agg(*[F.sum(F.col("w") * x) / total for x in parts]).first()
        return [got[0] + PENALTY * a * a, got[1] + 2 * PENALTY * a, got[2], got[3] + 2 * PENALTY, got[4], got[5]]

    clip = lambda x, low_high: min(max(x, low_high[0]), low_high[1])
    a, b = 1.0, clip(math.log(prevalence / (1 - prevalence)), INTERCEPT)
    loss, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(rounds):
        # At a bound that the loss pushes against, only the other number moves.
        hold = (a <= SLOPE[0] and ga > 0) or (a >= SLOPE[1] and ga < 0)
        det = haa * hbb - hab * hab
        if hold or det <= 1e-18:
            da, db = 0.0, -gb / max(hbb, 1e-12)
        else:
            da, db = (-ga * hbb + gb * hab) / det, (-gb * haa + ga * hab) / det
        step = 1.0
        while step > 1e-6:
            x, y = clip(a + step * da, SLOPE), clip(b + step * db, INTERCEPT)
            tried = sums(x, y)
            if tried[0] <= loss:
                break
            step /= 2
        else:
            break
        moved = max(abs(x - a), abs(y - b))
        (a, b), (loss, ga, gb, haa, hab, hbb) = (x, y), tried
        if moved < 1e-9:
            break
    forget(rows)
    return df.sparkSession.createDataFrame([(a, b, prevalence, n, total)], "slope double, intercept double, weighted_prevalence double, n_rows long, weight_sum double")


#: Up to so many of the rarer discordant pairs the exact test sums a term for each.
EXACT_TERMS = 5_000


def mcnemar_p(b: Column, c: Column) -> Column:
    """The exact two-sided p-value of b against c discordant pairs: twice the lower binomial tail, 1 at most.

    Terms are summed in logarithms, one for each pair of the rarer kind up to
    EXACT_TERMS of them. Beyond, the sum begins at the largest term, whose logarithm comes from Stirling's series,
    and ends six square roots of n below it, where terms are under 1e-31 of it.
    """
    n, low = (b + c).cast("long"), F.least(b, c).cast("long")

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.when(k == 0, 0.0).otherwise(F.ln(F.greatest(n - k + 1, F.lit(1))) - F.ln(F.greatest(k, F.lit(1))))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    def down(acc: Column, i: Column) -> Column:
        k = low - i
        term = acc["term"] + F.ln(F.greatest(k + 1, F.lit(1))) - F.ln(n - k)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    def log_factorial(x: Column) -> Column:
        y = (x + 1).cast("double")
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)

    begin = F.struct((-n * math.log(2)).cast("double").alias("term"), F.lit(0.0).alias("sum"))
    exact = F.aggregate(F.sequence(F.lit(0).cast("long"), low), begin, step, lambda acc: acc["sum"])
    largest = log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * math.log(2)
    terms = F.least(low, F.ceil(6 * F.sqrt(n)).cast("long") + 50)
    first = F.struct(largest.alias("term"), F.exp(largest).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1))), first, down, lambda acc: acc["sum"])
    return F.least(F.lit(1.0), 2 * F.when(low <= EXACT_TERMS, exact).otherwise(tail))


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, w_plus, w_minus, statistic, z, p_value, reliable): the signed-rank test of a against b.

    Pairs without a difference are dropped, equal differences share their mean
    rank, and z has a continuity correction of a half over the deviation of these ranks; p_value is two-sided and,
    like statistic, null without pairs. From 20 pairs on the normal curve is
    reliable. A difference that is null or not finite is an error. Ranks come
    from global_ranks(), so no task sorts the pairs.
    """
    d = pairs.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    bad = F.isnull("d") | F.isnan("d") | (F.abs("d") == float("inf"))
    d = d.where(F.when(bad, F.raise_error("paired differences have to be finite").cast("boolean")).otherwise(F.col("d") != 0))
    r = global_ranks(d.withColumn("size", F.abs("d")), "size", False)
    total = lambda mask: F.coalesce(F.sum(F.when(mask, F.col("rank_avg"))), F.lit(0.0))
    sums = r.agg(F.count("*").alias("n"), total(F.col("d") > 0).alias("w_plus"), total(F.col("d") < 0).alias("w_minus"), F.coalesce(F.sum(F.col("rank_avg") * F.col("rank_avg")), F.lit(0.0)).alias("squares"))
    n, least = F.col("n"), F.least("w_plus", "w_minus")
    z = F.greatest(F.lit(0.0), F.abs(least - n * (n + 1) / 4.0) - 0.5) / F.sqrt(F.col("squares") / 4)
    some = sums.select("n", "w_plus", "w_minus", F.when(n > 0, least).alias("statistic"), F.when(n > 0, z).alias("z"))

    @F.arrow_udf("double")
    def two_sided(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else min(1.0, math.erfc(abs(v) / math.sqrt(2))) for v in x.to_pylist()], pa.float64())

    return some.select("*", two_sided("z").alias("p_value"), (n >= 20).alias("reliable"))


def strict_improvement(gains: DataFrame, higher: list[str], lower: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(score, improved, failures) of rows with columns base_<metric> and new_<metric>: every metric has to gain more than the tolerance.

    Metrics in `higher` gain by rising, those in `lower` by falling; score is the sum of all gains, failures the metrics
    that gain too little, in order. A null metric gains nothing that can be told, and fails.
    """
    gain = {m: F.col(f"new_{m}") - F.col(f"base_{m}") for m in higher} | {m: F.col(f"base_{m}") - F.col(f"new_{m}") for m in lower}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(g > tolerance, F.lit(False)), m) for m, g in gain.items()]))
    score = reduce(Column.__add__, gain.values())
    return gains.select(score.alias("score"), (F.size(failed) == 0).alias("improved"), failed.alias("failures"))
