"""Measurement records as edges, splits and features, over a caller's own columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_table(rows: DataFrame, keys: list[str], value: str, document: str, line: str, positive: float, negative: float) -> DataFrame:
    """One row for each `keys`: n, n_pos (value from `positive` on), n_neg (up to `negative`), n_gray, max_p, median_p, n_pubs and n_lines.

    Documents and values are counted first, each dealt by its own key with
    map-side sums, so nothing is sent once for each distinct count and a hot
    edge's rows lie in many tasks. Rows with a null key form an edge of their
    own; null values count in n alone. line numbers are whole, 0 to 62.
    """
    v = F.col(value)
    by_document = rows.groupBy(*keys, document).agg(
        F.count("*").alias("n"), F.count_if(v >= positive).alias("n_pos"), F.count_if(v <= negative).alias("n_neg"), F.count(v).alias("known"), F.max(v).alias("max_p"),
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{line}` as int))")).alias("lines"),
    )
    sums = by_document.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_pos", "n_neg", "known")], F.max("max_p").alias("max_p"), F.count(document).alias("n_pubs"), F.bit_count(F.bit_or("lines")).cast("long").alias("n_lines")
    )
    middle = rows.groupBy(*keys, value).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.percentile(value, 0.5, F.col("c")).alias("median_p"))
    middle = middle.select(*[F.col(k).alias(f"__{k}") for k in keys], "median_p")
    joined = sums.join(middle, reduce(Column.__and__, [sums[k].eqNullSafe(middle[f"__{k}"]) for k in keys]))
    return joined.select(*keys, "n", "n_pos", "n_neg", (F.col("known") - F.col("n_pos") - F.col("n_neg")).alias("n_gray"), "max_p", "median_p", "n_pubs", "n_lines")


def with_earliest(rows: DataFrame, order: str, wanted: Column | None = None, **keys: list[str]) -> DataFrame:
    """rows, or those `wanted` of them, with a column for each name: the smallest `order` of any row with the same key; null keys are keys like others.

    Each is a sum by key with map-side combining, joined back; adaptive
    execution splits the side of the rows where a key is hot.
    """
    every, rows = rows, rows if wanted is None else rows.where(wanted)
    for name, by in keys.items():
        first = every.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(F.min(order).alias(name))
        rows = rows.join(first, reduce(Column.__and__, [rows[k].eqNullSafe(first[f"__{k}"]) for k in by])).drop(*[f"__{k}" for k in by])
    return rows


def policy_rows(rows: DataFrame, predicates: dict[str, Column], policies: dict[str, tuple[str, ...]], out: str = "policy") -> DataFrame:
    """A row for each policy whose predicates all hold; a predicate that is null doesn't."""
    holds = lambda names: reduce(Column.__and__, [F.coalesce(predicates[n], F.lit(False)) for n in names], F.lit(True))
    passed = [F.when(holds(names), F.lit(policy)) for policy, names in policies.items()]
    return rows.withColumn(out, F.explode(F.array_compact(F.array(*passed))))


def reject_counts(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """n_rows, and n_not_<name>, the rows for which each predicate is false or null."""
    return rows.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(p, F.lit(False))).alias(f"n_not_{n}") for n, p in predicates.items()])


#: Retrieval recipes, weights of features; contrast is taken off.
RECIPES = {
    "union_p5_max": {"max5": 1.0},
    "union_p6_max": {"max6": 1.0},
    "union_p6_quality": {"max6": 0.72, "quality": 0.23, "support": 0.05},
    "union_p6_consensus": {"max6": 0.68, "quality": 0.17, "consensus": 0.10, "support": 0.05},
    "union_p6_contrast": {"max6": 0.68, "quality": 0.17, "consensus": 0.08, "support": 0.07, "contrast": 0.08},
    "union_any_max": {"max_any": 1.0},
    "union_any_p6": {"max_any": 0.5, "max6": 0.5},
    "union_any_consensus": {"max_any": 0.45, "max6": 0.30, "quality": 0.15, "consensus": 0.10},
    "union_nonneg_max": {"max_nonneg": 1.0},
    "union_nonneg_consensus": {"max_nonneg": 0.45, "max6": 0.30, "quality": 0.15, "consensus": 0.10},
    "union_nonneg_contrast": {"max_nonneg": 0.45, "max6": 0.30, "quality": 0.15, "contrast": 0.10},
    "union_discount_light": {"max_any": 0.30, "max_nonneg": 0.15, "max6": 0.30, "quality": 0.15, "consensus": 0.10},
    "union_discount_even": {"max_any": 0.225, "max_nonneg": 0.225, "max6": 0.30, "quality": 0.15, "consensus": 0.10},
    "union_discount_heavy": {"max_any": 0.15, "max_nonneg": 0.30, "max6": 0.30, "quality": 0.15, "consensus": 0.10},
}
BASELINE_RECIPE = "chembl_p5_max"
FEATURES = ("baseline", "max_any", "max_nonneg", "max5", "max6", "quality", "consensus", "support", "contrast")


def retrieval_features(edges: DataFrame, target: str, similarity: str, sources: tuple[str, str, str]) -> DataFrame:
    """FEATURES of each target over its edges, which have max_p, n_pos, n_neg, and a column with the maximum of each source, the baseline's first.

    All are maxima of the similarity over a mask of edges, 0 where none is left,
    but for support, a bounded sum; consensus is the second largest of the
    sources' own. One aggregation with map-side combining; targets without
    edges aren't there.
    """
    s, p, n = F.col(similarity), F.col("max_p"), F.col("n_pos")
    most = lambda mask, x=s: F.coalesce(F.max(F.when(mask, x)), F.lit(0.0))
    some, against = n > 0, (n == 0) & (F.col("n_neg") > 0)
    clipped = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    quality = 0.78 + 0.17 * clipped((p - 6) / 3) + 0.05 * clipped(F.log1p(n) / F.ln(F.lit(5.0)))
    support = F.coalesce(F.sum(F.when(some & (s >= 0.30), F.pow(s, F.lit(4.0)) * F.log1p(n))), F.lit(0.0))
    by_source = F.array(*[most(F.col(c) >= 6) for c in sources])
    return edges.groupBy(target).agg(
        most(F.col(sources[0]) >= 5).alias("baseline"), most(F.lit(True)).alias("max_any"), most(~against).alias("max_nonneg"), most(p >= 5).alias("max5"), most(some).alias("max6"),
        most(some, s * quality).alias("quality"), F.get(F.sort_array(by_source), F.lit(1)).alias("consensus"), F.tanh(support / 4).alias("support"),
        F.greatest(most(against) - most(some), F.lit(0.0)).alias("contrast"),
    )


def recipe_score(weights: dict[str, float]) -> Column:
    """A recipe's weighted sum of features, contrast taken off, 0 at least."""
    return F.greatest(sum((F.col(f) * (-w if f == "contrast" else w) for f, w in weights.items()), F.lit(0.0)), F.lit(0.0))
