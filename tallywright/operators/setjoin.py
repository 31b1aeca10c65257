"""Pairs of sets that are similar enough, found through their rarest elements."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.files import keep, small_side

#: Elements that more sets of a table than this have among their first ones are counted, not joined.
FEW = 32
#: Of t n elements, one in so many is held against others beyond what it takes to share one.
MORE = 8


def shingle_arrays(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """(key, tokens): the different runs of `words` lower-case words of each text, as 64-bit hashes; shorter and null texts have none and are left out."""
    each = F.filter(F.split(F.lower(F.col(text)), r"[ \t\n\r]+"), lambda w: w != "")
    hashed = df.select(key, F.transform(each, lambda w: F.xxhash64(w)).alias("__w")).where(F.size("__w") >= words)
    starts = F.sequence(F.lit(1), F.size("__w") - words + 1)
    return hashed.select(key, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("__w", i, words)))).alias("tokens"))


def _least(share: Fraction, size: Column) -> Column:
    """The smallest whole number that is at least share * size."""
    return F.ceil(size * F.lit(share.numerator) / F.lit(share.denominator)).cast("int")


def rarest(sets: DataFrame, frequency: DataFrame, key: str, share: Fraction) -> DataFrame:
    """(key, size, place, token): of each set those elements by which it can meet one of at least `share` similarity, from the rarest on.

    frequency (token, n) has the elements that sets have in common; all others come
    first, bring nobody together and are left out. The order is by n, then token, one for all sets.
    """
    each = sets.select(key, F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(frequency, "token")
    shared = each.groupBy(key, "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    # Elements of one set alone stand before the shared ones.
    alone, first = F.col("size") - F.size("shared"), F.col("size") - _least(share, F.col("size")) + 1
    kept = shared.where(first > alone).select(key, "size", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), first - alone)).alias("at", "e"))
    return kept.select(key, "size", (F.col("alone") + F.col("at") + 1).alias("place"), F.col("e.token").alias("token"))


def _met_by_frequency(left: DataFrame, other: DataFrame | None, share: Fraction, a: str, b: str) -> DataFrame:
    """(a, b), each pair perhaps several times: sets that meet in the first of their elements, ordered from the rarest on."""
    one = left.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("x"))
    if other is None:
        frequency = one.where("x > 1").select("token", F.col("x").alias("n"))
    else:
        # What left doesn't have is dropped before it is counted; where left is small its elements go to every task, and no others are shuffled.
        one = keep(one, "elements")
        two = other.select(F.explode("tokens").alias("token")).join(one.select("token"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("y"))
        frequency = one.join(two, "token").select("token", (F.col("x") + F.col("y")).alias("n"))
    frequency = keep(frequency, "frequency")
    p = rarest(left, frequency, a, share).select(a, F.col("size").alias("sa"), F.col("place").alias("pa"), "token")
    q = p.select(F.col(a).alias(b), F.col("sa").alias("sb"), F.col("pa").alias("pb"), "token") if other is None else rarest(other, frequency, b, share).select(b, F.col("size").alias("sb"), F.col("place").alias("pb"), "token")
    met = p.join(q, "token")
    if other is None:
        met = met.where(F.col(a) < F.col(b))
    small, large = F.least("sa", "sb"), F.greatest("sa", "sb")
    needed = _least(share / (1 + share), F.col("sa") + F.col("sb"))
    met = met.where((small >= _least(share, large)) & (1 + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= needed))
    return met.select(a, b)


def _more(share: Fraction, size: Column) -> Column:
    """So many elements more than it takes to share one are held against each other."""
    return F.floor(size * F.lit(share.numerator) / F.lit(MORE * share.denominator)).cast("int")


def _met_within(left: DataFrame, share: Fraction, a: str, b: str) -> DataFrame:
    """(a, b), a < b, each pair perhaps twice: left's sets that can be similar.

    Only the first elements of each set by value are moved: n - ceil(t n) + 1 of n and
    _more(). Of two sets let x be that whose first elements end earlier. What both have up
    to there is among the first elements of both, and beyond it x has
    ceil(t n) - 1 - _more(n) elements left; so similar sets share
    _more(n) first elements at least, n the larger size, and one in any case (roundings
    cost one at most). Those that over FEW sets have there aren't joined but counted
    as shared, and sets that have so many of them that they alone could make a
    pair meet by frequency too.
    """
    size = F.size("tokens")
    first = F.slice(F.sort_array("tokens"), F.lit(1), size - _least(share, size) + 1 + _more(share, size))
    rows = left.select(F.explode(first).alias("token"), a, size.alias("size"))
    shared = keep(rows.withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1"), "shared")
    p = shared.where(F.col("n") <= FEW).select(a, F.col("size").alias("sa"), "token")
    q = p.select(F.col(a).alias(b), F.col("sa").alias("sb"), "token")
    met = p.join(q, "token").where((F.col(a) < F.col(b)) & (F.least("sa", "sb") >= _least(share, F.greatest("sa", "sb"))))
    met = keep(met.groupBy(a, b, "sa", "sb").agg(F.count("*").alias("c")), "met")
    frequent = keep(shared.where(F.col("n") > FEW).groupBy(a, "size").agg(F.count("*").alias("h")), "frequent")
    had = lambda key, out: small_side(frequent).select(F.col(a).alias(key), F.col("h").alias(out))
    left_over = lambda s: _least(share, F.col(s)) - 1 - _more(share, F.col(s))
    most = F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) + F.greatest(left_over("sa"), left_over("sb"))
    met = met.join(had(a, "ha"), a, "left").join(had(b, "hb"), b, "left").where(most >= _least(share / (1 + share), F.col("sa") + F.col("sb"))).select(a, b)
    again = keep(frequent.where(F.col("h") >= F.greatest(F.lit(1), _more(share, F.col("size")))).select(a), "again")
    if again.isEmpty():
        return met
    return met.unionByName(_met_by_frequency(left.join(small_side(again), a, "left_semi"), None, share, a, b))


def similar_sets(left: DataFrame, right: DataFrame | None, threshold: float, a: str, b: str) -> DataFrame:
    """(a, b, jaccard, covered) of the pairs of sets whose similarity is at least the threshold; covered is the share of a's set in b's.

    left is (a, tokens) and right (b, tokens), arrays of different longs; keys are unique on
    each side. Without right, left's sets are held against each other, each pair
    once, named a and b with a < b. Sets meet only in the first n - ceil(t n) + 1 of their n
    elements, in an order that all sets have, of which similar ones share one; pairs whose sizes, or what
    is left behind the place where they meet, can't reach the threshold go no
    further. What is left is confirmed on whole sets. So an element that many sets have
    is joined only where a set has hardly any other, and the work follows the pairs that
    are nearly similar, not those that share something. Empty sets pair with nothing.
    """
    share = Fraction(str(threshold))
    if not 0 < share <= 1:
        raise ValueError("the threshold has to be over 0 and at most 1")
    left = left.where(F.size("tokens") > 0)
    other = left.select(F.col(a).alias(b), "tokens") if right is None else right.where(F.size("tokens") > 0)
    met = _met_within(left, share, a, b) if right is None else _met_by_frequency(left, other, share, a, b)
    pairs = keep(met.distinct(), "candidates")
    if right is None:
        # Whole sets are moved only of those that met.
        ids = keep(pairs.select(F.explode(F.array(a, b)).alias(a)).distinct(), "met")
        left = left.join(small_side(ids), a, "left_semi")
        other = left.select(F.col(a).alias(b), "tokens")
    whole = pairs.join(left.withColumnRenamed("tokens", "ta"), a).join(other.withColumnRenamed("tokens", "tb"), b)
    both = F.size(F.array_intersect("ta", "tb"))
    sized = whole.select(a, b, both.alias("both"), F.size("ta").alias("sa"), F.size("tb").alias("sb"))
    union = F.col("sa") + F.col("sb") - F.col("both")
    return sized.where(F.col("both") * share.denominator >= union * share.numerator).select(a, b, (F.col("both") / union).alias("jaccard"), (F.col("both") / F.col("sa")).alias("covered"))
