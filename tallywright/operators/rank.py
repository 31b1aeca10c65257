"""Ranks, and selections by rank. Ties differ by rank family; every order ends in a key that the caller gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.files import keep

#: Groups of up to so many rows are gathered by median_and_deviation(), each as one array.
GATHERED = 100_000
#: Ranges that the different values of a whole table are ranked in.
RANGES = 64


def global_ranks(df: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """df with rank_min, rank_avg, rank_dense (from 1) of value over the whole table, n_values and k_values.

    Nulls get null ranks and don't count. Rows are counted by value first; the
    values are ranked within ranges cut at approximate quantiles, whose totals
    (RANGES rows) give each range its offset, so no task sorts the table.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = n.agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"))
    n = n.join(F.broadcast(cuts)).withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    down = F.col("__v").desc() if descending else F.col("__v").asc()
    inside = Window.partitionBy("__r").orderBy(down)
    n = n.withColumns({"__sum": F.sum("__n").over(inside), "__k": F.row_number().over(inside)})
    ranges = n.groupBy("__r").agg(F.sum("__n").alias("__rn"), F.count("*").alias("__rk"))
    outside = Window.orderBy(F.col("__r").desc() if descending else F.col("__r").asc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = ranges.select(
        "__r",
        F.coalesce(F.sum("__rn").over(outside), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__rk").over(outside), F.lit(0)).alias("__k0"),
        F.sum("__rn").over(every).alias("n_values"),
        F.sum("__rk").over(every).alias("k_values"),
    )
    first = F.col("__n0") + F.col("__sum") - F.col("__n") + 1
    n = n.join(F.broadcast(ranges), "__r").select(
        "__v",
        first.cast("long").alias("rank_min"),
        (first + (F.col("__n") - 1) / 2.0).cast("double").alias("rank_avg"),
        (F.col("__k0") + F.col("__k")).cast("long").alias("rank_dense"),
        "n_values",
        "k_values",
    )
    return df.join(n, df[value].eqNullSafe(n["__v"]), "left").drop("__v")


def global_row_numbers(df: DataFrame, value: str, key: str, descending: bool = True, out: str = "rank") -> DataFrame:
    """df with its row numbers over the whole table by value, nulls last, then key.

    Rows before a value come from global_ranks(); rows of one value are dealt
    in ranges of the key and numbered there, so no task sorts the table, nor
    all rows of a frequent value.
    """
    totals = df.agg(F.count(value).alias("__known"), F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"))
    rows = global_ranks(df, value, descending).drop("rank_avg", "rank_dense", "n_values", "k_values").join(F.broadcast(totals))
    rows = rows.withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(key))), F.lit(-1))).drop("__cuts")
    before = Window.partitionBy(value).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(value, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    parts = parts.select(F.col(value).alias("__v"), F.col("__part").alias("__p"), "__before")
    rows = rows.join(parts, rows[value].eqNullSafe(parts["__v"]) & (rows["__part"] == parts["__p"]))
    inside = F.row_number().over(Window.partitionBy(value, "__part").orderBy(key))
    number = F.coalesce("rank_min", F.col("__known") + 1) - 1 + F.col("__before") + inside
    return rows.withColumn(out, number.cast("long")).drop("rank_min", "__known", "__part", "__v", "__p", "__before")


def same_key(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    """left's columns `by` equal right's, which have two underscores in front; null equals null."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"__{c}"]) for c in by])


def ranked_values(df: DataFrame, by: list[str], value: str, descending: bool = True) -> DataFrame:
    """(__by..., __v, __n, rank_min, rank_dense, n_values): each group's different values that aren't null, how many rows have each, and their ranks from 1.

    Rows are counted by value first. A group's values are ranked within ranges
    cut at its approximate quantiles, whose totals, RANGES rows a group, give each
    range its offset, so no task ranks a group, however many rows it has.
    """
    keys = [f"__{c}" for c in by]
    n = df.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = n.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"))
    n = n.join(cuts, same_key(n, cuts, keys)).select(*keys, "__v", "__n", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__r"))
    down = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "__r").orderBy(down("__v"))
    n = n.withColumns({"__sum": F.sum("__n").over(inside), "__k": F.row_number().over(inside)})
    ranges = n.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__r").alias("____r")).agg(F.sum("__n").alias("__rn"), F.count("*").alias("__rk"))
    group = [f"__{k}" for k in keys]
    outside = Window.partitionBy(*group).orderBy(down("____r")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(outside), F.lit(0))
    ranges = ranges.withColumns({"__n0": before("__rn"), "__k0": before("__rk"), "n_values": F.sum("__rn").over(Window.partitionBy(*group))})
    first = (F.col("__n0") + F.col("__sum") - F.col("__n") + 1).cast("long")
    return n.join(ranges, same_key(n, ranges, [*keys, "__r"])).select(*keys, "__v", "__n", first.alias("rank_min"), (F.col("__k0") + F.col("__k")).cast("long").alias("rank_dense"), "n_values")


def grouped_ranks(df: DataFrame, by: list[str], value: str, descending: bool = True) -> DataFrame:
    """df with rank_min, rank_avg, rank_dense (from 1) of value within its group, and n_values, its values that aren't null; null for null values, whose rows don't count.

    No task ranks a group (ranked_values); groups with a null key are groups like others.
    """
    n = ranked_values(df, by, value, descending)
    rows = df.join(n, same_key(df, n, by) & (df[value] == n["__v"]), "left")
    average = (F.col("rank_min") + (F.col("__n") - 1) / 2.0).cast("double")
    return rows.select(*[df[c] for c in df.columns], "rank_min", average.alias("rank_avg"), "rank_dense", "n_values")


def grouped_row_numbers(df: DataFrame, by: list[str], value: str, key: str, descending: bool = True, out: str = "rank") -> DataFrame:
    """df with its row numbers within groups by value, then key; rows of a null value are left out.

    What stands before a value comes from grouped_ranks(); rows of one value are numbered
    in ranges of the key, so neither a hot group nor a frequent value meets in one task.
    """
    cuts = df.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"))
    rows = grouped_ranks(df, by, value, descending).where("rank_min is not null").join(F.broadcast(cuts))
    rows = rows.withColumn("__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(key))), F.lit(-1)))
    parts = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in [*by, value, "__part"]]).agg(F.count("*").alias("__m"))
    before = Window.partitionBy(*[f"__{c}" for c in [*by, value]]).orderBy("____part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    joined = rows.join(parts, same_key(rows, parts, [*by, value, "__part"]))
    inside = F.row_number().over(Window.partitionBy(*by, value, "__part").orderBy(key))
    return joined.withColumn(out, (F.col("rank_min") - 1 + F.col("__before") + inside).cast("long")).select(*df.columns, out)


def hashed_row_numbers(df: DataFrame, by: list[str], digest: Column, key: str, out: str = "rank", n: str = "n") -> DataFrame:
    """df with its row numbers within groups in the order of a digest in hexadecimal digits, then key, and the groups' rows n.

    A digest's first two digits deal a group in 256 ranges of about one size,
    which are numbered apart and joined by their counts.
    """
    rows = df.withColumn("__digest", digest).withColumn("__b", F.substring("__digest", 1, 2))
    parts = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in [*by, "__b"]]).agg(F.count("*").alias("__m"))
    group = Window.partitionBy(*[f"__{c}" for c in by])
    before = group.orderBy("____b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__m").over(before), F.lit(0)), n: F.sum("__m").over(group)})
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__digest", key))
    rows = rows.join(parts, same_key(rows, parts, [*by, "__b"]))
    return rows.withColumn(out, (F.col("__before") + inside).cast("long")).select(*df.columns, out, n)


def exact_percentile(df: DataFrame, by: list[str], value: str, p: float = 0.5, out: str = "percentile") -> DataFrame:
    """(by..., out, n): the percentile of each group's values, between neighbours in proportion, and how many aren't null; groups without any are left out.

    The two values that it lies between are those whose ranks hold the place
    (ranked_values), so no task has all values of a group.
    """
    n = ranked_values(df, by, value, descending=False)
    place = (F.col("n_values") - 1) * F.lit(float(p))
    # From 0: the rows of a value have the places from rank_min - 1 on.
    holds = lambda k: (k >= F.col("rank_min") - 1) & (k < F.col("rank_min") - 1 + F.col("__n"))
    low, high = F.floor(place), F.ceil(place)
    near = n.where(holds(low) | holds(high)).groupBy(*[F.col(f"__{c}").alias(c) for c in by])
    near = near.agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.max(place - low).alias("__part"), F.max("n_values").alias("n"))
    return near.select(*by, (F.col("__low") + F.col("__part") * (F.col("__high") - F.col("__low"))).alias(out), "n")


def median_and_deviation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., m, mad, n): each group's median, the median absolute deviation from it, and its rows; groups without values are left out.

    Rows are counted first. Groups of up to GATHERED rows have their values in an
    array, moved once for both medians; larger ones are ranked in ranges (exact_percentile), so
    no task has more of a group than that.
    """
    counts = keep(df.groupBy(*by).agg(F.count("*").alias("n")), "counts")
    large = counts.where(F.col("n") > GATHERED).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("n").alias("__rows"))
    hot = not large.isEmpty()

    def middle(v: Column) -> Column:
        size = F.size(v)
        low, high = F.get(v, F.floor((size - 1) / 2).cast("int")), F.get(v, F.floor(size / 2).cast("int"))
        return low + F.when(size % 2 == 0, 0.5).otherwise(0.0) * (high - low)

    def once(x: Column, f) -> Column:
        """f(x), x found once: named in a lambda, it would be found again for every value."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    far = lambda v, m: F.sort_array(F.transform(v, lambda x: F.abs(x - m)))
    both = once(F.sort_array("v"), lambda v: once(middle(v), lambda m: F.struct(m.alias("m"), once(far(v, m), middle).alias("mad"))))
    # Large groups are fewer than one in GATHERED rows.
    few = df.join(F.broadcast(large), same_key(df, large, by), "left_anti") if hot else df
    few = few.groupBy(*by).agg(F.collect_list(value).alias("v"), F.count("*").alias("n")).where(F.size("v") > 0)
    few = few.select(*by, both.alias("both"), "n").select(*by, "both.m", "both.mad", "n")
    if not hot:
        return few
    many = df.join(F.broadcast(large), same_key(df, large, by)).select(*by, value, "__rows")
    m = exact_percentile(many, by, value, 0.5, "m").select(*[F.col(c).alias(f"__{c}") for c in by], "m")
    far = many.join(m, same_key(many, m, by)).select(*by, "m", "__rows", F.abs(F.col(value) - F.col("m")).alias("__far"))
    mad = exact_percentile(far, [*by, "m", "__rows"], "__far", 0.5, "mad").select(*by, "m", "mad", F.col("__rows").alias("n"))
    return few.unionByName(mad)


def average_rank(by: list[str], value: str, descending: bool = True) -> Column:
    """Average rank of value among the rows of equal `by`."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    peers = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (peers - 1) / 2.0


def top_per_group(df: DataFrame, by: list[str], order: list, n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark keeps only n a group on each side of the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked.where(F.col(out) <= n)


def first_per_group(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return top_per_group(df, by, order, 1, "__first").drop("__first")


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts with zero characters between them."""
    joined = [x for p in parts for x in (F.decode(F.unhex(F.lit("00")), "utf-8"), p.cast("string"))][1:]
    return F.sha2(F.concat(*joined), 256)


def band_rerank(df: DataFrame, rank: str, scores: list[tuple[str, bool]], keep: int, band: int, k: int = 60) -> DataFrame:
    """Ranks up to keep and beyond band stay; those between are ordered by the sum of 1 / (k + rank) over the scores.

    scores are (column, whether higher is better); a null score ranks one
    behind the band's size. The band is bounded by `band` rows.
    """
    inside = df.where(F.col(rank).between(keep + 1, band))
    size = inside.agg(F.count("*").alias("__size"))
    fused = F.lit(0.0)
    for c, up in scores:
        order = F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_last()
        place = F.when(F.col(c).isNotNull(), F.rank().over(Window.orderBy(order))).otherwise(F.col("__size") + 1)
        fused = fused + 1.0 / (k + place)
    inside = inside.join(F.broadcast(size)).withColumn("__fused", F.round(fused, 12))
    inside = inside.withColumn("new_rank", (keep + F.row_number().over(Window.orderBy(F.desc("__fused"), rank))).cast("long"))
    rest = df.where(~F.col(rank).between(keep + 1, band)).withColumn("new_rank", F.col(rank).cast("long"))
    return rest.unionByName(inside.drop("__size", "__fused"))


def largest_remainder(strata: DataFrame, label: str, size: str, cap: int) -> DataFrame:
    """strata with n_taken, the cap dealt in proportion to size: floors first, then one each by largest remainder, size, label.

    strata are one row a label, few enough for one task.
    """
    every = Window.partitionBy()
    share = F.col(size) * F.least(F.lit(cap), F.sum(size).over(every)) / F.sum(size).over(every)
    df = strata.withColumn("__share", share).withColumn("__floor", F.floor("__share"))
    left = F.least(F.lit(cap), F.sum(size).over(every)) - F.sum("__floor").over(every)
    order = Window.orderBy((F.col("__share") - F.col("__floor")).desc(), F.col(size).desc(), F.col(label).desc())
    return df.withColumn("n_taken", (F.col("__floor") + (F.row_number().over(order) <= left).cast("int")).cast("long")).drop("__share", "__floor")
