"""Similarity of bit sets, vectors and word sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rows an inverted index is broadcast; above, it shuffles.
INDEX_ROWS = 1_000_000


def pack_signs(vector: Column) -> Column:
    """The signs of all components as words of 64 bits (array<bigint>), the first component in the lowest bit of the first word."""

    def word(k: Column) -> Column:
        part = F.reverse(F.slice(vector, k * 64 + 1, F.lit(64)))
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vector) / 64).cast("int"), F.lit(1)) - 1), word)


def bits_set(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, x: s + F.bit_count(x))


def tanimoto(a: Column, b: Column) -> Column:
    """Common over all bits of two sets of words; 0 for two empty ones. A missing word has no bits."""
    word = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    both = F.zip_with(a, b, lambda x, y: word(x).bitwiseAND(word(y)))
    some = F.zip_with(a, b, lambda x, y: word(x).bitwiseOR(word(y)))
    return F.coalesce(F.try_divide(bits_set(both), bits_set(some)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tanimoto_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """tanimoto() of each row of words of a with each of b."""
    x, y = (np.unpackbits(np.ascontiguousarray(w, np.int64).view(np.uint8), axis=1).astype(np.float32) for w in (a, b))
    both = (x @ y.T).astype(np.float64)
    some = x.sum(axis=1, dtype=np.float64)[:, None] + y.sum(axis=1, dtype=np.float64)[None] - both
    return np.divide(both, some, out=np.zeros_like(both), where=some > 0)


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with each of b in double precision; 0 with a zero vector."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    size = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None]
    return np.divide(a @ b.T, size, out=np.zeros((len(a), len(b))), where=size > 0)


def word_shingles(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """(key, shingle, size): the different runs of `words` lower-case words of each text, as 64-bit hashes, and how many it has; shorter texts have none."""
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[ \t\n\r]+"), lambda w: w != "")
    rows = df.select(key, F.transform(tokens, lambda w: F.xxhash64(w)).alias("__w"))
    starts = F.when(F.size("__w") >= words, F.sequence(F.lit(1), F.size("__w") - words + 1))
    rows = rows.select(key, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("__w", i, words)))).alias("__s"))
    # An outer explode: for an inner one Spark infers a filter on the array, which would make all of it a second time.
    rows = rows.select(key, F.size("__s").alias("size"), F.explode_outer("__s").alias("shingle"))
    return rows.where("shingle is not null").select(key, "shingle", "size")


def jaccard_of(left: DataFrame, right: DataFrame, a: str, b: str, most: int = INDEX_ROWS) -> DataFrame:
    """(a, b, jaccard, covered) of all pairs of word_shingles() that share one; covered is the share of a's set.

    left is the index. If it has no more than `most` rows it is broadcast, and
    the right side's shingles are looked up where they lie, so only what is
    shared moves and a frequent shingle makes no task hot; else both sides shuffle.
    """
    index = left.select(a, "shingle", F.col("size").alias("__a"))
    if index.limit(most + 1).count() <= most:
        index = F.broadcast(index)
    both = right.withColumnRenamed("size", "__b").join(index, "shingle").groupBy(a, b, "__a", "__b").agg(F.count("*").alias("__n"))
    n = F.col("__n")
    return both.select(a, b, (n / (F.col("__a") + F.col("__b") - n)).alias("jaccard"), (n / F.col("__a")).alias("covered"))
