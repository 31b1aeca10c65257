"""The join of similar sets against all pairs, and what it joins."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import setjoin
from tallywright.operators.setjoin import rarest, shingle_arrays, similar_sets


def plain(left, right, threshold):
    out = {}
    for a, x in left.items():
        for b, y in right.items():
            both = len(x & y)
            if both and 1000 * both >= round(1000 * threshold) * len(x | y) and (left is not right or a < b):
                out[a, b] = (round(both / len(x | y), 9), round(both / len(x), 9))
    return out


def sets(seed, n, words=300):
    """Sets around a common part, with near copies, small and empty ones."""
    rng = np.random.default_rng(seed)
    common, out = set(range(10)), {}
    for i in range(n):
        base = out[int(rng.integers(0, i))] if i and rng.random() < 0.5 else common | set(map(int, rng.integers(10, words, int(rng.integers(0, 30)))))
        out[i] = {x for x in base if rng.random() > 0.08} | set(map(int, rng.integers(10, words, int(rng.integers(0, 3)))))
    out[n] = set()
    return out


def frame(spark, held, key):
    return spark.createDataFrame([(k, sorted(v)) for k, v in held.items()], f"{key} long, tokens array<long>").repartition(4)


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6, 0.75, 1.0])
def test_join_is_exact(spark, threshold):
    left, right = sets(1, 120), sets(2, 160)
    right |= {1000 + k: v for k, v in left.items()}
    got = similar_sets(frame(spark, left, "a"), frame(spark, right, "b"), threshold, "a", "b").collect()
    assert {(r["a"], r["b"]): (round(r["jaccard"], 9), round(r["covered"], 9)) for r in got} == plain(left, right, threshold)
    got = similar_sets(frame(spark, left, "x"), None, threshold, "x", "y").collect()
    assert {(r["x"], r["y"]): (round(r["jaccard"], 9), round(r["covered"], 9)) for r in got} == plain(left, left, threshold)
    assert len(got) == len({(r["x"], r["y"]) for r in got})


def test_odd_sets(spark):
    some = frame(spark, {1: {1, 2}, 2: set()}, "a")
    assert similar_sets(some, None, 0.5, "a", "b").count() == 0
    assert similar_sets(some.where("false"), some.withColumnRenamed("a", "b"), 0.5, "a", "b").count() == 0
    with pytest.raises(ValueError):
        similar_sets(some, None, 0.0, "a", "b")
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "too short"), (4, "A  b\nc d e f a b c d e")], "id long, text string")
    assert {r["id"]: len(r["tokens"]) for r in shingle_arrays(texts, "id", "text").collect()} == {1: 2, 4: 6}


def test_frequent_elements_bring_nobody_together(spark):
    """Two thousand sets of 60 common elements and 30 of their own: similarities of 0.5, and no element of the common ones is joined."""
    held = {i: set(range(60)) | {1000 + 100 * i + j for j in range(30)} for i in range(2000)}
    held |= {5000 + i: {x for x in held[i] if x != 3} for i in range(20)}
    df = frame(spark, held, "a")
    count = Counter(x for v in held.values() for x in v)
    frequency = spark.createDataFrame([(x, n) for x, n in count.items() if n > 1], "token long, n long")
    met = rarest(df, frequency, "a", setjoin.Fraction("0.75")).groupBy("token").agg(F.count("*").alias("n"))
    assert met.agg(F.max("n")).first()[0] <= 2
    got = {(r["a"], r["b"]) for r in similar_sets(df, None, 0.75, "a", "b").collect()}
    assert got == {(i, 5000 + i) for i in range(20)}


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6, 0.75, 1.0])
@pytest.mark.parametrize("few", [1, 3])
def test_elements_that_are_counted_lose_no_pair(spark, monkeypatch, threshold, few):
    monkeypatch.setattr(setjoin, "FEW", few)
    held = sets(3, 150, words=120)
    # Lopsided pairs, and sets that share nothing but what is frequent.
    held |= {1000 + i: set(range(i)) for i in range(1, 26)} | {2000 + i: set(range(12)) | {5000 + i} for i in range(6)}
    got = similar_sets(frame(spark, held, "x"), None, threshold, "x", "y").collect()
    assert {(r["x"], r["y"]): (round(r["jaccard"], 9), round(r["covered"], 9)) for r in got} == plain(held, held, threshold)
    assert len(got) == len({(r["x"], r["y"]) for r in got})


def test_a_table_with_itself_moves_half_of_its_elements(spark):
    """2,000 sets of 100 elements of their own: each element was moved twice, some 24 bytes."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 100)]) for i in range(2000)], "a long, tokens array<long>")
    moved = lambda: sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = moved()
    assert similar_sets(df, None, 0.6, "a", "b").count() == 0
    assert moved() - before < 12 * 2000 * 100
