"""The pruned search against all pairs, and how much it compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import search
from tallywright.shipping import ship


def plain(measure, ids, labels, v, q, k, may=lambda a, b, s: True):
    s = np.round(measure.similarity(v, v), 6)
    i = ids.index(q)
    found = [(ids[j], s[i, j]) for j in range(len(ids)) if ids[j] != q and may(labels[i], labels[j], s[i, j])]
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def frame(spark, ids, labels, v, kind):
    rows = [(i, int(c) if c == c else None, x.tolist()) for i, c, x in zip(ids, labels, v, strict=True)]
    return spark.createDataFrame([*rows, (None, 1, v[0].tolist()), (9000, 1, None), (9001, 1, [None] * v.shape[1])], f"id long, label long, vector array<{kind}>").repartition(4)


def clustered(measure, n, rng):
    """Tight groups of points far from each other, with some zero vectors and copies."""
    centers = rng.normal(size=(n // 40, 24))
    x = np.repeat(centers, 40, axis=0) + 0.05 * rng.normal(size=(n // 40 * 40, 24))
    if measure is search.COSINE:
        x[3], x[5] = 0, x[4]
        return x, "double"
    words = np.zeros((len(x), 2), np.int64)
    on = (centers > 0.3)[np.repeat(np.arange(n // 40), 40)] ^ (rng.random(x.shape) < 0.03)
    for j in range(24):
        words[:, j % 2] |= on[:, j].astype(np.int64) << (j * 2 + j % 3 * 7)
    words[3], words[5] = 0, words[4]
    words[7, 1] |= np.int64(-(2**63))
    return words, "bigint"


@pytest.mark.parametrize("measure", [search.TANIMOTO, search.COSINE], ids=["bits", "vectors"])
def test_nearest_is_exact_and_prunes(spark, measure):
    ship(spark)
    rng = np.random.default_rng(7)
    v, kind = clustered(measure, 2000, rng)
    ids = [int(i) for i in rng.permutation(5000)[: len(v)]]
    labels = [float(i % 3) if i % 7 else float("nan") for i in range(len(v))]
    df = frame(spark, ids, labels, v, kind)
    asked = df.where("id % 20 = 0")
    index = search.build(df, measure, block=64)
    queries = [i for i in ids if i % 20 == 0]
    tally = []
    got = {}
    for r in search.nearest(index, asked, 4, block=64, tally=tally).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["vec_id"], r["similarity"]))
    for q in queries:
        assert [x[1:] for x in sorted(got[q])] == plain(measure, ids, labels, v, q, 4), q
    assert sum(tally) < 0.5 * len(ids) * len(queries), tally
    same = search.nearest(index, asked, 1, lambda a, b, s: a == b, block=64).collect()
    want = {q: plain(measure, ids, labels, v, q, 1, lambda a, b, s: a == b) for q in queries}
    assert {r["q"]: [(r["vec_id"], r["similarity"])] for r in same} == {q: w for q, w in want.items() if w}
    s = np.round(measure.similarity(v, v), 6)
    near = {r["q"]: (r["n"], r["n_unlike"]) for r in search.count_within(index, asked, 0.8, block=64).collect()}
    lab = np.array(labels)
    for q in queries:
        i = ids.index(q)
        hit = (s[i] >= 0.8) & (np.arange(len(ids)) != i)
        unlike = hit & ~np.isnan(lab + lab[i]) & (lab != lab[i])
        assert near.get(q, (0, 0)) == (hit.sum(), unlike.sum())


def test_search_of_little(spark):
    ship(spark)
    one = spark.createDataFrame([(0, 1, [1.0, 0.0])], "id long, label long, vector array<double>")
    index = search.build(one, search.COSINE)
    assert search.nearest(index, one, 3).count() == 0
    assert [tuple(r) for r in search.nearest(index, one.withColumn("id", F.lit(5).cast("long")), 3).collect()] == [(5, 0, 1.0, 1)]
    none = search.build(one.where("false"), search.COSINE)
    assert search.nearest(none, one, 3).count() == 0 and search.count_within(none, one, 0.5).count() == 0
    assert search.nearest(index, one.where("false"), 3).count() == 0


def test_queries_of_several_forms(spark):
    ship(spark)
    rng = np.random.default_rng(12)
    v = rng.integers(0, 2**14, (300, 1))
    index = search.build(frame(spark, list(range(300)), [0.0] * 300, v, "bigint"), search.TANIMOTO, block=32)
    forms = {q: [v[q], v[q] ^ rng.integers(0, 2**14, 1)] for q in (3, 50, 120)}
    rows = [(q, f, 0, x.tolist()) for q, fs in forms.items() for f, x in enumerate(fs)] + [(None, 0, 0, [1])]
    got = {}
    for r in search.nearest_forms(index, spark.createDataFrame(rows, "id long, form int, label long, vector array<bigint>"), 3, block=32).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["vec_id"], r["similarity"]))
    for q, fs in forms.items():
        s = np.round(search.TANIMOTO.similarity(np.array(fs), v), 6).max(axis=0)
        want = sorted(((i, s[i]) for i in range(300) if i != q), key=lambda x: (-x[1], x[0]))[:3]
        assert [x[1:] for x in sorted(got[q])] == want


def test_bounds_hold(spark):
    ship(spark)
    rng = np.random.default_rng(11)
    for measure, v, kind in ((search.COSINE, rng.normal(size=(600, 5)), "double"), (search.TANIMOTO, rng.integers(0, 2**12, (600, 1)), "bigint")):
        index = search.build(frame(spark, list(range(600)), [0.0] * 600, v, kind), measure, block=32)
        bound = index.bounds(v)
        of = {r["id"]: r["cell"] for r in index.table.select("cell", F.explode("rows.id").alias("id")).collect()}
        place = {c: i for i, c in enumerate(index.cells["cell"].tolist())}
        s = measure.similarity(v, v)
        for j in range(600):
            assert (bound[:, place[of[j]]] >= s[:, j] - 1e-7).all()
