"""Alignment against a plain quadratic version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright import suite
from tallywright.operators.align import align, identity_over_alignment, word_sequence
from tallywright.shipping import ship
from tests.conftest import SF


def plain(a, b):
    """Cell by cell, three states, (score, matches, -pairs) compared as tuples."""
    none = (-(10**9), 0, 0)
    add = lambda t, s, m=0, p=0: (t[0] + s, t[1] + m, t[2] - p)
    m, x, y = ([[none] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    m[0][0] = (0, 0, 0)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                above = max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1])
                m[i][j] = add(above, 10, 1, 1) if a[i - 1] == b[j - 1] else add(above, 0, 0, 1)
            if j:
                x[i][j] = max(add(max(m[i][j - 1], y[i][j - 1]), -10), add(x[i][j - 1], -1))
            if i:
                y[i][j] = max(add(max(m[i - 1][j], x[i - 1][j]), -10), add(y[i - 1][j], -1))
    score, matches, pairs = max(m[-1][-1], x[-1][-1], y[-1][-1])
    return score, matches, -pairs


def test_alignment_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(150):
        a, b = (rng.integers(0, 4, int(rng.integers(1, 14))) for _ in "ab")
        if rng.random() < 0.5:
            b = np.delete(np.repeat(a, rng.integers(1, 3, len(a))), rng.integers(0, len(a), 2))
        if len(b):
            assert align(a, b) == plain(a.tolist(), b.tolist()) == align(b, a)
    assert align(np.arange(3), np.arange(3)) == (30, 3, 3)
    assert align(np.array([1, 2, 3]), np.array([1, 9, 9, 2, 3])) == (30 - 11, 3, 3)
    with pytest.raises(ValueError, match="too long"):
        align(np.zeros(2**21, np.int64), np.zeros(2**21, np.int64))


def test_identities_of_pairs(spark):
    ship(spark)
    rows = [(1, "a b c d", "a b x d"), (2, "a b", None), (3, "", "a"), (4, "a b c", "z A B c z z"), (4, "a b c", "z A B c z z"), (5, None, None)]
    df = spark.createDataFrame(rows, "id long, x string, y string").select("id", word_sequence(F.col("x")).alias("x"), word_sequence(F.col("y")).alias("y"))
    got = sorted((r["id"], r["matches"], r["aligned"], r["identity"], r["coverage"]) for r in identity_over_alignment(df, "x", "y").collect())
    assert got == [(1, 3, 4, 0.75, 1.0), (2, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0), (4, 3, 3, 1.0, 1.0), (4, 3, 3, 1.0, 1.0), (5, 0, 0, 0.0, 0.0)]
    assert identity_over_alignment(df.where("false"), "x", "y").count() == 0


def test_passages_in_documents(spark):
    """Every document that holds a third of a passage's runs of five words, aligned by the plain version."""
    texts = {r["doc_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"]}
    items = {r["item_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {}
    for k, item in items.items():
        for d, text in texts.items():
            if runs(item) and 10 * len(runs(item) & runs(text)) >= 3 * len(runs(item)):
                score, matches, pairs = plain(item, text)
                want[k, d] = (score / 10, matches, pairs, round(matches / pairs, 6), round(pairs / len(item), 6))
    got = {(r["item_id"], r["doc_id"]): (r["score"], r["matches"], r["aligned"], r["identity"], r["coverage"]) for r in suite.queries()["passage_identity"](spark, SF).collect()}
    assert got == want and want
