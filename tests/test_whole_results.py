"""Results that are whole, and the same in whatever order rows are summed."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallywright import suite
from tallywright.functions import clean
from tests.conftest import SF


def halves(n, places, count):
    """Lists of n values of six decimals whose mean ends in an exact half at `places`, and the mean rounded up there."""
    rng, found = random.Random(7), []
    while len(found) < count:
        x = [rng.randrange(5_000_000, 7_000_000) for _ in range(n)]
        up = Fraction(sum(x) * 10 ** (places - 6), n)
        if up.denominator == 2:
            found.append(([v / 1e6 for v in x], float(up + Fraction(1, 2)) / 10.0**places))
    return found


def test_means_that_end_in_a_half(spark):
    lists = halves(208, 9, 30)
    df = spark.createDataFrame([(g, v) for g, (x, _) in enumerate(lists) for v in x], "g int, v double")
    got = {r["g"]: r for r in df.groupBy("g").agg(clean.rounded_mean(F.col("v"), 9).alias("exact"), F.round(F.avg("v"), 9).alias("plain")).collect()}
    assert all(got[g]["exact"] == want for g, (_, want) in enumerate(lists))
    assert any(got[g]["plain"] != want for g, (_, want) in enumerate(lists))
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, 1e-9), (4, 4e-9), (5, -1.5e-6), (5, -1e-6)], "g int, v double")
    found = {r["g"]: str(r["m"]) for r in odd.groupBy("g").agg(clean.rounded_mean(F.col("v"), 9).alias("m")).collect()}
    assert found == {1: "None", 2: "nan", 3: "inf", 4: "3e-09", 5: "-1.25e-06"}


def test_gaps_that_end_in_a_half(spark):
    lists = halves(32, 6, 30)
    df = spark.createDataFrame([(g, v, None) for g, (x, _) in enumerate(lists) for v in x] + [(g, None, w) for g in range(30) for w in (1.25, 0.75)] + [(99, 2.0, None)], "g int, x double, y double")
    got = {r["g"]: r["gap"] for r in df.groupBy("g").agg(clean.rounded_gap(F.col("x"), F.col("y"), 6).alias("gap"), clean.rounded_gap(F.col("y"), F.col("x"), 6).alias("back")).collect()}
    assert got.pop(99) is None
    assert all(got[g] == pytest.approx(want - 1, abs=1e-12) for g, (_, want) in enumerate(lists))


@pytest.mark.parametrize("name", ["rrf_fusion", "rrf_weighted"])
def test_fusion_keeps_every_target(spark, name):
    targets = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert suite.queries()[name](spark, SF).count() == targets


def test_two_decimals_by_the_binary_value(spark):
    values = [0.125, 2.675, 1.005, -0.001, -0.0, 1e23, float("nan"), float("-inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(clean.fixed2(F.col("v"))).collect()]
    assert got == ["0.12", "2.67", "1.00", "-0.00", "-0.00", "99999999999999991611392.00", "nan", "-inf", None]


def test_odd_balances_as_safe_text(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 7056.355), (3, -0.0), (4, -0.004), (5, -3.0)], "c_custkey long, c_acctbal double")
    df.write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["c_custkey"]: r["safe"] for r in suite.queries()["spreadsheet_safe_text"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: f"{7056.355:.2f}", 3: "-0.00", 4: "'-0.00", 5: "'-3.00"}


def test_fallback_lists_every_case(spark):
    rows = suite.queries()["prior_with_fallback_gate"](spark, SF).collect()
    assert all(len(r["cases"].split(";")) == r["n_cases"] for r in rows)


def test_every_query_has_its_warning(spark, tmp_path):
    """Queries without a vector, or with nothing but such rows beside them, as in the SQL."""
    warned = lambda rows, at: sorted(map(tuple, _warned(spark, rows, str(tmp_path / at)).collect()))
    v = [1.0, -1.0, 1.0, 1.0]
    assert warned([(0, v, 1), (20, None, 1), (21, v, 1), (40, v, 2), (41, None, 3)], "some") == [(0, 1.0, 1.0, "boxed"), (20, None, None, "none"), (40, 1.0, None, "boxed")]
    assert warned([(0, v, 1), (7, None, 1)], "beside") == [(0, None, None, "none")]
    assert warned([(0, None, 1), (None, v, 1)], "alone") == []


def _warned(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return suite.queries()["similarity_warnings"](spark, path).select("q", "nearest", "same_scaffold", "warning")
