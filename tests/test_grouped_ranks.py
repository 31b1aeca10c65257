"""Ranks, row numbers and percentiles of groups against plain versions, and that no plan ranks a hot group in one task."""

import re
import statistics

import pytest
from pyspark.sql import functions as F

from tallywright import suite
from tallywright.operators import rank
from tallywright.operators.rank import exact_percentile, grouped_ranks, grouped_row_numbers, hashed_row_numbers, stable_hash
from tests.conftest import SF


def rows_of(n=900):
    group = lambda i: None if i % 97 == 0 else "hot" if i % 3 else f"g{i % 11}"
    return [(i, group(i), i % 2, None if i % 53 == 0 else 7.5 if i % 4 == 0 else float(i * 37 % 101)) for i in range(n)]


@pytest.mark.parametrize("down", [True, False])
def test_ranks_in_groups(spark, down):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id long, g string, h int, v double").repartition(5)
    got = {r["id"]: (r["rank_min"], r["rank_avg"], r["rank_dense"], r["n_values"]) for r in grouped_ranks(df, ["g", "h"], "v", down).collect()}
    assert len(got) == len(rows)
    for i, g, h, v in rows:
        peers = [r[3] for r in rows if r[1:3] == (g, h) and r[3] is not None]
        if v is None:
            assert got[i] == (None,) * 4
            continue
        ahead = [x for x in peers if (x > v if down else x < v)]
        assert got[i] == (len(ahead) + 1, len(ahead) + (peers.count(v) + 1) / 2, len(set(ahead)) + 1, len(peers))


@pytest.mark.parametrize("down", [True, False])
def test_row_numbers_in_groups(spark, down):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id long, g string, h int, v double").repartition(5)
    got = {r["id"]: r["rank"] for r in grouped_row_numbers(df, ["g"], "v", "id", down).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g and r[3] is not None), key=lambda r: (-r[3] if down else r[3], r[0]))
        want |= {r[0]: k for k, r in enumerate(mine, 1)}
    assert got == want
    assert grouped_row_numbers(df.where("false"), ["g"], "v", "id").count() == 0


def test_hashed_row_numbers(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id long, g string, h int, v double").withColumn("hash", stable_hash(F.lit("x"), F.col("id")))
    got = {r["id"]: (r["rank"], r["n"]) for r in hashed_row_numbers(df, ["g"], F.col("hash"), "id").collect()}
    digest = {r["id"]: r["hash"] for r in df.collect()}
    for g in {r[1] for r in rows}:
        mine = sorted((r[0] for r in rows if r[1] == g), key=lambda i: (digest[i], i))
        assert {i: got[i] for i in mine} == {i: (k, len(mine)) for k, i in enumerate(mine, 1)}


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_percentiles(spark, p):
    rows = [*rows_of(), (2000, "one", 0, 3.0), (2001, "none", 0, None)]
    df = spark.createDataFrame(rows, "id long, g string, h int, v double")
    got = {r["g"]: (r["percentile"], r["n"]) for r in exact_percentile(df, ["g"], "v", p).collect()}
    for g in {r[1] for r in rows} - {"none"}:
        x = sorted(r[3] for r in rows if r[1] == g and r[3] is not None)
        at = (len(x) - 1) * p
        want = x[int(at)] + (at - int(at)) * (x[min(int(at) + 1, len(x) - 1)] - x[int(at)])
        assert got[g] == (pytest.approx(want, abs=1e-9), len(x))
        if p == 0.5:
            assert got[g][0] == pytest.approx(statistics.median(x))
    assert "none" not in got


#: Groups of these queries can hold a third of all rows.
HOT = "union_ranked_sources rrf_fusion rrf_weighted rrf_min_sources rrf_contributions hash_alternate_split hash_holdout_strata stratified_hash_sample grouped_avg_rank leave_one_out_background first_observation_filter agg_activity_strata strata_delta_join robust_zscore top_pct_floor".split()


@pytest.mark.parametrize("name", HOT)
def test_no_task_ranks_a_group(spark, name):
    plan = suite.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and not re.search(r"percentile\(|median\(", plan)
    for spec in re.findall(r"windowspecdefinition\(([^()]*)", plan):
        keys = [k for k in spec.split(", ") if not re.search(r" (ASC|DESC) |specifiedwindowframe", k)]
        # A window is over a range of a group, or over what one sum a range of a group has left.
        sums = spec.startswith("__r#") or "__part#" in spec or not keys and "(" not in spec and " ASC" not in spec and " DESC" not in spec
        assert sums or name == "stratified_hash_sample" or any(re.match(r"_{2,}", k) for k in keys), (spec, keys)


@pytest.mark.parametrize("gathered", [0, 50, 100_000])
def test_median_and_deviation(spark, monkeypatch, gathered):
    monkeypatch.setattr(rank, "GATHERED", gathered)
    rows = [*rows_of(), (2000, "one", 0, 3.0), (2001, "none", 0, None), (2002, "two", 0, 1.0), (2003, "two", 0, 4.0)]
    df = spark.createDataFrame(rows, "id long, g string, h int, v double").repartition(5)
    got = {r["g"]: (r["m"], r["mad"], r["n"]) for r in rank.median_and_deviation(df, ["g"], "v").collect()}
    assert set(got) == {r[1] for r in rows} - {"none"}
    for g, (m, mad, n) in got.items():
        x = [r[3] for r in rows if r[1] == g and r[3] is not None]
        assert m == pytest.approx(statistics.median(x)) and mad == pytest.approx(statistics.median(abs(y - m) for y in x))
        assert n == sum(r[1] == g for r in rows)


def test_backgrounds_are_moved_once(spark):
    """Nothing but the final join is left: medians of small groups take one shuffle, where two rankings in ranges took a dozen."""
    plan = suite.queries()["robust_zscore"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
