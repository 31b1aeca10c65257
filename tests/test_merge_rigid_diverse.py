"""The ordered merge, rigid alignment with clusters, and diverse selections, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import search
from tallywright.operators.diverse import diverse
from tallywright.operators.merge import OrderError, check_ascending, merge_ordered, read_ordered
from tallywright.operators.rigid import align_frames, cluster_frames, onto
from tests.conftest import SF


def files(spark, path, *parts):
    for i, keys in enumerate(parts):
        spark.createDataFrame([(k, f"v{k}") for k in keys], "id long, v string").coalesce(1).write.parquet(f"{path}/{i:02d}")
    return read_ordered(spark, *[f"{path}/{i:02d}" for i in range(len(parts))])


def renamed(spark, path, *parts):
    """One folder whose files sort in the order given."""
    import glob
    import os

    files(spark, f"{path}/raw", *parts)
    os.makedirs(f"{path}/all")
    for i in range(len(parts)):
        os.rename(glob.glob(f"{path}/raw/{i:02d}/part-*.parquet")[0], f"{path}/all/part-{i:02d}.parquet")
    return read_ordered(spark, f"{path}/all")


def test_merge_in_order(spark, tmp_path):
    stream = renamed(spark, str(tmp_path), range(0, 3000, 3), range(3000, 3500), [9000])
    assert check_ascending(stream, "id") == 1501
    ids = spark.createDataFrame([(3,), (4,), (3,), (3001,), (9000,), (None,)], "id long")
    assert sorted(map(tuple, merge_ordered(ids, stream, "id").collect())) == [(3, "v3"), (3001, "v3001"), (9000, "v9000")]
    with pytest.raises(ValueError, match="1 of 4 ids"):
        merge_ordered(ids, stream, "id", most_missing=0.1)
    assert merge_ordered(ids.where("false"), stream, "id").count() == 0


@pytest.mark.parametrize(
    "parts", [([1, 2, 4, 3, 5], [6]), ([1, 2, 2], [6]), ([1, 2, 6], [6, 7]), ([5, 6], [1, 2]), ([1, None, 3], [4])], ids=["swapped", "repeated", "across", "files", "null"]
)
def test_a_break_of_the_order_is_an_error(spark, tmp_path, parts):
    stream = renamed(spark, str(tmp_path), *parts)
    with pytest.raises(OrderError, match="doesn't ascend"):
        merge_ordered(spark.createDataFrame([(1,)], "id long"), stream, "id")


def test_order_within_many_stretches(spark, tmp_path):
    """A file of several row groups, read in several tasks, with one swapped row where two stretches meet."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    keys = np.arange(60_000)
    keys[[20_000, 19_999]] = keys[[19_999, 20_000]]
    pq.write_table(pa.table({"id": np.arange(60_000), "v": ["x" * 40] * 60_000}), f"{tmp_path}/good.parquet", row_group_size=5_000)
    pq.write_table(pa.table({"id": keys, "v": ["x" * 40] * 60_000}), f"{tmp_path}/bad.parquet", row_group_size=5_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        good = read_ordered(spark, f"{tmp_path}/good.parquet")
        assert good.rdd.getNumPartitions() > 3 and check_ascending(good, "id") == 60_000
        with pytest.raises(OrderError, match="row 20000 "):
            check_ascending(read_ordered(spark, f"{tmp_path}/bad.parquet"), "id")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def turned(rng, x, d):
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    q[:, 0] *= np.sign(np.linalg.det(q))
    return x.reshape(-1, d) @ q + rng.normal(size=d)


def test_turned_copies_are_one_cluster(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(3).collect()}
    rng, rows = np.random.default_rng(1), []
    for i, x in enumerate(vectors.values()):
        rows += [(10 * i + k, (turned(rng, x, 4) if k else x).ravel().tolist()) for k in range(8)]
    odd = [(900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] * 64), (904, []), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "id long, points array<double>").repartition(3)
    aligned = align_frames(df, "id", "points", 4)
    residual = {r["id"]: r["residual"] for r in aligned.collect()}
    assert len(residual) == 25 and all(residual[k] < 1e-6 for k in range(8)) and residual[10] > 0.01
    got = {r["id"]: (r["cluster"], r["distance"], r["is_medoid"]) for r in cluster_frames(aligned.where("id is not null"), "id", "points", 3, starts=6).collect()}
    assert [got[10 * i + k][0] for i in range(3) for k in range(8)] == [i for i in range(3) for _ in range(8)]
    assert all(d < 1e-6 for _, d, _ in got.values()) and [k for k, v in got.items() if v[2]] and sum(v[2] for v in got.values()) == 3
    assert align_frames(df.where("false"), "id", "points", 4).count() == 0
    assert cluster_frames(aligned.where("id = 10"), "id", "points", 5).count() == 1
    mirrored = vectors[min(vectors)].reshape(-1, 4) * [1, 1, 1, -1]
    reference = vectors[min(vectors)].reshape(-1, 4)
    reference = reference - reference.mean(axis=0)
    assert np.abs(onto(mirrored[None], reference) - reference).max() > 0.01


def plain_choice(rows, n, weight):
    out = {}
    for g in {r[0] for r in rows}:
        mine, chosen = [r for r in rows if r[0] == g], []
        while len(chosen) < min(n, len(mine)):
            worth = lambda r: round(r[2] - weight * max((search.TANIMOTO.similarity(np.array([r[3]]), np.array([c[3]]))[0, 0] for c in chosen), default=0.0), 9)
            best = min((r for r in mine if r not in chosen), key=lambda r: (-worth(r), r[1]))
            out[g, best[1]] = (len(chosen) + 1, worth(best))
            chosen.append(best)
    return out


@pytest.mark.parametrize("shortlist", [1024, 6, 1])
def test_diverse_choices(spark, shortlist):
    rng = np.random.default_rng(4)
    bases = rng.integers(0, 2**20, (5, 2))
    rows = [(i % 3, i, round(float(rng.integers(0, 12)) / 12, 6), (bases[i % 5] ^ rng.integers(0, 4, 2)).tolist()) for i in range(60)] + [(7, 100, 0.5, [0, 0]), (7, 101, 0.5, [0, 0])]
    odd = [(None, 1, 0.5, [1, 1]), (0, None, 0.5, [1, 1]), (0, 200, None, [1, 1]), (0, 201, float("nan"), [1, 1]), (0, 202, 9.0, None), (0, 203, 9.0, [None, 1])]
    df = spark.createDataFrame(rows + odd, "g int, id long, score double, vector array<long>").repartition(4)
    got = {(r["g"], r["id"]): (r["step"], r["value"]) for r in diverse(df, "g", 5, 0.6, shortlist).collect()}
    assert got == plain_choice(rows, 5, 0.6)
    assert diverse(df.where("false"), "g", 5).count() == 0
