"""Point sets moved onto a reference before they are compared or clustered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.shipping import ship
from tallywright.sources.files import keep


def onto(x: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Frames (n x points x d), each moved and turned, not mirrored, to lie as near as it can to the reference, whose center is 0."""
    centered = x - x.mean(axis=1, keepdims=True)
    u, _, v = np.linalg.svd(np.swapaxes(centered, 1, 2) @ reference)
    sign = np.sign(np.linalg.det(u @ v))
    u[:, :, -1] *= np.where(sign == 0, 1, sign)[:, None]
    return centered @ (u @ v)


def align_frames(frames: DataFrame, key: str, points: str, d: int = 3) -> DataFrame:
    """(key, points, residual) of frames (key, points): points moved onto those of the smallest key, and their distance from them, root mean square.

    points are arrays of numbers, d to a point. Frames that are null, have a null or non-finite number, or
    another count of numbers than the reference, are left out; so is everything
    if d doesn't divide that count. Each frame takes the singular values of a matrix of d x d, where it lies.
    """
    good = F.forall(points, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = frames.select(key, F.col(points).cast("array<double>").alias(points)).where(F.col(points).isNotNull() & good & (F.size(points) > 0) & (F.size(points) % d == 0))
    first = rows.where(F.col(key).isNotNull()).orderBy(key, points).select(points).first()
    kind = rows.schema[key].dataType.simpleString()
    if first is None:
        return rows.withColumn("residual", F.lit(0.0)).where("false")
    reference = np.array(first[0]).reshape(-1, d)
    reference -= reference.mean(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1, d)
            moved = onto(x, reference) if len(x) else x
            far = np.sqrt(((moved - reference) ** 2).sum(axis=2).mean(axis=1))
            flat = pa.array(moved.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, reference.size, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(far)], [key, points, "residual"])

    ship(frames.sparkSession)
    return rows.where(F.size(points) == reference.size).mapInArrow(run, f"`{key}` {kind}, `{points}` array<double>, residual double")


def cluster_frames(frames: DataFrame, key: str, points: str, k: int, starts: int = 10, seed: int = 0, rounds: int = 20) -> DataFrame:
    """(key, cluster, distance, is_medoid) of frames (key, points): k-means with several starts, of which the one of the least squared distances counts.

    Clusters are numbered from 0 in the order of their smallest keys; a
    cluster's medoid is the frame nearest to its center, ties to the smaller key. There are no more clusters than frames.
    """
    spark = frames.sparkSession
    rows = keep(frames.select(key, array_to_vector(points).alias("features")), "frames")
    n = rows.count()
    if n == 0:
        return rows.select(key, F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("distance"), F.lit(False).alias("is_medoid")).where("false")
    if k == 1 or n == 1:
        center = rows.select(F.explode(F.transform(vector_to_array("features"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))).alias("e")).groupBy("e.i").agg(F.avg("e.x").alias("x"))
        centers = [[r["x"] for r in center.orderBy("i").collect()]]
        assigned = rows.withColumn("prediction", F.lit(0))
    else:
        models = [KMeans(k=min(k, n), seed=seed + i, maxIter=rounds).fit(rows) for i in range(starts)]
        model = min(models, key=lambda m: m.summary.trainingCost)
        centers = [[float(x) for x in c] for c in model.clusterCenters()]
        assigned = model.transform(rows)
    table = spark.createDataFrame(list(enumerate(centers)), "prediction int, center array<double>")
    gap = F.aggregate(F.zip_with(vector_to_array("features"), "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = assigned.join(F.broadcast(table), "prediction").select(key, "prediction", F.round(F.sqrt(gap), 9).alias("distance"))
    named = far.groupBy("prediction").agg(F.min(key).alias("least"), F.min(F.struct("distance", key)).alias("m"))
    order = {r["prediction"]: i for i, r in enumerate(named.orderBy("least").select("prediction").collect())}
    number = spark.createDataFrame(list(order.items()), "prediction int, cluster long")
    named = named.select("prediction", F.col(f"m.{key}").alias("medoid")).join(F.broadcast(number), "prediction")
    return far.join(F.broadcast(named), "prediction").select(key, "cluster", "distance", (F.col(key) == F.col("medoid")).alias("is_medoid"))
