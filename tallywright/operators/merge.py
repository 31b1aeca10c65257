"""A stream in strict order, merged with a list of ids; a break of the order is an error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.shipping import ship


class OrderError(ValueError):
    """A key that isn't greater than the one before it."""


def read_ordered(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with `__file` and `__place`, where each row stands."""
    rows = spark.read.parquet(*paths)
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))


def check_ascending(stream: DataFrame, key: str) -> int:
    """The number of rows of a stream (of read_ordered) whose keys ascend strictly through all files, in the order of their names; else OrderError.

    Tasks look at their own stretch of a file as it is read, and send its ends and
    where it first breaks, one row a stretch; the ends of stretches are compared within
    files, and then the files' own, so nothing is sorted and no row is moved. A null key is a break.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[str, list] = {}
        for batch in batches:
            keys, files, places = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            x = keys.fill_null(0).to_numpy()
            cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or places[i] != places[i - 1] + 1), len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                bad = np.flatnonzero(~known[a:b] | np.concatenate(([False], x[a + 1 : b] <= x[a : b - 1])))
                breaks = int(places[a + bad[0]]) if len(bad) else None
                end = ends.get(files[a])
                if end and end[1] + 1 == places[a]:
                    if end[4] is None:
                        end[4] = int(places[a]) if x[a] <= end[3] else breaks
                    end[1], end[3] = int(places[b - 1]), int(x[b - 1])
                else:
                    if end:
                        yield row(files[a], end)
                    ends[files[a]] = [int(places[a]), int(places[b - 1]), int(x[a]), int(x[b - 1]), breaks]
        for name, end in ends.items():
            yield row(name, end)

    def row(name: str, end: list) -> pa.RecordBatch:
        values = [[name], *([v] for v in end)]
        kinds = [pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["file", "first", "last", "low", "high", "breaks"])

    ship(stream.sparkSession)
    ends = stream.select(F.col(key).cast("long"), "__file", "__place").mapInArrow(run, "file string, first long, last long, low long, high long, breaks long").persist()
    try:
        before = F.lag("high").over(Window.partitionBy("file").orderBy("first"))
        inside = ends.withColumn("breaks", F.coalesce("breaks", F.when(before >= F.col("low"), F.col("first"))))
        files = inside.groupBy("file").agg(F.min("breaks").alias("breaks"), F.min_by("low", "first").alias("low"), F.max_by("high", "first").alias("high"), F.sum(F.col("last") - F.col("first") + 1).alias("n"))
        # One row a file.
        across = F.lag("high").over(Window.orderBy("file"))
        files = files.withColumn("breaks", F.coalesce("breaks", F.when(across >= F.col("low"), 0)))
        found = files.agg(F.min(F.when(F.col("breaks").isNotNull(), F.struct("file", "breaks"))).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    finally:
        ends.unpersist()
    if found["b"]:
        raise OrderError(f"{key} doesn't ascend at row {found['b']['breaks']} of {found['b']['file']}")
    return found["n"]


def merge_ordered(ids: DataFrame, stream: DataFrame, key: str, most_missing: float = 1.0) -> DataFrame:
    """The rows of an ordered stream (of read_ordered) whose key is among ids (one column named as key), each once.

    The stream's order is checked first (check_ascending), so keys are unique
    in it; ids may repeat and come in any order. Both sides are dealt by key and merged in
    order, which Spark does without holding either. If more than the share
    `most_missing` of the different ids has no row, ValueError.
    """
    check_ascending(stream, key)
    wanted = ids.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    if most_missing < 1:
        missing = wanted.join(stream.select(F.col(key).cast("long").alias(key)).hint("merge"), key, "left_anti").count()
        total = wanted.count()
        if missing > most_missing * total:
            raise ValueError(f"{missing} of {total} ids have no row")
    return stream.join(wanted.hint("merge"), key, "left_semi").drop("__file", "__place")
