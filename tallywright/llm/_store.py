"""Tables written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.sources.files import scratch

#: Up to so many rows, and so many bytes of strings in them, a semi-join's ids or
#: a small dimension is broadcast (with hash-table room some 64 MB on an
#: executor); above either, Spark shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder (scratch)."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    It cuts the lineage like checkpoint(), but is columnar and compressed, so
    later readers take only the columns they need, and a lost executor costs
    no more than its own tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallywright_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tallywright_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows and string bytes stay within the limits.

    df should be a materialized table of a few columns, so that the count is a
    footer read, or a scan of its strings; beyond a limit it is returned as it
    is, and the join shuffles.
    """
    strings = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(strings)), F.lit(0)) if strings else F.lit(0)).first()
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df
