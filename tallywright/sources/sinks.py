"""Verified sinks: tables written aside and renamed, with a manifest that readers check."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"


def _at(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table_digest(df: DataFrame) -> dict:
    """Rows, and two digests over all columns that the order of rows doesn't change; repeated rows count each time."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows, mixed, total = df.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0))).first()
    return {"rows": rows, "bit_xor": str(mixed), "sum": str(total)}


def write_verified(df: DataFrame, path: str, by: list[str] | None = None, about: dict | None = None) -> dict:
    """Write df as Parquet, read it back, and only then let it take its place; returns the manifest that lies with it.

    A path that is taken raises. Rows go to a folder beside the path, split into
    subfolders by the columns `by` in one pass, and are renamed as a whole once
    the written rows and digests are known, so readers see all of it or
    nothing. The manifest has these, the schema, rows of each split and `about`.
    """
    spark = df.sparkSession
    store, target = _at(spark, path)
    if store.exists(target):
        raise ValueError(f"{path} exists")
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    (df.write.partitionBy(*by) if by else df.write).parquet(aside)
    written = spark.read.schema(df.schema).parquet(aside).select(*df.columns)
    manifest = {"schema": json.loads(written.schema.json()), "by": by or [], "about": about or {}} | table_digest(written)
    if by:
        manifest["splits"] = [r.asDict() for r in written.groupBy(*by).agg(F.count("*").alias("rows")).orderBy(*by).collect()]
    out = store.create(_at(spark, f"{aside}/{MANIFEST}")[1])
    out.write(bytearray(json.dumps(manifest, default=str).encode()))
    out.close()
    if not store.rename(_at(spark, aside)[1], target):
        raise ValueError(f"{path} could not be put in place")
    return manifest


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """A table of write_verified(); rows or digests other than its manifest's raise."""
    store, at = _at(spark, f"{path.rstrip('/')}/{MANIFEST}")
    source = store.open(at)
    manifest = json.loads(bytes(source.readAllBytes()))
    source.close()
    schema = StructType.fromJson(manifest["schema"])
    df = spark.read.schema(schema).parquet(path).select(*schema.names)
    found = table_digest(df)
    if any(manifest[k] != v for k, v in found.items()):
        raise ValueError(f"{path} is not what its manifest says: {found}")
    return df
