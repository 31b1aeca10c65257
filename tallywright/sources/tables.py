"""Reading tables with checked columns, and the evidence view that most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Activity at or above is positive, at or below negative, between them gray.
POSITIVE, NEGATIVE = 6.0, 5.0
#: Added before rounding where means of rounded values end in exact halves, so these round up whatever the order of summing.
TIE = 1e-9
TRAIN_END, DEV_END = "1998-12-31", "1999-12-31"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, or the named columns of it; a missing column raises before anything is read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*columns) if columns else df


def with_optional(df: DataFrame, **types: str) -> DataFrame:
    """Columns that a source may lack become typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def find_column(df: DataFrame, *aliases: str) -> str:
    """The first alias that is a column, whatever its case."""
    known = {c.lower(): c for c in df.columns}
    for a in aliases:
        if a.lower() in known:
            return known[a.lower()]
    raise ValueError(f"none of {aliases} is a column")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements: ligand, target, source (three), family (two), pub, line, p (activity), day, qty, disc, tax."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("ligand"),
        F.col("l_suppkey").alias("target"),
        F.col("l_returnflag").alias("source"),
        F.col("l_linestatus").alias("family"),
        F.col("l_orderkey").alias("pub"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.round(F.log10("l_extendedprice") * 1.3, 6).alias("p"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
    )


#: The same view for SQL.
EVIDENCE = """e AS (SELECT l_partkey AS ligand, l_suppkey AS target, l_returnflag AS source, l_linestatus AS family,
  l_orderkey AS pub, l_linenumber::BIGINT AS line, round(log10(l_extendedprice) * 1.3, 6) AS p, l_shipdate::DATE AS day,
  l_quantity AS qty, l_discount AS disc, l_tax AS tax FROM lineitem)"""
