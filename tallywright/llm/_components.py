"""Connected components by alternating stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm._store import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): one row (node, component) for each node that has an edge, component its smallest reachable node.

    Each round points every neighbour of a node at the node's smallest neighbour
    (first the larger ones, then the smaller ones and itself) until no edge
    changes, which takes a number of rounds that grows with the logarithm of the
    nodes. All steps are sums by key with map-side combining, or joins of edges
    with one row a key, which adaptive execution splits where a key is hot; no
    node's neighbours are gathered. Every round is written to the shared folder.
    """
    table = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(table)
    while mark[0]:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(table)
        table, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
