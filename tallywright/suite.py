"""All registered queries outside the optional subpackage, and the SQL that each has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.plans import aggregates, joins, ranks, scans, scores, similarity

#: Modules that each have QUERIES: name -> (function of (spark, sf_dir), SQL or None).
MODULES: tuple = (scans, joins, aggregates, ranks, scores, similarity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
