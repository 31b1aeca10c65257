"""Event logs: sequence numbers, sessions, leases and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_seq(events: DataFrame, job: str, ts: str, order: list[str]) -> DataFrame:
    """A gap-free seq from 1 in each job, by ts, then order; a job's days are numbered apart and joined by their counts, so no task has the log of a busy job.

    Events without a time come first in their job.
    """
    rows = events.withColumn("__day", F.to_date(ts))
    days = rows.groupBy(F.col(job).alias("__job"), F.col("__day").alias("__of")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__job").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(job, "__day").orderBy(ts, *order))
    joined = rows.join(days, rows[job].eqNullSafe(days["__job"]) & rows["__day"].eqNullSafe(days["__of"]))
    return joined.withColumn("seq", (F.col("__before") + inside).cast("long")).drop("__day", "__job", "__of", "__n", "__before")


def seconds(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, as seconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def with_sessions(events: DataFrame, job: str, ts: str, order: list[str], gap: int) -> DataFrame:
    """A session number from 1 in each job; a new one begins after more than `gap` seconds of silence."""
    w = Window.partitionBy(job).orderBy(*order)
    late = seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(w) > gap
    return events.withColumn("__new", F.coalesce(late, F.lit(True)).cast("long")).withColumn("session", F.sum("__new").over(w)).drop("__new")


def latest(events: DataFrame, job: str, order: list[str], *columns: str) -> DataFrame:
    """The columns of each job's last event, by partial aggregation instead of a sort."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(job).agg(last.alias("__l"), F.count("*").alias("n")).select(job, "__l.*", "n")
