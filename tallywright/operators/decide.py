"""Votes, gates and decisions with their reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(**masks: Column) -> Column:
    """The names of the masks that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(m, F.lit(name)) for name, m in masks.items()]))


def tier(x: Column, *cuts: tuple[float, str], below: str) -> Column:
    """The label of the first cut that x reaches."""
    return reduce(lambda c, cut: c.when(x >= cut[0], cut[1]), cuts[1:], F.when(x >= cuts[0][0], cuts[0][1])).otherwise(below)


def vote(*calls: Column, halt: int = 2) -> Column:
    """Of 0/1/null calls: FLAG_HIGH without any call, HALT from `halt` positives on, FLAG_HIGH from one, else PASS."""
    known = sum((c.isNotNull().cast("int") for c in calls), F.lit(0))
    positive = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in calls), F.lit(0))
    return F.when(known == 0, "FLAG_HIGH").when(positive >= halt, "HALT").when(positive >= 1, "FLAG_HIGH").otherwise("PASS")


def bool_like(text: Column) -> Column:
    """Null and blank are false, 0/false/f/no/n and 1/true/t/yes/y as said; anything else raises."""
    x = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(x.isin("", "0", "false", "f", "no", "n"), F.lit(False)).when(x.isin("1", "true", "t", "yes", "y"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean")
    )
