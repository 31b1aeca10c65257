"""Global alignment of sequences with affine gaps, and the identity that it shows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in tenths: a match, a mismatch, a gap's first element and each further one.
MATCH, MISMATCH, OPEN, EXTEND = 10, 0, -10, -1


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score in tenths, matches, aligned pairs) of the best global alignment; of equal scores that of the most matches, then of the fewest pairs.

    Score, matches and pairs are one number each cell, so comparing it breaks
    ties too. Rows run over the shorter sequence; a row's cells over the longer one are
    made at once, gaps along the row by a running maximum, and only one
    row is held, so memory grows with the longer sequence alone.
    """
    if len(a) > len(b):
        a, b = b, a
    n, unit = len(b), np.int64(len(a) + 1)
    point = unit * unit
    same, other = MATCH * point + unit - 1, MISMATCH * point - 1
    first, further = OPEN * point, EXTEND * point
    if (10 * n + 20) * int(point) >= 1 << 61:
        raise ValueError(f"sequences of {len(a)} and {n} elements are too long to align")
    never = np.int64(-(1 << 62))
    slope = further * np.arange(n + 1, dtype=np.int64)
    best = np.concatenate(([np.int64(0)], first + slope[:-1])) if n else np.zeros(1, np.int64)
    down = np.full(n + 1, never)
    for x in a:
        down = np.maximum(best + first, down + further)
        over = np.full(n + 1, never)
        over[1:] = best[:-1] + np.where(b == x, same, other)
        open_here = np.maximum(over, down)
        along = np.full(n + 1, never)
        if n:
            along[1:] = np.maximum.accumulate(open_here[:-1] - slope[:-1]) + slope[:-1] + first
        best = np.maximum(open_here, along)
    total = int(best[-1])
    # total = score * unit^2 + matches * unit - pairs, pairs and matches below unit.
    pairs = -total % int(unit)
    rest = (total + pairs) // int(unit)
    return rest // int(unit), rest % int(unit), pairs


def identity_over_alignment(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with score, matches, aligned, identity and coverage, of the sequences in array columns a and b (of longs), which are left out.

    identity is the share of equal ones among aligned pairs, coverage how much of a's
    sequence is aligned; both are 0 where a sequence is null or empty. Rows
    are aligned where they lie, a batch at a time.
    """
    keys = [c for c in pairs.columns if c not in (a, b)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(len(keys)), batch.column(len(keys) + 1), strict=True):
                x, y = (np.array(s.as_py() or [], np.int64) for s in (x, y))
                score, matches, aligned = align(x, y) if len(x) and len(y) else (0, 0, 0)
                rows.append((score / 10, matches, aligned, matches / aligned if aligned else 0.0, aligned / len(x) if len(x) else 0.0))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], [*keys, "score", "matches", "aligned", "identity", "coverage"])

    schema = ", ".join([*fields, "score double, matches long, aligned long, identity double, coverage double"])
    return pairs.select(*keys, a, b).mapInArrow(run, schema)


def word_sequence(text: Column) -> Column:
    """The hashes of a text's lower-case words, in order."""
    return F.transform(F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
