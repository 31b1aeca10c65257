"""Vectors as codes: each part of a vector by its nearest codebook entry, found under segment-mean lower bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm._store import materialize, small_side
from tallywright.llm._words import give_back

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that one step of a task assigns at once.
STEP = 1024
#: Lower bounds are floats; they give way by this share of the norms they come from, so none exceeds a distance.
SLACK = 1e-9


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, in double precision; null where a component is null, not finite, or beyond the long integers."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    inside = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < float(1 << 62), F.lit(False)))
    return F.when(inside, scaled.cast("array<long>"))


def usable(vector: Column) -> Column:
    """Whether a vector is there with components that are all finite numbers."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _largest(width: int) -> int:
    """The largest component's size whose squared distances, summed over a vector, stay within 62 bits."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


@dataclass(frozen=True)
class Level:
    """A part's entries as means of blocks: sums of each block, and norms of what the means leave of each block."""

    block: int
    sums: np.ndarray
    rest: np.ndarray


def _level(x: np.ndarray, block: int) -> Level:
    cut = x.reshape(len(x), -1, block).astype(np.float64)
    sums = cut.sum(axis=2)
    rest = np.sqrt(np.maximum((cut * cut).sum(axis=2) - sums * sums / block, 0))
    return Level(block, sums, rest)


def _blocks(width: int) -> list[int]:
    """Block lengths from the whole part down, halved while they divide it and have two components."""
    out = [width]
    while out[-1] % 2 == 0 and out[-1] > 2:
        out.append(out[-1] // 2)
    return out


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the nearest of the entries (squared distance, ties to the lower index), that distance, and how many exact distances it took.

    A distance is at least the sum over blocks of length * (difference of
    means)^2 + (difference of the residuals' norms)^2. Whole parts come first,
    then halves, on to pairs; at each level the bounds drop entries that cannot
    reach the distance of the row's most promising entry, and only what is left
    at the end has its exact integer distance taken. All integers fit 64 bits
    for components within _largest().
    """
    n, width = x.shape
    norms = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + (entries.astype(np.float64) ** 2).sum(axis=1)[None]
    levels = [(_level(x, b), _level(entries, b)) for b in _blocks(width)]
    at, e = levels[0]
    low = (at.sums - e.sums.T) ** 2 / width + (at.rest - e.rest.T) ** 2
    slack = SLACK * norms + 1e-6
    limit = ((x - entries[low.argmin(axis=1)]) ** 2).sum(axis=1)
    taken = n
    rows, cols = np.nonzero(low - slack <= limit[:, None])
    for at, e in levels[1:]:
        d, r = at.sums[rows] - e.sums[cols], at.rest[rows] - e.rest[cols]
        low = (d * d).sum(axis=1) / at.block + (r * r).sum(axis=1)
        # The most promising entry by the finer bounds may be nearer than the one before.
        order = np.lexsort((low, rows))
        first = order[np.searchsorted(rows, np.arange(n))]
        limit = np.minimum(limit, ((x - entries[cols[first]]) ** 2).sum(axis=1))
        taken += n
        stay = low - slack[rows, cols] <= limit[rows]
        rows, cols = rows[stay], cols[stay]
    exact = ((x[rows] - entries[cols]) ** 2).sum(axis=1)
    taken += len(rows)
    # Rows are in order and each has one entry at least; in a row the first of the least distances is the lowest index.
    start = np.searchsorted(rows, np.arange(n))
    best = np.minimum.reduceat(exact, start)
    hit = np.flatnonzero(exact == best[rows])
    _, where = np.unique(rows[hit], return_index=True)
    return cols[hit[where]], best, taken


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch in steps, with the place of the first."""
    values = batch.column(batch.schema.get_field_index("ints"))
    for first in range(0, batch.num_rows, STEP):
        part = values.slice(first, STEP)
        yield first, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums) over all vectors: a task sends one row for each entry that it used."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        over: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, x in _matrices(batch, parts * size):
                for p in range(parts):
                    piece = x[:, p * size : (p + 1) * size]
                    code, _, _ = nearest_entries(piece, books[p])
                    np.add.at(sums[p], code, piece)
                    n[p] += np.bincount(code, minlength=entries)
                if abs(sums).max(initial=0) > 1 << 61:
                    over.append((sums, n))
                    sums, n = np.zeros_like(sums), np.zeros_like(n)
        for s, k in [*over, (sums, n)]:
            p, e = np.nonzero(k)
            yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": k[p, e], "sums": s[p, e].tolist()})
        give_back()

    got = rows.select("ints").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)])


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width / parts) of rows (vec_id, ints).

    They start as the parts of the vectors of the smallest vec_ids (equal ids by
    components, null ids last), so there are fewer entries than asked for if
    there are fewer vectors. Each round is one pass over the vectors whose tasks
    send at most parts * entries sums; those of all tasks are added by Spark, and
    parts * entries rows reach the driver, whatever the table's size.
    """
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(seeds) else 0):
        for r in _sums(rows, books).collect():
            books[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width // parts)]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, ints) as (vec_id, label, code, error): the nearest entries' indexes, two hex digits a part, and their squared distances' sum."""
    parts, entries, size = books.shape
    digits = np.array([f"{i:02x}" for i in range(max(entries, 1))])
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _matrices(batch, parts * size):
                codes, error = [], np.zeros(len(x), np.int64)
                for p in range(parts):
                    code, far, _ = nearest_entries(x[:, p * size : (p + 1) * size], books[p])
                    codes.append(digits[code])
                    error += far
                kept = [batch.column(i).slice(first, len(x)) for i in (0, 1)]
                text = pa.array(["".join(c) for c in zip(*codes, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*kept, text, pa.array(error)], ["vec_id", "label", "code", "error"])
        give_back()

    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, comma-joined, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    """codes with the vectors that their codes stand for (array<double>), at most the error's root away from the integers."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in part]) for part in books])
    pick = lambda p: F.get(F.get(table, p), F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), pick))
    return codes.withColumn(out, F.transform(whole, lambda v: (v + 0.5) / SCALE))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Of vectors (vec_id, embedding, label), the rows (vec_id, label, code, error, label_error), and the codebooks.

    Components become floor(256 x). Rows whose vector is null or has a null or
    non-finite component are dropped. Vectors are cut in `parts` equal parts, so
    all have one length: the most frequent one that `parts` divides (then the
    smallest). Rows of other lengths, and of components so large that squared
    distances could leave 62 bits, can't be coded: they are returned with a null
    code and error, and take no part in the codebooks. label_error is the sum of
    errors over rows of one label, null labels together; it is null where it
    exceeds a long. Repeated rows and ids count each for itself, an empty table
    gives no rows and empty codebooks, and other columns are ignored.

    What grows with the table is read `rounds` + 1 times as integers written once
    to the shared folder. Codebooks are parts * entries * (length / parts) numbers.
    """
    raw = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("__v")).where(usable(F.col("__v")))
    ints = materialize(raw.select("vec_id", "label", integers(F.col("__v")).alias("ints")), "integers")
    lengths = ints.where((F.size("ints") > 0) & (F.size("ints") % parts == 0)).groupBy(F.size("ints").alias("k")).count()
    found = lengths.orderBy(F.desc("count"), "k").first()
    width = found["k"] if found else parts
    good = (F.size("ints") == width) & F.forall("ints", lambda v: F.abs(v) <= _largest(width))
    good = F.coalesce(good, F.lit(False))
    rows = ints.where(good)
    books = fit(rows, width, parts, entries, rounds)
    coded = encode(rows, books) if books.size else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    odd = ints.where(~good).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialize(coded.unionByName(odd), "codes")
    sums = materialize(coded.groupBy(F.col("label").alias("__label")).agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error")), "label_errors")
    out = coded.join(small_side(sums), coded["label"].eqNullSafe(sums["__label"]), "left")
    return out.select("vec_id", "label", "code", "error", "label_error"), books
