"""Exact nearest-neighbour search that visits only the cells whose bounds can still hold a better row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.rank import top_per_group
from tallywright.operators.similar import cosine_matrix, tanimoto_matrix
from tallywright.sources.files import forget, keep

#: Rows of a side that one task compares with as many of the other.
BLOCK = 2048
#: Queries that are compared or bounded in one step, and visits that leave a worker at once, so that its memory follows neither cells nor queries.
STEP, SENT = 256, 1 << 14
#: Cells have a pivot each, at most so many, and rings of distance from it.
PIVOTS, RINGS = 512, 8
#: How many times the rows of the round before a query may visit in the next.
GROWTH = 8
#: Similarities are rounded to 6 places; a bound has to stay below by more than that.
SLACK = 2e-6


@dataclass(frozen=True)
class Measure:
    """A similarity, a metric that goes with it, and the most similarity that a gap in the metric allows."""

    similarity: Callable
    distance: Callable
    at_gap: Callable
    #: The size of each vector, where sizes bound the similarity as their ratio does.
    size: Callable | None = None


def _jaccard_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = 1 - tanimoto_matrix(a, b)
    d[np.ix_((a == 0).all(axis=1), (b == 0).all(axis=1))] = 0
    return d


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Zero vectors stand at a right angle to everything."""
    return np.arccos(np.clip(cosine_matrix(a, b), -1, 1))


def _bits(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a, np.int64).view(np.uint64)).sum(axis=1).astype(np.float64)


TANIMOTO = Measure(tanimoto_matrix, _jaccard_distance, lambda gap: 1 - gap, _bits)
COSINE = Measure(cosine_matrix, _angle, np.cos)


@dataclass
class Index:
    """Rows dealt in cells: table has (cell, block, rows), and of each cell the arrays have its pivot, distances from it, sizes, rows and blocks."""

    measure: Measure
    table: DataFrame | None
    pivots: np.ndarray
    cells: dict[str, np.ndarray] = field(default_factory=dict)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """The most similarity that any row of each cell can have to each vector."""
        c = self.cells
        d = self.measure.distance(vectors, self.pivots)[:, c["pivot"]]
        most = self.measure.at_gap(np.maximum(np.maximum(d - c["far"], c["near"] - d), 0))
        if self.measure.size:
            own = self.measure.size(vectors)[:, None]
            inside = np.clip(own, c["least"], c["most"])
            with np.errstate(invalid="ignore", divide="ignore"):
                ratio = np.where(np.maximum(own, inside) > 0, np.minimum(own, inside) / np.maximum(own, inside), 0.0)
            most = np.minimum(most, ratio)
        return most


def _valid(df: DataFrame) -> DataFrame:
    return df.where("id is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull())).where(F.size("vector") > 0)


def _matrix(values: pa.ListArray) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def build(rows: DataFrame, measure: Measure, block: int = BLOCK, pivots: int = PIVOTS) -> Index:
    """The index of rows (id, label, vector); rows with a null id or vector, or null in a vector, are left out; all vectors have one length.

    Pivots are drawn by a hash of the id, about one for each block of rows and at
    most `pivots`; each row goes to the nearest one's cell, cells are cut in rings at
    approximate quantiles of the distance, and rings are dealt in blocks.
    Pivots and the cells' bounds are bounded by pivots * RINGS whatever the table's
    size, so every task can have them.
    """
    rows = _valid(rows).select("id", "label", "vector")
    n = rows.count()
    if not n:
        return Index(measure, None, np.zeros((0, 0)))
    count = min(pivots, -(-n // block))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").collect()
    at = np.array([r["vector"] for r in drawn])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            nearest, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), block):
                d = measure.distance(x[i : i + block], at)
                nearest[i : i + block] = d.argmin(axis=1)
                far[i : i + block] = d.min(axis=1)
            size = measure.size(x) if measure.size else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(far), pa.array(size)], ["id", "label", "vector", "pivot", "d", "size"])

    kind = rows.schema["vector"].dataType.simpleString()
    dealt = keep(rows.mapInArrow(assign, f"id long, label long, vector {kind}, pivot int, d double, size double"), "assigned")
    cuts = dealt.groupBy("pivot").agg(F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"), F.count("*").alias("k"))
    # A cell within a block needs no rings.
    cuts = F.broadcast(cuts.where(F.col("k") > block).select("pivot", "cuts"))
    ring = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("d"))), F.lit(0))
    dealt2 = dealt.join(cuts, "pivot", "left").withColumn("cell", (F.col("pivot") * RINGS + F.when(F.col("cuts").isNull(), 0).otherwise(ring)).cast("int"))
    stats = dealt2.groupBy("cell").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("n")).orderBy("cell").collect()
    cells = {c: np.array([r[c] for r in stats]) for c in ("cell", "near", "far", "least", "most", "n")}
    cells |= {"pivot": cells["cell"] // RINGS, "blocks": -(-cells["n"] // block)}
    of = F.broadcast(rows.sparkSession.createDataFrame([(int(c), int(b)) for c, b in zip(cells["cell"], cells["blocks"], strict=True)], "cell int, blocks int"))
    table = dealt2.join(of, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    table = keep(table.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "label", "vector")).alias("rows")), "index")
    forget(dealt)
    return Index(measure, table, at, cells)


def _visits(index: Index, queries: DataFrame, rows: int, floor: float | None) -> DataFrame:
    """(cell, q, label, vector, upto) of queries (id, label, vector, done, least): the next cells in the order of their bounds, of about so many rows, while a bound reaches `least`.

    A query's cells come in the order of their bounds, the first `done` of which
    it has been to; upto is how many it will have been to.
    """

    cells = replace(index, table=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n = cells.cells["cell"], cells.cells["n"]
        for batch in batches:
            x = _matrix(batch.column(2))
            done = batch.column(3).to_numpy(zero_copy_only=False)
            least = batch.column(4).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), STEP):
                bound = cells.bounds(x[i : i + STEP])
                order = np.argsort(-bound, axis=1, kind="stable")
                sorted_bound = np.take_along_axis(bound, order, axis=1)
                seen = np.cumsum(n[order], axis=1) - n[order]
                start = done[i : i + STEP, None]
                place = np.arange(bound.shape[1])[None]
                before = np.where(place == start, seen, -1).max(axis=1, keepdims=True)
                go = (place >= start) & (seen - before < rows) & (sorted_bound + SLACK >= least[i : i + STEP, None])
                q, k = np.nonzero(go)
                upto = go.sum(axis=1) + start[:, 0]
                for j in range(0, len(q), SENT):
                    some, at = q[j : j + SENT], k[j : j + SENT]
                    take = pa.array(some + i)
                    columns = [pa.array(names[order[some, at]].astype(np.int32)), *(batch.column(c).take(take) for c in (0, 1, 2)), pa.array(upto[some].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "q", "label", "vector", "upto"])

    kind = queries.schema["vector"].dataType.simpleString()
    least = F.coalesce("least", F.lit(-math.inf))
    least = least if floor is None else F.greatest(least, F.lit(floor))
    asked = queries.select("id", "label", "vector", "done", least.cast("double").alias("least"))
    return asked.mapInArrow(run, f"cell int, q long, label long, vector {kind}, upto int")


def _compared(index: Index, visits: DataFrame, summarise: Callable, schema: str, block: int) -> DataFrame:
    """What summarise makes of the similarities of each cell's blocks with the queries that visit it, in blocks."""
    spark = visits.sparkSession
    sizes = F.broadcast(visits.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("lots")))
    blocks = [(int(c), int(b)) for c, b in zip(index.cells["cell"], index.cells["blocks"], strict=True)]
    blocks = F.broadcast(spark.createDataFrame(blocks, "cell int, blocks int"))
    lots = visits.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("q"), F.col("lots")).alias("lot"))
    asked = lots.agg(F.collect_list(F.struct(F.col("q").alias("id"), "label", "vector")).alias("queries")).join(blocks, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "queries")

    similarity = index.measure.similarity

    def opened(part: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = part.field("id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return ids[order], part.field("label").cast(pa.float64()).to_numpy(zero_copy_only=False)[order], _matrix(part.field("vector"))[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, r in zip(batch.column(0), batch.column(1), strict=True):
                (qi, ql, qv), (ri, rl, rv) = opened(q.values), opened(r.values)
                for i in range(0, len(qi), STEP):
                    some = slice(i, i + STEP)
                    s = np.round(similarity(qv[some], rv), 6)
                    s[qi[some, None] == ri[None]] = np.nan
                    yield pa.RecordBatch.from_pydict(summarise(qi[some], ql[some], ri, rl, s))

    return index.table.join(asked, ["cell", "block"]).select("queries", "rows").mapInArrow(run, schema)


def nearest(index: Index, queries: DataFrame, k: int, may: Callable | None = None, block: int = BLOCK, tally: list | None = None) -> DataFrame:
    """(q, vec_id, similarity, rank): of each of the queries (id, label, vector) the k most similar rows, ties to the smaller id, itself left out.

    may(query labels, labels, similarities) tells which pairs count at all;
    labels are doubles with NaN for null. A query goes to its cells in the order
    of their bounds, a block's rows in the first round and GROWTH times as many
    in each that follows, until no bound that is left reaches its k-th best;
    only the cells that it goes to get a copy of it. Rounds grow with the logarithm of
    the rows. tally, a list, gets the pairs compared in each round.
    """
    spark = queries.sparkSession
    out = "q long, vec_id long, similarity double"
    if index.table is None:
        return spark.createDataFrame([], out + ", rank long")

    def summarise(qi, ql, ri, rl, s) -> dict:
        if may is not None:
            s = np.where(may(ql[:, None], rl[None], s), s, np.nan)
        order = np.argsort(-np.where(np.isnan(s), -np.inf, s), axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(s, order, axis=1)
        known = ~np.isnan(top)
        return {"q": np.repeat(qi, known.sum(axis=1)), "vec_id": ri[order][known], "similarity": top[known]}

    asked = _valid(queries).select("id", "label", "vector")
    state = asked.select("*", F.lit(0).alias("done"), F.lit(None).cast("double").alias("least"))
    best, rows = None, block
    while True:
        visits = keep(_visits(index, state, rows, None), "visits")
        if tally is not None:
            n = dict(zip(index.cells["cell"].tolist(), index.cells["n"].tolist(), strict=True))
            tally.append(sum(n[r["cell"]] * r["count"] for r in visits.groupBy("cell").count().collect()))
        if visits.isEmpty():
            forget(visits)
            break
        found = _compared(index, visits, summarise, out, block)
        found = found if best is None else found.unionByName(best.select("q", "vec_id", "similarity"))
        before, best = best, keep(top_per_group(found, ["q"], [F.desc("similarity"), "vec_id"], k), "best")
        went = visits.groupBy(F.col("q").alias("id")).agg(F.max("upto").alias("done"))
        least = best.groupBy(F.col("q").alias("id")).agg(F.when(F.count("*") == k, F.min("similarity")).alias("least"))
        # Who went nowhere has no cell left that could hold a better row.
        again = keep(asked.join(went, "id").join(least, "id", "left").select("id", "label", "vector", "done", "least"), "queries")
        forget(visits, before, None if rows == block else state)
        state, rows = again, rows * GROWTH
    forget(state)
    return best if best is not None else spark.createDataFrame([], out + ", rank long")


def count_within(index: Index, queries: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(q, n, n_unlike): how many other rows have at least the threshold's similarity to each query, and how many of them another label; queries without any are left out.

    Only cells whose bound reaches the threshold are visited.
    """
    spark, schema = queries.sparkSession, "q long, n long, n_unlike long"
    if index.table is None:
        return spark.createDataFrame([], schema)

    def summarise(qi, ql, ri, rl, s) -> dict:
        near = s >= threshold
        unlike = near & (ql[:, None] != rl[None]) & ~np.isnan(ql[:, None] + rl[None])
        return {"q": qi, "n": near.sum(axis=1), "n_unlike": unlike.sum(axis=1)}

    state = _valid(queries).select("id", "label", "vector", F.lit(0).alias("done"), F.lit(None).cast("double").alias("least"))
    visits = _visits(index, state, np.iinfo(np.int64).max, threshold)
    return _compared(index, keep(visits, "visits"), summarise, schema, block).groupBy("q").agg(F.sum("n").alias("n"), F.sum("n_unlike").alias("n_unlike")).where("n > 0")


def nearest_forms(index: Index, forms: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(q, vec_id, similarity, rank): of queries in several forms (id, form, label, vector) the k rows of the highest similarity to any form, ties to the smaller id, itself left out.

    A row among the first k of the query is among the first k of the form that
    it is nearest to, so each form is searched alone and the maxima are merged.
    """
    named = keep(forms.select(F.xxhash64("id", "form").alias("__form"), F.col("id").alias("__q"), "label", "vector").where("__q is not null"), "forms")
    found = nearest(index, named.select(F.col("__form").alias("id"), "label", "vector"), k + 1, block=block).select(F.col("q").alias("__form"), "vec_id", "similarity")
    best = found.join(named.select("__form", "__q").distinct(), "__form").where("vec_id <> __q").groupBy(F.col("__q").alias("q"), "vec_id").agg(F.max("similarity").alias("similarity"))
    return top_per_group(best, ["q"], [F.desc("similarity"), "vec_id"], k)
