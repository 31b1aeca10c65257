"""Exact near duplicates of embeddings: cover trees traversed in pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm._components import connected_components
from tallywright.llm._store import materialize, small_side

COSINE = 0.93
#: Vectors of one cell that a task takes from each side; larger cells are dealt in parts.
CELL = 4096
#: Cells a label has at most (Spark cuts ranks up to 1,000 before it sorts), and numbers in pivots that are sent to all tasks at
#: most (64 MB): labels with the most vectors come first, the rest is dealt by hash.
PIVOTS, PIVOT_NUMBERS = 1000, 8_000_000
_LEAF = 16
_SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Nested levels of centers with halving radii over unit vectors.

    A node covers its points within its radius, the largest distance that
    occurs. Its children have centers among its points, its own center first,
    which lie further than the next power of two below the radius from each
    other; every point goes to the first center within that power.
    """

    def __init__(self, points: np.ndarray):
        self.x = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.points: list[np.ndarray] = []
        self.kids: list[np.ndarray | None] = []
        todo = [(self._node(np.arange(len(points))))] if len(points) else []
        while todo:
            node = todo.pop()
            own = self.points[node]
            if len(own) > _LEAF and self.radius[node] > 1e-7:
                half = 2.0 ** (math.ceil(math.log2(self.radius[node])) - 1)
                groups = self._net(own, half)
                self.kids[node] = np.array([self._node(g) for g in groups])
                todo += [int(k) for k in self.kids[node] if len(self.points[k]) > _LEAF]
        self.center_of = np.array(self.center, np.int64)
        self.radius_of = np.array(self.radius)

    def _node(self, own: np.ndarray) -> int:
        self.center.append(int(own[0]))
        self.radius.append(float(_distances(self.x[own], self.x[own[:1]]).max()) if len(own) > 1 else 0.0)
        self.points.append(own)
        self.kids.append(None)
        return len(self.center) - 1

    def _net(self, own: np.ndarray, half: float) -> list[np.ndarray]:
        """The points by the first center within `half`, centers chosen in order."""
        groups = []
        while len(own):
            head = min(256, len(own))
            near = _distances(self.x[own[:head]], self.x[own]) <= half
            chosen, covered = [], np.zeros(head, bool)
            for i in range(head):
                if not covered[i]:
                    near[i, i] = True
                    chosen.append(i)
                    covered |= near[i, :head]
            near = near[chosen]
            first = np.where(near.any(axis=0), near.argmax(axis=0), -1)
            order = np.argsort(first, kind="stable")
            cut = np.searchsorted(first[order], np.arange(len(chosen) + 1))
            groups += [own[order[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            own = own[first < 0]
        return groups


def pairs_within(a: CoverTree, b: CoverTree | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All pairs of points of cosine or more, as (points of a, points of b, every one with every other).

    Without b, pairs of different points of a, each once. Node pairs are pruned
    when their centers lie further apart than both covering radii and the
    threshold's distance allow, taken whole when the farthest points are still
    near enough, and compared point by point at the leaves.
    """
    reach = math.sqrt(2.0 - 2.0 * cosine)
    own = b is None
    b = a if own else b
    if not a.center or not b.center:
        return
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        same = own and p == q
        rp, rq = a.radius[p], b.radius[q]
        apart = 0.0 if same else float(_distances(a.x[a.center[p]][None], b.x[b.center[q]][None])[0, 0])
        if apart > rp + rq + reach + _SLACK:
            continue
        if apart + rp + rq <= reach - _SLACK:
            if not same or len(a.points[p]) > 1:
                yield a.points[p], b.points[q], True
            continue
        kp, kq = a.kids[p], b.kids[q]
        if kp is None and kq is None:
            x, y = a.points[p], b.points[q]
            i, j = np.nonzero(a.x[x] @ b.x[y].T >= cosine)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield x[i], y[j], False
            continue
        left = np.array([p]) if kp is None or (kq is not None and rq > 2 * rp) else kp
        right = np.array([q]) if kq is None or (kp is not None and rp > 2 * rq) else kq
        for k in range(0, len(left), 512):
            part = left[k : k + 512]
            bound = a.radius_of[part][:, None] + b.radius_of[right][None] + reach + _SLACK
            i, j = np.nonzero(_distances(a.x[a.center_of[part]], b.x[b.center_of[right]]) <= bound)
            if same:
                i, j = i[i + k <= j], j[i + k <= j]
            todo += zip(part[i].tolist(), right[j].tolist(), strict=True)


def links_within(a: np.ndarray, b: np.ndarray | None, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the summed weight of each one's links, those of a first, and the first vector that each reaches."""
    own = b is None
    n = len(a)
    weight = weight_a if own else np.concatenate([weight_a, weight_b])
    links, ends = np.zeros(len(weight), np.int64), []
    for x, y, whole in pairs_within(CoverTree(a), None if own else CoverTree(b), cosine):
        y = y if own else y + n
        if not whole:
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            ends.append((x, y))
        elif own and x is y:
            links[x] += weight[x].sum() - weight[x]
            ends.append((x[1:], np.full(len(x) - 1, x[0])))
        else:
            links[x] += weight[y].sum()
            links[y] += weight[x].sum()
            ends.append((x, np.full(len(x), y[0])))
            ends.append((y, np.full(len(y), x[0])))
    root = np.arange(len(weight))
    if ends:
        u, v = (np.concatenate(e) for e in zip(*ends, strict=True))
        while True:
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            root = root[root]
            if (root == before).all():
                break
    return links, root, weight


def _usable(embedding: Column) -> Column:
    """Not null, not all zeros, and no component null, NaN or infinite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine in double precision reaches the threshold; a vector
    that is null, zero or holds null or non-finite components links with
    nothing, and so does one without a vec_id or label. n_links counts other
    rows, equal ones too; component_id is the smallest vec_id reachable, and
    kept marks it (rows without vec_id are kept). Other columns are ignored.

    Equal vectors of a label become one, with a weight. The vectors of a label
    are split at the top of a cover tree: each goes to the nearest of a few
    pivots (a hash sample, one for each `cell` vectors, PIVOTS a label at most), whose
    covering radii prune pairs of cells; a cell over `cell` vectors is dealt in
    parts by hash. Each remaining pair of parts is one task's work: it builds
    both cover trees and traverses them together. Links leave a task as sums and
    as one root for each vector, so their number is that of the vectors.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    v = v.withColumns(
        {
            "usable": _usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(),
            "dim": F.size("embedding"),
            "k1": F.xxhash64("embedding"),
            "k2": F.xxhash64(F.lit("second"), "embedding"),
        }
    )
    group = ["label", "dim"]
    reps = materialize(
        v.where("usable").groupBy(*group, "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")),
        "vectors",
    )
    parts = materialize(_cells(reps, group, cell), "cells")
    # At most PIVOTS cells a label meet each other here; parts of cells come in once their cells may link.
    cells = parts.groupBy(*group, "cell").agg(F.max("far").alias("far"), F.first("pivot").alias("pivot"), (F.max("part") + 1).alias("parts"))
    cells = materialize(cells, "cell_sizes")
    one, two = cells.alias("one"), cells.alias("two")
    dot = F.aggregate(F.zip_with("one.pivot", "two.pivot", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    reach = math.sqrt(2 - 2 * cosine)
    met = one.join(two, [F.col(f"one.{g}") == F.col(f"two.{g}") for g in group]).where("one.cell <= two.cell")
    met = met.where((F.col("one.cell") == F.col("two.cell")) | (apart <= F.col("one.far") + F.col("two.far") + reach + _SLACK))
    met = met.select(*[F.col(f"one.{g}").alias(g) for g in group], F.col("one.cell").alias("c1"), F.col("two.cell").alias("c2"), "one.parts", F.col("two.parts").alias("others"))
    met = met.withColumn("p1", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("p2", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    met = met.where("c1 < c2 or p1 <= p2")
    side = lambda c, p, k: F.struct(F.col(c).alias("cell"), F.col(p).alias("part"), F.lit(k).alias("side"))
    alone = (F.col("c1") == F.col("c2")) & (F.col("p1") == F.col("p2"))
    sides = F.when(alone, F.array(side("c1", "p1", 0))).otherwise(F.array(side("c1", "p1", 0), side("c2", "p2", 1)))
    todo = met.select(*group, F.xxhash64(*group, "c1", "p1", "c2", "p2").alias("task"), F.explode(sides).alias("at")).select(*group, "task", "at.*")
    todo = materialize(todo, "tasks")
    work = parts.select(*group, "cell", "part", "rep", "weight", "embedding").join(small_side(todo), [*group, "cell", "part"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "rep"], ignore_index=True)
        x = _unit(rows["embedding"])
        n = int((rows["side"] == 0).sum())
        rep, weight = rows["rep"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64)
        links, root, _ = links_within(x[:n], x[n:] if n < len(x) else None, weight[:n], weight[n:], cosine)
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[root[some]]})

    found = materialize(
        work.select("task", "side", "rep", "weight", "embedding").groupBy("task").applyInPandas(run, "rep long, links long, root long"), "links"
    )
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = (
        reps.select(*group, "k1", "k2", "rep", "weight")
        .join(total, "rep", "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
    )
    keys = [*group, "k1", "k2"]
    out = v.select("vec_id", "usable", *keys).join(classes.withColumn("usable", F.lit(True)), ["usable", *keys], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _cells(reps: DataFrame, group: list[str], cell: int) -> DataFrame:
    """reps with cell, part, pivot (unit vector of the cell, null without one) and far, the distance to it."""
    spark = reps.sparkSession
    sizes = reps.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > cell)
    sizes = materialize(sizes.withColumn("wanted", F.least(F.ceil(F.col("n") / cell), F.lit(PIVOTS)).cast("int")), "sizes")
    # Labels by size in powers of two, so that a few sums tell which ones' pivots fit.
    power = F.ceil(F.log2("n")).cast("int")
    room, least = PIVOT_NUMBERS, 64
    for at, numbers in sizes.groupBy(power.alias("at")).agg(F.sum(F.col("wanted").cast("long") * F.col("dim"))).orderBy(F.desc("at")).collect():
        room -= numbers
        if room < 0:
            break
        least = at
    large = small_side(sizes.where(power >= least).select(*group, "wanted"))
    order = Window.partitionBy(*group).orderBy(F.xxhash64("rep", F.lit(7)), "rep")
    drawn = reps.select(*group, "rep").join(large, group).withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    drawn = drawn.where("place <= wanted").select("rep", (F.col("place") - 1).alias("cell"))
    pivots = materialize(reps.select(*group, "rep", "embedding").join(F.broadcast(drawn), "rep").select(*group, "cell", "embedding"), "pivots")
    held: dict[tuple, np.ndarray] = {}
    for key, rows in pivots.toPandas().groupby(group):
        held[key] = _unit(rows.sort_values("cell")["embedding"])
    sent = spark.sparkContext.broadcast(held)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(group, sort=False):
                at = sent.value.get(key)
                if at is None:
                    yield rows.assign(cell=0, pivot=None, far=0.0)
                    continue
                d = _distances(_unit(rows["embedding"]), at)
                near = d.argmin(axis=1)
                yield rows.assign(cell=near, pivot=[at[i] for i in near], far=d[np.arange(len(d)), near])

    schema = "label string, dim int, rep long, weight long, embedding array<double>, cell int, pivot array<double>, far double"
    placed = materialize(reps.select(*group, "rep", "weight", "embedding").mapInPandas(assign, schema), "placed")
    counts = placed.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / cell)
    return placed.join(small_side(materialize(counts, "counts")), [*group, "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("rep", F.lit(11)), parts).cast("int")
    ).drop("n")
