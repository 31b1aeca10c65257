"""How many points dominate each point, how many it dominates, and the fronts that peeling gives."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.files import forget, keep

#: About how many different points of a group are compared with as many others at once.
BLOCK = 2048
#: Rows of a block that are compared in one step.
STEP = 256
#: Cells that the values of all objectives but one may span for a sweep.
CELLS = 1 << 17
#: About how many different points of a group one task sweeps, and in how many ranges at most a group is cut.
SWEEP, RANGES = 1 << 18, 256


def dominance_counts(df: DataFrame, by: str, objectives: list[str]) -> DataFrame:
    """df with n_dominating and n_dominated: the rows of the same group that are at least as high in all objectives and higher in one, and the reverse.

    Equal rows are counted first. The different points of a group are dealt in
    blocks by their hashes; each pair of blocks is compared once, as a group of
    its own, and gives counts to both sides. Rows with a null in the group or in
    an objective neither dominate nor are dominated.

    Where all objectives but one have few values together (CELLS), a sweep down
    that one takes the place of pairs: points are added up in a grid of the others' values
    as they pass, so the work grows with the points and not with their pairs.
    """
    point = [by, *objectives]
    known = reduce(and_, [F.col(c).isNotNull() for c in point])
    points = df.where(known).groupBy(*point).agg(F.count("*").alias("__n"))
    if grid := Grid.of(points, objectives):
        return _joined(df, _swept_counts(keep(points, "points"), by, grid), point, ("n_dominating", "n_dominated"))
    blocks = points.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    dealt = points.join(blocks, by).withColumn("__at", F.pmod(F.xxhash64(*objectives), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    pairs = dealt.withColumn("__other", other).withColumns({"__i": F.least("__at", "__other"), "__j": F.greatest("__at", "__other")})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*point).schema), "__above long", "__below long"])

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        return _compared(pair, point, objectives)

    found = pairs.groupBy(by, "__i", "__j").applyInPandas(compare, schema)
    # Points have no nulls; pandas gives back what is not a number as one.
    nan = {f.name: F.coalesce(f.name, F.lit(math.nan).cast(f.dataType)) for f in points.select(*point).schema if f.dataType.typeName() in ("double", "float")}
    found = found.withColumns(nan) if nan else found
    found = found.groupBy(*point).agg(F.sum("__above").alias("n_dominating"), F.sum("__below").alias("n_dominated"))
    return _joined(df, found, point, ("n_dominating", "n_dominated"))


def _joined(df: DataFrame, found: DataFrame, point: list[str], counts: tuple[str, ...]) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return df.join(found, point, "left").select(*df.columns, *map(zero, counts))


@dataclass
class Grid:
    """One objective to sweep down, and the others' values in order, whose combinations are the cells."""

    sweep: str
    values: dict[str, np.ndarray]

    @staticmethod
    def of(points: DataFrame, objectives: list[str]) -> Grid | None:
        """None without points, or if the objective with the most values leaves the others more than CELLS combinations."""
        n = points.agg(*[F.approx_count_distinct(c).alias(c) for c in objectives]).first().asDict()
        sweep = max(objectives, key=lambda c: n[c])
        others = [c for c in objectives if c != sweep]
        if not n[sweep] or not others or math.prod(n[c] for c in others) > CELLS:
            return None
        sets = points.agg(F.lit(0), *[F.collect_set(c).alias(c) for c in others]).first()
        return Grid(sweep, {c: np.unique(np.array(sets[c])) for c in others})

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(v) for v in self.values.values())

    def places(self, rows: pd.DataFrame) -> np.ndarray:
        """Each row's place in the values of each objective but the swept one."""
        return np.array([np.searchsorted(v, rows[c].to_numpy()) for c, v in self.values.items()], np.int64).reshape(len(self.values), len(rows))

    def order(self, rows: pd.DataFrame, x: np.ndarray) -> np.ndarray:
        """From the highest of the swept objective down, then by the sums of the others' places, so whatever dominates a point comes before it."""
        s = np.unique(rows[self.sweep].to_numpy(), return_inverse=True)[1]
        return np.lexsort((-x.sum(axis=0), -s))

    def dealt(self, points: DataFrame, by: str) -> DataFrame:
        """points with __range: ranges of the swept objective, 0 the highest, of about SWEEP points; equal values are in one."""
        cuts = points.groupBy(by).agg(F.percentile_approx(self.sweep, [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"), F.ceil(F.count("*") / SWEEP).alias("__ranges"))
        at = F.size(F.filter("__cuts", lambda c: c >= F.col(self.sweep)))
        place = F.when(F.col("__ranges") > 1, F.floor((F.size("__cuts") - at) * F.least("__ranges", F.lit(RANGES)) / RANGES)).otherwise(0)
        # Quantiles count from the lowest; ranges from the highest.
        return points.join(cuts, by).withColumn("__range", (F.least("__ranges", F.lit(RANGES)) - 1 - place).cast("int")).drop("__cuts", "__ranges")


def _not_null(points: DataFrame, names: list[str]) -> dict:
    """Points have no nulls; pandas gives back what is not a number as one."""
    return {f.name: F.coalesce(f.name, F.lit(math.nan).cast(f.dataType)) for f in points.select(*names).schema if f.dataType.typeName() in ("double", "float")}


def _runs(n: int) -> Iterator[slice]:
    for i in range(0, n, STEP):
        yield slice(i, i + STEP)


def _pairs_within(x: np.ndarray) -> np.ndarray:
    """Of a run in the order of the sweep, whether the column's point dominates the row's."""
    return np.tril((x[:, None, :] >= x[:, :, None]).all(axis=0), -1)


def _accumulated(cells: np.ndarray, add: np.ufunc) -> np.ndarray:
    for axis in range(cells.ndim):
        cells = add.accumulate(cells, axis=axis)
    return cells


def _counted(x: np.ndarray, n: np.ndarray, shape: tuple[int, ...], before: np.ndarray) -> np.ndarray:
    """Of each point, in the order of a sweep, the rows that passed before it, those of `before` too, in places as high or higher."""
    size = math.prod(shape)
    cell = np.ravel_multi_index(tuple(k - 1 - v for k, v in zip(shape, x, strict=True)), shape) if shape else np.zeros(len(n), np.int64)
    seen, out = _accumulated(before.reshape(shape), np.add).ravel(), np.zeros(len(n), np.int64)
    for run in _runs(len(n)):
        out[run] = seen[cell[run]] + _pairs_within(x[:, run]) @ n[run]
        passed = np.bincount(cell[run], n[run], size).astype(np.int64).reshape(shape)
        seen = seen + _accumulated(passed, np.add).ravel()
    return out


def _swept_counts(points: DataFrame, by: str, grid: Grid) -> DataFrame:
    others = list(grid.values)
    names = [by, grid.sweep, *others]
    rows = keep(grid.dealt(points, by), "swept")
    # Of each range the rows of a cell in the ranges above and below it; groups of one range have none.
    cells = keep(rows.groupBy(by, "__range", *others).agg(F.sum("__n").alias("__n")), "cells")
    ranges = cells.select(by, "__range").distinct()
    dense = cells.select(by, *others).distinct().join(ranges, by).join(cells, [by, "__range", *others], "left").fillna(0, ["__n"])
    cell = Window.partitionBy(by, *others)
    above = F.coalesce(F.sum("__n").over(cell.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outside = dense.withColumns({"__above": above, "__below": F.sum("__n").over(cell) - above - F.col("__n")}).where("__above + __below > 0")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "n_dominating long, n_dominated long"])

    def sweep(part: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        x, shape = grid.places(part), grid.shape
        order, far = grid.order(part, x), grid.places(outside)
        n = part["__n"].to_numpy(np.int64)
        top = np.array(shape, np.int64)[:, None] - 1
        found = {}
        for out, place, at, there, held in (("n_dominating", order, x, far, "__above"), ("n_dominated", order[::-1], top - x, top - far, "__below")):
            before = np.zeros(shape, np.int64)
            np.add.at(before, tuple(top - there), outside[held].to_numpy(np.int64))
            counts = np.zeros(len(part), np.int64)
            counts[place] = _counted(at[:, place], n[place], shape, before)
            found[out] = counts
        return part[names].assign(**found)

    found = rows.groupBy(by, "__range").cogroup(outside.groupBy(by, "__range")).applyInPandas(sweep, schema)
    return found.withColumns(nan) if (nan := _not_null(points, names)) else found


def _swept_fronts(points: DataFrame, by: str, grid: Grid) -> DataFrame:
    """The fronts of points, range after range from the highest; from one to the next goes the highest front of each cell."""
    others = list(grid.values)
    names = [by, grid.sweep, *others]
    rows = keep(grid.dealt(points, by).sortWithinPartitions("__range"), "swept")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "front int"])

    def sweep(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return part.reindex(columns=names).assign(front=np.zeros(0, np.int32))
        x, shape = grid.places(part), grid.shape
        order, top = grid.order(part, x), np.array(shape, np.int64)[:, None] - 1
        x, best = x[:, order], np.zeros(shape, np.int32)
        np.maximum.at(best, tuple(top - grid.places(held)), held["front"].to_numpy(np.int32))
        best = _accumulated(best, np.maximum).ravel()
        cell = np.ravel_multi_index(tuple(top - x), shape) if shape else np.zeros(len(part), np.int64)
        fronts = np.zeros(len(part), np.int32)
        for run in _runs(len(part)):
            above, out = _pairs_within(x[:, run]), best[cell[run]] + 1
            for i in range(1, len(out)):
                out[i] = max(out[i], (out[:i] * above[i, :i]).max() + 1)
            passed = np.zeros(len(best), np.int32)
            np.maximum.at(passed, cell[run], out)
            best = np.maximum(best, _accumulated(passed.reshape(shape), np.maximum).ravel())
            fronts[order[run]] = out
        return part[names].assign(front=fronts)

    nan = _not_null(points, names)
    held, settled = points.where("false").select(by, *others, F.lit(0).alias("front")), []
    for step in range(rows.agg(F.max("__range")).first()[0] + 1):
        part = rows.where(F.col("__range") == step).groupBy(by).cogroup(held.groupBy(by)).applyInPandas(sweep, schema)
        settled.append(keep(part.withColumns(nan) if nan else part, "fronts"))
        held = keep(held.unionByName(settled[-1].select(by, *others, "front")).groupBy(by, *others).agg(F.max("front").alias("front")), "held")
    return reduce(DataFrame.unionByName, settled)


def pareto_fronts(df: DataFrame, by: str, objectives: list[str]) -> DataFrame:
    """df with front: 1 for rows of a group that no other dominates, 2 for those left undominated without them, and so on; null for rows with nulls alone.

    A point's front is one more than the highest front of what dominates it.
    Only different points count. Those of a group are dealt in blocks, whose
    own fronts are one pass; a group of one block is done by that. In others a
    point's front within its block is a lower bound, and those with the lowest bounds
    settle the next fronts: as many as one task can hold settle all their
    fronts at once; where the lowest bound alone has more, it is cut to the skylines of its
    blocks, and these are held against each other. What is left, with its bounds, is
    written to the shared folder after each step, and only that is read by the next; there is no
    bound on fronts. Where all objectives but one have few values together (CELLS), one sweep down
    that one gives all fronts, as in dominance_counts.
    """
    spark, point = df.sparkSession, [by, *objectives]
    known = reduce(and_, [F.col(c).isNotNull() for c in point])
    points = df.select(*point).where(known).distinct()
    if grid := Grid.of(points, objectives):
        return df.join(_swept_fronts(keep(points, "points"), by, grid), point, "left").select(*df.columns, "front")
    names = [f"{x.name}" for x in points.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    nan = {f.name: F.coalesce(f.name, F.lit(math.nan).cast(f.dataType)) for f in points.schema if f.dataType.typeName() in ("double", "float")}
    back = lambda t: t.withColumns(nan) if nan else t  # noqa: E731  pandas gives back what is not a number as null

    def settle(block: pd.DataFrame) -> pd.DataFrame:
        return block[names].assign(__bound=_bounds(block, objectives))

    def dealt(t: DataFrame, seed: int) -> DataFrame:
        sizes = t.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
        return t.join(sizes, by).withColumn("__at", F.pmod(F.xxhash64(F.lit(seed), *objectives), F.col("__blocks")).cast("int"))

    first = dealt(points, 0).withColumn("__bound", F.lit(1))
    sizes = first.select(by, "__blocks").distinct()
    left = back(first.groupBy(by, "__at").applyInPandas(settle, schema + ", __bound int"))
    left = keep(left.join(sizes, by).select(*names, "__bound", (F.col("__blocks") == 1).alias("__done")), "fronts")
    settled, step = [left.where("__done").select(*names, F.col("__bound").alias("front"))], 1
    left = keep(left.where("not __done").drop("__done"), "fronts")
    while not left.isEmpty():
        # How far the bounds of what one task can hold reach, and the lowest bound where that alone has more.
        upward = Window.partitionBy(by).orderBy("__bound")
        reach = left.groupBy(by, "__bound").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(upward))
        reach = keep(reach.groupBy(by).agg(F.min("__bound").alias("__low"), F.max(F.when(F.col("n") <= BLOCK, F.col("__bound"))).alias("__top")), "reach")
        rows = left.join(reach, by)
        few = rows.where("__bound <= __top").groupBy(by)
        few = back(few.applyInPandas(settle, schema + ", __bound int")).join(reach, by).withColumn("__done", F.col("__bound") <= F.col("__top"))
        many = keep(rows.where("__top is null and __bound = __low").select(*names, "__bound"), "lowest")
        parts = [few.select(*names, "__bound", "__done"), rows.where("__bound > coalesce(__top, __low)").select(*names, "__bound", F.lit(False).alias("__done"))]
        if not many.isEmpty():
            own = back(dealt(many, step).groupBy(by, "__at").applyInPandas(settle, schema + ", __bound int"))
            # The skyline of a block keeps the bound; what a block's own points dominate has a higher one.
            low = reach.select(by, "__low")
            own = keep(own.join(low, by), "skylines")
            top = own.where("__bound = __low").select(*names)
            beaten = keep(_beaten(dealt(top, step), by, objectives, schema, back), "beaten")
            key = lambda t: t.select(*names, F.lit(True).alias("__beaten"))
            top = top.join(low, by).join(key(beaten), names, "left")
            parts.append(top.select(*names, (F.col("__low") + F.coalesce("__beaten", F.lit(False)).cast("int")).alias("__bound"), F.col("__beaten").isNull().alias("__done")))
            parts.append(own.where("__bound > __low").select(*names, "__bound", F.lit(False).alias("__done")))
        after = keep(reduce(DataFrame.unionByName, parts), "fronts")
        settled.append(after.where("__done").select(*names, F.col("__bound").alias("front")))
        rest = keep(after.where("not __done").drop("__done"), "fronts")
        forget(left, reach, many)
        left, step = rest, step + 1
    forget(left)
    found = reduce(DataFrame.unionByName, settled)
    return df.join(found, point, "left").select(*df.columns, "front")


def _beaten(dealt: DataFrame, by: str, objectives: list[str], schema: str, back: Callable) -> DataFrame:
    """The points that another dominates, by pairs of blocks and within blocks."""
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    pairs = dealt.withColumn("__other", other).withColumns({"__i": F.least("__at", "__other"), "__j": F.greatest("__at", "__other")})
    names = [by, *objectives]

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        x, at = _places(pair, objectives), pair["__at"].to_numpy()
        left, right = np.flatnonzero(at == pair["__i"].to_numpy()), np.flatnonzero(at == pair["__j"].to_numpy())
        lost = np.zeros(len(x), bool)
        for rows in _steps(left):
            a, b = x[rows][:, None], x[right][None]
            lost[rows] |= ((b >= a).all(axis=2) & (b > a).any(axis=2)).any(axis=1)
            lost[right] |= ((a >= b).all(axis=2) & (a > b).any(axis=2)).any(axis=0)
        return pair.loc[lost, names]

    return back(pairs.groupBy(by, "__i", "__j").applyInPandas(compare, schema)).distinct()


def _places(points: pd.DataFrame, objectives: list[str]) -> np.ndarray:
    """Places in the sorted values: not a number is the highest and equals itself, as in SQL."""
    return np.column_stack([np.unique(points[c].to_numpy(), return_inverse=True)[1] for c in objectives])


def _bounds(points: pd.DataFrame, objectives: list[str]) -> np.ndarray:
    """Of each point the larger of its bound and one more than the most that points which dominate it have."""
    x, bound = _places(points, objectives), points["__bound"].to_numpy(np.int32).copy()
    # What dominates a point comes before it in the order of the sums.
    order = np.argsort(-x.sum(axis=1), kind="stable")
    x, out = x[order], bound[order]
    for i in range(1, len(x)):
        above = out[:i][(x[:i] >= x[i]).all(axis=1) & (x[:i] > x[i]).any(axis=1)]
        if len(above):
            out[i] = max(out[i], above.max() + 1)
    bound[order] = out
    return bound


def _compared(pair: pd.DataFrame, point: list[str], objectives: list[str]) -> pd.DataFrame:
    """Counts of the points of one pair of blocks, or of one block with itself."""
    x = _places(pair, objectives)
    n, at = pair["__n"].to_numpy(np.int64), pair["__at"].to_numpy()
    left, right = np.flatnonzero(at == pair["__i"].to_numpy()), np.flatnonzero(at == pair["__j"].to_numpy())
    above, below = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    same = pair["__i"].iloc[0] == pair["__j"].iloc[0]
    for rows in _steps(left):
        a, b = x[rows][:, None], x[right][None]
        equal = (a == b).all(axis=2)
        beaten = (b >= a).all(axis=2) & ~equal
        above[rows] += beaten @ n[right]
        below[right] += n[rows] @ beaten
        if not same:
            beats = (a >= b).all(axis=2) & ~equal
            below[rows] += beats @ n[right]
            above[right] += n[rows] @ beats
    return pair[point].assign(__above=above, __below=below)


def _steps(rows: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(rows), STEP):
        yield rows[i : i + STEP]
