"""Selections that weigh a row's score against its likeness to what is chosen already."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.rank import top_per_group
from tallywright.operators.similar import tanimoto_matrix
from tallywright.shipping import ship
from tallywright.sources.files import forget, keep

#: Rows of a group that one task chooses from.
SHORTLIST = 1024


def diverse(rows: DataFrame, by: str, n: int, weight: float = 0.6, shortlist: int = SHORTLIST) -> DataFrame:
    """(by, id, step, value): of each group's rows (by, id, score, vector of bits), n chosen one at a time, each the highest in score less weight * its largest Tanimoto similarity to those chosen before; ties to the smaller id.

    A row's value only falls as more are chosen, so what it was before bounds what
    it is. Each pass takes the values by what is chosen so far and keeps a shortlist of a
    group's highest, from which one task goes on choosing while its best is above the first that
    was left out; then the next pass begins. Each pass chooses one at least, and mostly all.
    Values are rounded to 9 places. Rows with null or non-finite scores, null ids or vectors are left out; null groups are none.
    """
    spark = ship(rows.sparkSession)
    rows = rows.where(F.col(by).isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    rows = keep(rows.where(~F.isnan("score") & (F.abs("score") < float("inf"))).select(F.col(by).alias("__by"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), "vector"), "rows")
    group = rows.schema["__by"].dataType.simpleString()
    kind = f"__by {group}, id long, score double, vector array<long>"

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).to_pylist()
            out = np.zeros(batch.num_rows)
            for i, (v, before) in enumerate(zip(x, batch.column(4).to_pylist(), strict=True)):
                if before:
                    out[i] = tanimoto_matrix(np.array([v], np.int64), np.array(before, np.int64)).max()
            value = np.round(batch.column(2).to_numpy() - weight * out, 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(value)], ["__by", "id", "score", "vector", "value"])

    def choose(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["value", "id"], ascending=[False, True]).reset_index(drop=True)
        # What comes behind the shortlist is no higher than its last row, which is looked at but not chosen.
        limit = (held["value"].iat[shortlist], held["id"].iat[shortlist]) if len(held) > shortlist else None
        held = held.iloc[:shortlist]
        value, ids, score = held["value"].to_numpy().copy(), held["id"].to_numpy(), held["score"].to_numpy()
        vectors = np.array(held["vector"].tolist(), np.int64)
        out, left = [], np.ones(len(held), bool)
        while left.any() and len(out) < held["left"].iat[0]:
            best = np.flatnonzero(left)[np.lexsort((ids[left], -value[left]))[0]]
            if limit and (-value[best], ids[best]) > (-limit[0], limit[1]):
                break
            out.append((held["__by"].iat[0], int(ids[best]), float(score[best]), vectors[best].tolist(), float(value[best])))
            left[best] = False
            near = np.round(score - weight * tanimoto_matrix(vectors, vectors[best : best + 1])[:, 0], 9)
            value = np.minimum(value, near)
        return pd.DataFrame(out, columns=["__by", "id", "score", "vector", "value"])

    chosen, step = None, 0
    while step < n:
        if chosen is None:
            asked = rows.withColumn("before", F.lit(None).cast("array<array<long>>")).withColumn("left", F.lit(n))
        else:
            per_group = chosen.groupBy("__by").agg(F.collect_list("vector").alias("before"), (n - F.count("*")).cast("int").alias("left"))
            asked = rows.join(per_group, "__by").where("left > 0").join(chosen.select("__by", "id"), ["__by", "id"], "left_anti")
        valued = asked.select("__by", "id", "score", "vector", "before").mapInArrow(values, f"{kind}, value double")
        short = top_per_group(valued, ["__by"], [F.desc("value"), "id"], shortlist + 1, "__place").drop("__place")
        short = short.join(asked.select("__by", "left").distinct(), "__by")
        new = short.groupBy("__by").applyInPandas(choose, f"{kind}, value double")
        made = new.groupBy("__by").agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "id", "score", "vector"))).alias("x"))
        done = made.select("__by", F.posexplode("x").alias("at", "x")) if chosen is None else made.join(chosen.groupBy("__by").agg(F.count("*").alias("had")), "__by").select("__by", F.posexplode("x").alias("at", "x"), "had")
        had = F.lit(0) if chosen is None else F.col("had")
        new = done.select("__by", "x.id", "x.score", "x.vector", (-F.col("x.v")).alias("value"), (had + F.col("at") + 1).cast("long").alias("step"))
        after = keep(new if chosen is None else chosen.unionByName(new), "chosen")
        if chosen is not None and after.count() == chosen.count():
            forget(after)
            break
        forget(chosen)
        chosen, step = after, step + 1
    if chosen is None:
        chosen = spark.createDataFrame([], f"{kind}, value double, step long")
    return chosen.select(F.col("__by").alias(by), "id", "step", "value")
