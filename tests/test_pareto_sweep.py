"""The sweep of Pareto counts and fronts against plain versions and against pairs of blocks."""

import math

import numpy as np
import pytest

from tallywright.operators import pareto
from tallywright.shipping import ship


@pytest.mark.parametrize(("cells", "sweep"), [(1 << 17, 1 << 18), (1 << 17, 90), (0, 90)])
def test_sweeps_and_pairs_agree(spark, monkeypatch, cells, sweep):
    ship(spark)
    monkeypatch.setattr(pareto, "CELLS", cells)
    monkeypatch.setattr(pareto, "SWEEP", sweep)
    monkeypatch.setattr(pareto, "STEP", 16)
    rng = np.random.default_rng(5)
    pick = lambda n: int(rng.integers(0, n))
    rows = [(i, "hot" if i % 4 else None if i == 8 else "small", pick(3), float(pick(60)) if i % 50 else math.nan, math.nan if pick(9) == 0 else float(pick(4)), None if i == 5 else pick(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, u int, v double, w double, x long").repartition(3)
    high = {r[0]: tuple(math.inf if isinstance(c, float) and math.isnan(c) else c for c in r[2:]) for r in rows}
    beats = lambda a, b: None not in a and None not in b and a[1] == b[1] and high[a[0]] != high[b[0]] and all(x >= y for x, y in zip(high[a[0]], high[b[0]]))
    above = {r[0]: [o[0] for o in rows if beats(o, r)] for r in rows}
    front = {}
    for r in sorted(rows, key=lambda r: len(above[r[0]])):  # what dominates a row has fewer above it
        front[r[0]] = None if None in r else 1 + max((front[o] for o in above[r[0]]), default=0)
    below = {i: 0 for i in above}
    for some in above.values():
        for o in some:
            below[o] += 1
    got = pareto.dominance_counts(df, "g", ["u", "v", "w", "x"]).collect()
    assert {r["id"]: (r["n_dominating"], r["n_dominated"]) for r in got} == {i: (len(above[i]), below[i]) for i in above}
    assert {r["id"]: r["front"] for r in pareto.pareto_fronts(df, "g", ["u", "v", "w", "x"]).collect()} == front
    points = df.na.drop().select("g", "u", "v", "w", "x")
    assert (pareto.Grid.of(points, ["u", "v", "w", "x"]) is None) == (cells == 0)
