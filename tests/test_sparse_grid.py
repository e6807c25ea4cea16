"""Nearest occupied cells against all pairs, with a record at (0, 0)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vigila.operators import sparse_grid as S
from vigila.operators import spatial as SP


def brute(cells, k):
    out = []
    for a in cells:
        near = sorted((math.hypot(a["ix"] - c["ix"], a["iy"] - c["iy"]), -c["n"], c["cell_id"]) for c in cells)
        out += [(a["cell_id"], i + 1, c) for i, (_, _, c) in enumerate(near[:k])]
    return sorted(out)


def points(spark, seed=1, n=250):
    rnd = random.Random(seed)
    rows = [(8_570_000.0 + rnd.gauss(0, 4000), 3_310_000.0 + rnd.gauss(0, 4000)) for _ in range(n)]
    rows += [(8_600_000.0 + 700 * i, 3_310_000.0) for i in range(4)] + [(0.0, 0.0)]  # a lone row of cells, an outlier
    return spark.createDataFrame(rows, "x double, y double")


@pytest.mark.parametrize("k", [1, 8])
def test_same_as_all_pairs(spark, k):
    pts = points(spark)
    cells = S.occupied_cells(pts, SP.grid_spec(pts, 500.0)).cache()
    rows = [r.asDict() for r in cells.collect()]
    assert sum(r["n"] for r in rows) == pts.count() and len(rows) <= pts.count()
    got = sorted((r["anchor_id"], r["rank"], r["cell_id"]) for r in S.nearest_occupied(cells, k).collect())
    assert got == brute(rows, k)


def test_fewer_cells_than_asked_and_empty(spark):
    pts = points(spark).limit(3)
    cells = S.occupied_cells(pts, SP.grid_spec(pts, 500.0))
    n = cells.count()
    assert S.nearest_occupied(cells, 8).count() == n * n
    assert S.nearest_occupied(cells.limit(0), 8).count() == 0


def test_given_anchors(spark):
    pts = points(spark, 2)
    cells = S.occupied_cells(pts, SP.grid_spec(pts, 500.0)).cache()
    lone = cells.orderBy("ix").limit(1)
    got = S.nearest_occupied(cells, 5, anchors=lone).orderBy("rank").collect()
    rows = [r.asDict() for r in cells.collect()]
    anchor = got[0]["anchor_id"]
    assert [r["cell_id"] for r in got] == [c for a, _, c in brute(rows, 5) if a == anchor]
