"""P5 / P14 on occupied cells only: output in proportion to the data, whatever its
extent.  One record at (0, 0) adds one cell, not a grid that reaches there."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import merc_lat, merc_lon
from ..session import cut_lineage
from .spatial import _spec_scalar, assign_cells

#: From one ring to the next the width grows by so much.
GROWTH = 3


def occupied_cells(points: DataFrame, spec: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """P5, the cells that hold a point: ``cell_id, ix, iy, n, cx, cy, lon, lat``."""
    s = _spec_scalar(spec)
    held = (assign_cells(points, spec, x, y).where(F.col("cell_id").isNotNull())
            .groupBy("cell_id", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"))
            .agg(F.count(F.lit(1)).alias("n")))
    out = held.withColumns({"cx": s["minx"] + F.col("ix") * s["size"] + s["size"] / 2,
                            "cy": s["miny"] + F.col("iy") * s["size"] + s["size"] / 2})
    return out.withColumns({"lon": merc_lon("cx"), "lat": merc_lat("cy")})


def nearest_occupied(cells: DataFrame, k: int = 8, prob: str = "n", cell_size: float = 500.0,
                     anchors: DataFrame | None = None) -> DataFrame:
    """P14 on any set of cells (``cell_id, ix, iy``): each anchor's ``k`` nearest by
    centroid distance, itself first, ties to higher ``prob``, then ``cell_id``; all
    cells where there are fewer than ``k``.

    The cells are laid out at several scales.  At scale R an anchor looks at the
    3 x 3 blocks of R x R cells around it, which hold all cells within R cells; it is
    done if its k-th is no farther.  The others go on at GROWTH times the scale, until
    the blocks hold everything.  Anchors among others are done at once, so that
    only lone ones look far; each sees at most the cells of 9 blocks, and rows are
    counted per anchor after every scale, never for a whole grid."""
    cells = cut_lineage(cells.select("cell_id", "ix", "iy", F.coalesce(F.col(prob).cast("double"), F.lit(0.0)).alias("prob")))
    ext = cells.agg((F.max("ix") - F.min("ix")).alias("w"), (F.max("iy") - F.min("iy")).alias("h")).first()
    reach = max(ext["w"] or 0, ext["h"] or 0)
    open_ = cut_lineage((anchors if anchors is not None else cells).select(
        F.col("cell_id").alias("anchor_id"), F.col("ix").alias("ax"), F.col("iy").alias("ay")))
    r = max(1, math.ceil(math.sqrt(k)))
    off = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    order = Window.partitionBy("anchor_id").orderBy("dist_m", F.desc("prob"), "cell_id")
    found = []
    while True:
        def block(c):
            return F.floor(F.col(c) / r).cast("long")
        look = (open_.withColumn("ox", F.explode(off)).withColumn("oy", F.explode(off))
                .withColumns({"bx": block("ax") + F.col("ox"), "by": block("ay") + F.col("oy")}).drop("ox", "oy"))
        near = (look.join(cells.withColumns({"bx": block("ix"), "by": block("iy")}), ["bx", "by"])
                .withColumn("dist_m", F.sqrt(F.pow(F.col("ax") - F.col("ix"), 2) + F.pow(F.col("ay") - F.col("iy"), 2)) * cell_size))
        best = cut_lineage(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                           .select("anchor_id", "rank", "cell_id", "dist_m", "prob"))
        if r >= reach + 1:  # the blocks around each anchor hold all cells
            found.append(best)
            break
        done = best.where((F.col("rank") == k) & (F.col("dist_m") <= float(r) * cell_size)).select("anchor_id")
        found.append(best.join(done, "anchor_id", "left_semi"))
        open_ = cut_lineage(open_.join(done, "anchor_id", "left_anti"))
        if open_.isEmpty():
            break
        r *= GROWTH
    return reduce(DataFrame.unionByName, found)
