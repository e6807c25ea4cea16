"""Spatial column expressions: Web-Mercator projection, great-circle and
planar distances, points, ray-cast containment and ring centroids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii of EPSG:3857 and of the haversine formula.
MERC_R = 6378137.0
HAV_R = 6371000.0
# Metres per degree in the coarse planar "degrees x 111000" distance.
DEG_M = 111000.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def merc_x(lon) -> Column:
    """EPSG:4326 longitude -> EPSG:3857 x (metres)."""
    return F.lit(MERC_R) * F.radians(_c(lon))


def merc_y(lat) -> Column:
    """EPSG:4326 latitude -> EPSG:3857 y (metres)."""
    return F.lit(MERC_R) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2))


def merc_lon(x) -> Column:
    return F.degrees(_c(x) / F.lit(MERC_R))


def merc_lat(y) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(MERC_R))) - F.lit(math.pi / 2))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres (sphere of radius 6371 km)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = F.radians(_c(lat2) - _c(lat1))
    dl = F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(HAV_R * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def planar_m(x1, y1, x2, y2) -> Column:
    """Euclidean distance of projected coordinates."""
    return F.sqrt(F.pow(_c(x1) - _c(x2), 2) + F.pow(_c(y1) - _c(y2), 2))


def degree_dist_m(lat1, lon1, lat2, lon2) -> Column:
    """Coarse planar distance in degrees times 111 km (parity mode)."""
    return planar_m(lon1, lat1, lon2, lat2) * F.lit(DEG_M)


def point(lon, lat) -> Column:
    """Point struct, null when either coordinate is null."""
    lon, lat = _c(lon), _c(lat)
    return F.when(lon.isNotNull() & lat.isNotNull(),
                  F.struct(lon.alias("lon"), lat.alias("lat")))


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; chord length bounds great-circle distance."""
    p, l = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def ring_contains(ring, x, y) -> Column:
    """Even-odd ray cast of point (x, y) against one closed ring
    (``array<struct<x,y>>``), evaluated with the ``aggregate`` HOF."""
    ring, x, y = _c(ring), _c(x), _c(y)
    n = F.size(ring)

    def step(acc, i):
        a = F.element_at(ring, i + 1)
        b = F.element_at(ring, i + 2)
        crosses = (a["y"] > y) != (b["y"] > y)
        xcut = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(crosses & (x < xcut), ~acc).otherwise(acc)

    return F.when(n >= 4, F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(False), step)) \
        .otherwise(F.lit(False))


def on_ring(ring, x, y) -> Column:
    """True when (x, y) lies on an edge of the ring (zero cross product
    and inside the edge's bounding box)."""
    ring, x, y = _c(ring), _c(x), _c(y)
    n = F.size(ring)

    def step(acc, i):
        a = F.element_at(ring, i + 1)
        b = F.element_at(ring, i + 2)
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        inside = ((x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"]))
                  & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"])))
        return acc | ((cross == 0) & inside)

    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(False), step)).otherwise(F.lit(False))


def rings_contain(rings, x, y) -> Column:
    """Strict containment ("within"): even-odd rule over all rings of a
    polygon (outer ring plus holes), points on any edge excluded."""
    rings = _c(rings)
    flags = F.transform(rings, lambda r: ring_contains(r, x, y).cast("int"))
    inside = (F.aggregate(flags, F.lit(0), lambda a, b: a + b) % 2) == 1
    edge = F.exists(rings, lambda r: on_ring(r, x, y))
    return inside & ~edge


def ring_centroid(ring) -> Column:
    """Area centroid of a closed ring by the shoelace formula, as struct(x, y)."""
    ring = _c(ring)
    idx = F.sequence(F.lit(0), F.size(ring) - 2)

    def cross(i):
        a, b = F.element_at(ring, i + 1), F.element_at(ring, i + 2)
        return a["x"] * b["y"] - b["x"] * a["y"]

    def acc3(acc, i):
        a, b = F.element_at(ring, i + 1), F.element_at(ring, i + 2)
        c = cross(i)
        return F.struct((acc["a"] + c).alias("a"),
                        (acc["cx"] + (a["x"] + b["x"]) * c).alias("cx"),
                        (acc["cy"] + (a["y"] + b["y"]) * c).alias("cy"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    # rings with fewer than 4 points (closed triangle minimum) have no area
    return F.when(F.size(ring) >= 4, F.aggregate(idx, zero, acc3,
                  lambda s: F.struct((s["cx"] / (F.lit(3.0) * s["a"])).alias("x"),
                                     (s["cy"] / (F.lit(3.0) * s["a"])).alias("y"))))
