"""Column-expression helpers. All are built-in Spark expressions, so they
stay inside whole-stage codegen; no Python UDFs."""

from .geo import (MERC_R, HAV_R, merc_x, merc_y, merc_lon, merc_lat, haversine_m,
                  planar_m, degree_dist_m, point, ring_contains, rings_contain,
                  ring_centroid, unit_xyz)
from .privacy import hash_id, hash_array
from .text import split_list, clip
from .timefn import day_index, time_bin, minutes_apart, micros

__all__ = [
    "MERC_R", "HAV_R", "merc_x", "merc_y", "merc_lon", "merc_lat", "haversine_m",
    "planar_m", "degree_dist_m", "point", "ring_contains", "rings_contain",
    "ring_centroid", "unit_xyz", "hash_id", "hash_array", "split_list", "clip",
    "day_index", "time_bin", "minutes_apart", "micros",
]
