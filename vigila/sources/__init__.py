"""Readers (R1-R10), writers (W1-W5) and the derived fixture views."""

from .fixtures import load_table, incidents_view, calls_view, demographics_view
from .readers import (read_incidents_csv, read_calls_csv, read_geojson, read_geojson_seq,
                      read_wkt_csv, read_any, read_folder, classify_columns, read_graphml,
                      read_edge_list, read_exported_graph, read_devices_csv, read_locations_csv)
from .sinks import write_csv, write_geojson_seq, write_graphml, upsert, append, assert_unique

__all__ = [
    "load_table", "incidents_view", "calls_view", "demographics_view",
    "read_incidents_csv", "read_calls_csv", "read_geojson", "read_geojson_seq", "read_wkt_csv",
    "read_any", "read_folder", "classify_columns", "read_graphml", "read_edge_list",
    "read_exported_graph", "read_devices_csv", "read_locations_csv",
    "write_csv", "write_geojson_seq", "write_graphml", "upsert", "append", "assert_unique",
]
