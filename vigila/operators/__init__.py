"""Relational, spatial, temporal, model and graph operators on DataFrames."""
