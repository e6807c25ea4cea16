"""vigila — Spark-native analytics for dated, located incident reports,
call records and the entity graphs built from them.

Every operator takes and returns Spark DataFrames; nothing is collected
to the driver except bounded scalars (a bounding box, a convergence sum).
"""

__version__ = "0.1.0"
