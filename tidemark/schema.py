"""Row shapes shared by the modules."""

from __future__ import annotations

from pyspark.sql import types as T

#: One indexed document. ``owner`` is the ownership key ``<namespace>_<name>``. Columns that are
#: filtered on stand beside the map, because map lookups give Parquet nothing to push down.
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("index_name", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_uri", T.StringType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("split_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: One failed unit of work (a file, a URL, a batch).
ERROR = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

SOURCE_TYPES = ("Git", "Static", "Database")
STRATEGIES = ("Auto", "Manual", "Ignore")
PHASES = ("Pending", "Scheduled", "Running", "Suspended", "DriftRemediation", "Completed", "Failed")
