"""Schemas and operation codes of the change-log."""

from __future__ import annotations

from pyspark.sql import types as T

DELETE, PUT, MERGE = 0, 1, 2
N_LEVELS = 7
DEFAULT_CF, DEFAULT_CF_ID = "default", 0

#: One row is one version of one key: (cf_id, user_key, seq) is unique, a higher seq is newer, keys order bytewise.
CHANGELOG = T.StructType(
    [
        T.StructField("cf_id", T.IntegerType(), False),
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

#: Log of run files: action add or remove. Ranges are user keys, both ends included.
MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("cf_id", T.IntegerType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("run_id", T.LongType(), False),
        T.StructField("path", T.StringType(), True),
        T.StructField("bytes", T.LongType(), True),
        T.StructField("rows", T.LongType(), True),
        T.StructField("tombstones", T.LongType(), True),
        T.StructField("smallest", T.BinaryType(), True),
        T.StructField("largest", T.BinaryType(), True),
        T.StructField("max_seq", T.LongType(), True),
    ]
)

#: Log of column families: event create or drop.
CF_CATALOG = T.StructType(
    [
        T.StructField("cf_id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("event", T.StringType(), False),
        T.StructField("event_seq", T.LongType(), False),
    ]
)
