"""The fixed schemas. Nothing is inferred from files: an empty file must still have columns."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType, TimestampNTZType

#: What a manifest must say; it may say more.
MANIFEST = StructType([StructField("run_id", StringType()), StructField("location", StringType()), StructField("status", StringType())])

#: A raw line, as text: values are cast afterwards, so that what can't be cast fails instead of becoming null.
RAW = StructType([StructField("valid_time", StringType()), StructField("analysis_time", StringType()), StructField("index", StringType())])

OBSERVATIONS = StructType([
    StructField("run_id", StringType()),
    StructField("valid_time", TimestampNTZType()),
    StructField("analysis_time", TimestampNTZType()),
    StructField("kindex", IntegerType()),
])

T1 = StructType([
    StructField("location", StringType()),
    StructField("valid_time", TimestampNTZType()),
    StructField("analysis_time", TimestampNTZType()),
    StructField("kindex", IntegerType()),
    StructField("run_id", StringType()),
])

T2 = StructType([
    StructField("location", StringType()),
    StructField("valid_time", TimestampNTZType()),
    StructField("kindex", IntegerType()),
    StructField("flag", BooleanType()),
])
