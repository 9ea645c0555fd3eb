"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per entry met by a walk. `kind` is file, dir, symlink, other, skipped (entries
# that options left out, by number) or error; the last
# two columns are set on error rows only. `depth` is a directory's own depth (root 0) and,
# for everything else, the depth of the directory that holds it.
LISTING = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mod_time", T.TimestampType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# One row per fingerprinted file.
FINGERPRINT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mod_time", T.TimestampType()),
        T.StructField("hash", T.StringType()),
        T.StructField("hash_algorithm", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("strings", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("is_executable", T.BooleanType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

# One row per batch handed to an API.
DELIVERY_LOG = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
