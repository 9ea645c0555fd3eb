"""A fingerprint row as a JSON record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How an unset time is written, and the characters that are written as
# escapes so that a record can be embedded in HTML or script text.
ZERO_TIME = "0001-01-01T00:00:00Z"
ESCAPES = (
    ("<", "\\u003c"),
    (">", "\\u003e"),
    ("&", "\\u0026"),
    ("\u2028", "\\u2028"),
    ("\u2029", "\\u2029"),
)


def rfc3339(time: Column) -> Column:
    """RFC 3339 text in UTC, whatever the session's time zone; no trailing zeros."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(time), epoch)
    return F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def json_record() -> Column:
    """The record of one row with the fingerprint columns, in the published field order.

    mimeType, strings, error and isExecutable are left out when they say nothing;
    ``to_json`` drops NULL fields, so "says nothing" is turned into NULL first.
    """
    record = F.struct(
        F.col("path"),
        F.col("name"),
        F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce(rfc3339(F.col("mod_time")), F.lit(ZERO_TIME)).alias("modTime"),
        F.coalesce("hash", F.lit("")).alias("hash"),
        F.col("hash_algorithm").alias("hashAlgorithm"),
        F.nullif(F.col("mime_type"), F.lit("")).alias("mimeType"),
        F.when(F.size("strings") > 0, F.col("strings")).alias("strings"),
        F.nullif(F.col("error"), F.lit("")).alias("error"),
        F.when(F.col("is_executable"), F.lit(True)).alias("isExecutable"),
        rfc3339(F.col("processed_at")).alias("processedAt"),
    )
    text = F.to_json(record)
    # These characters can only occur inside JSON strings, so a replacement over the
    # whole text is safe.
    for char, escape in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text
