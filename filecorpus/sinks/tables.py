"""Fingerprints as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(
    fingerprints: DataFrame, path: str, file_format: str = "parquet", mode: str = "append"
) -> None:
    """Write the rows, partitioned by the date they were processed on (``scan_date``)."""
    (
        fingerprints.withColumn("scan_date", F.to_date("processed_at"))
        .write.format(file_format)
        .mode(mode)
        .partitionBy("scan_date")
        .save(path)
    )
