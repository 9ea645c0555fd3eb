"""Fingerprint rows and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecorpus.functions.content import (
    HASH_ALGORITHMS,
    MIN_STRING_LENGTH,
    content_hash,
    content_lines,
    printable_runs,
    printable_strings,
)
from filecorpus.functions.paths import base_name, is_executable
from filecorpus.functions.records import json_record
from filecorpus.schema import FINGERPRINT


def too_large(size: Column, max_size: int) -> Column:
    """The error of a file above the limit, NULL for any other."""
    text = F.concat(F.lit("file too large ("), size, F.lit(" bytes)"))
    return F.when(size > max_size, text)


def fingerprint(
    files: DataFrame,
    algorithm: str = "sha256",
    extract_strings: bool = False,
    min_length: int = MIN_STRING_LENGTH,
    max_size: int | None = None,
    string_block: int = 0,
    max_strings: int | None = None,
) -> DataFrame:
    """One fingerprint row per input row.

    Needs ``path, size, mod_time, mode, content``; an ``error`` column, if there is one,
    carries a failed read. The first failure wins and later values stay NULL; a file
    above ``max_size``, if a limit is given, is reported and its content not looked at.
    """
    algorithm = algorithm.lower()
    read_error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    errors = [
        *([] if max_size is None else [too_large(F.col("size"), max_size)]),
        read_error,
        F.when(F.col("content").isNull(), F.lit("open error: no content")),
    ]
    if algorithm not in HASH_ALGORITHMS:
        errors.append(F.lit(f"hash error: unsupported hash algorithm: {algorithm}"))
    error = F.coalesce(*errors)
    content = F.when(error.isNull(), F.col("content"))
    strings = (
        printable_strings(content, min_length, string_block, max_strings)
        if extract_strings
        else F.lit(None).cast("array<string>")
    )
    columns = {
        "path": F.col("path"),
        "name": base_name("path"),
        "size": F.coalesce(F.col("size"), F.lit(0)),
        "mod_time": F.col("mod_time"),
        "hash": content_hash(content, algorithm),
        "hash_algorithm": F.lit(algorithm),
        "mime_type": F.lit(None),
        "strings": strings,
        "error": error,
        "is_executable": F.coalesce(is_executable("mode"), F.lit(False)),
        "processed_at": F.current_timestamp(),
    }
    return files.select(
        [columns[f.name].cast(f.dataType).alias(f.name) for f in FINGERPRINT.fields]
    )


def with_content_hash(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Replace the content by its ``hash``, in the stage that reads it."""
    algorithm = algorithm.lower()
    if algorithm not in HASH_ALGORITHMS:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    return files.withColumn("hash", content_hash(F.col("content"), algorithm)).drop("content")


def string_rows(
    files: DataFrame,
    min_length: int = MIN_STRING_LENGTH,
    block: int = 0,
    max_strings: int | None = None,
) -> DataFrame:
    """One row per distinct string of a file: ``path, pos, string``; pos = first-seen order."""
    strings = printable_strings(F.col("content"), min_length, block, max_strings)
    return files.select("path", F.posexplode(strings).alias("pos", "string"))


def string_frequency(files: DataFrame, min_length: int = MIN_STRING_LENGTH) -> DataFrame:
    """Over the whole corpus: occurrences of each string and number of paths that have it.

    Counts are combined per (string, path) before each shuffle, so a string found in
    every file costs one partial row per task.
    """
    runs = files.select(
        "path", F.explode(printable_runs(F.col("content"), min_length)).alias("string")
    )
    return runs.groupBy("string").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("path").alias("paths")
    )


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``path, line_no`` (from 0), ``line``."""
    return files.select("path", F.posexplode(content_lines(F.col("content"))).alias("line_no", "line"))


def json_records(fingerprints: DataFrame, *keep: Column | str) -> DataFrame:
    """The JSON ``record`` of each row, next to the columns to keep."""
    return fingerprints.select(*keep, json_record().alias("record"))
