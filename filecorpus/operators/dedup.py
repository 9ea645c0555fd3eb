"""Duplicate removal and its reports.

A duplicate group may hold a third of the corpus, so no operator here brings a whole
group together: the window keeps one row per key and task before the shuffle, and the
report meets its keepers on (key, salt).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecorpus.operators.filters import without_errors
from filecorpus.operators.joins import salt_of

# What decides which of several equal rows is kept.
KEEP_ORDER = ("path", "mod_time")


def dedup_key(by: str = "hash") -> Column:
    """Key of a fingerprint row: ``hash``, ``path`` or ``name`` (with size).

    Anything else falls back to ``hash``. The algorithm is part of the hash key, so
    equal digests of different algorithms stay apart.
    """
    match by:
        case "path":
            key = F.col("path")
        case "name":
            key = F.concat(F.col("name"), F.lit("#"), F.col("size").cast("string"))
        case _:
            key = F.concat(F.col("hash_algorithm"), F.lit(":"), F.col("hash"))
    return F.coalesce(key, F.lit(""))


def first_per_key(rows: DataFrame, key: Column, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key.

    The rank filter lets Spark cut every map-side partition down to one row per key
    before the shuffle, whatever the size of the group.
    """
    window = Window.partitionBy("_key").orderBy(*order)
    return (
        rows.withColumn("_key", key)
        .withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1")
        .drop("_key", "_rank")
    )


def deduplicate(fingerprints: DataFrame, by: str = "hash") -> DataFrame:
    """Fingerprint rows without errors, one per key; the smallest path is kept."""
    return first_per_key(without_errors(fingerprints), dedup_key(by), KEEP_ORDER)


def with_keeper(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """``key``, the order columns, ``copies`` and ``keeper`` of rows that share their key.

    Equal rows are one row with their number of ``copies``; ``keeper`` is the first row
    of the group, as a struct of the order columns. Rows move once, to (key, salt); the
    sums per group go over partial rows, one per salt at most, and the keeper returns
    only to the salts its group has. Both uses of the moved rows share one shuffle, so
    whatever the key is computed from is read once; the key must not be NULL.
    """
    salted = rows.select(key.alias("key"), *order, salt_of(*order).alias("_salt"))
    placed = salted.repartition("key", "_salt")
    pieces = placed.groupBy("key", "_salt").agg(
        F.min(F.struct(*order)).alias("keeper"), F.count(F.lit(1)).alias("_n")
    )
    groups = (
        pieces.groupBy("key")
        .agg(
            F.min("keeper").alias("keeper"),
            F.sum("_n").alias("_n"),
            F.collect_list("_salt").alias("_salts"),
        )
        .filter("_n > 1")
    )
    keepers = groups.select("key", "keeper", F.explode("_salts").alias("_salt"))
    # Equal rows have the same salt, so they are counted where the join left them.
    members = placed.join(keepers, ["key", "_salt"]).groupBy("key", "_salt", "keeper", *order)
    return members.agg(F.count(F.lit(1)).alias("copies")).drop("_salt")


def duplicate_report(fingerprints: DataFrame, by: str = "hash") -> DataFrame:
    """The filtered duplicates: ``key, path, kept_path, copies``.

    ``copies`` counts the filtered rows of that path, so it is more than one only where
    overlapping roots listed a path repeatedly.
    """
    found = with_keeper(without_errors(fingerprints), dedup_key(by), KEEP_ORDER)
    kept = F.struct(*KEEP_ORDER).eqNullSafe(F.col("keeper")).cast("long")
    return found.select(
        "key",
        "path",
        F.col("keeper.path").alias("kept_path"),
        (F.col("copies") - kept).alias("copies"),
    ).filter("copies > 0")


def dedup_summary(fingerprints: DataFrame, by: str = "hash") -> DataFrame:
    """One row: ``total, unique_files, duplicates, errors``.

    The total includes error rows and duplicates are total minus unique, so error rows
    count as duplicates; ``errors`` tells how many of them are.
    """
    key = F.when(F.col("error").isNull(), dedup_key(by))
    return fingerprints.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(key).alias("unique_files"),
        F.count("error").alias("errors"),
    ).select("total", "unique_files", (F.col("total") - F.col("unique_files")).alias("duplicates"), "errors")


def unseen(fingerprints: DataFrame, seen_keys: DataFrame, by: str = "hash") -> DataFrame:
    """Deduplicated rows whose key is not in ``seen_keys(key)``.

    The batch is reduced to one row per key first, so neither side of the anti-join has
    a hot key. Add the keys of the result to the table to carry on; start from an empty
    table to reset.
    """
    fresh = deduplicate(fingerprints, by).withColumn("key", dedup_key(by))
    return fresh.join(seen_keys.select("key"), "key", "left_anti")
