"""Comparison of files and of whole snapshots.

Sizes are compared first, and only content that can be equal is looked at. Content never
moves: it is reduced to its SHA-256 in the stage that reads it, and equal size and digest
stand for equal bytes.

The files given have ``path, kind, size`` and their ``hash``, or their ``content``, or
neither: then they are files on disk, and those that matter are opened and digested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecorpus.operators.dedup import with_keeper
from filecorpus.operators.fingerprint import with_content_hash
from filecorpus.operators.joins import lookup_join
from filecorpus.sources.content import digest_files, spread_by_bytes


def _hashed(files: DataFrame) -> DataFrame:
    """``path, kind, size, hash, error`` of files that have a content, a hash, or both not.

    A NULL content or hash without a reason gets one.
    """
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    if "content" in files.columns:
        files = with_content_hash(files)
    unread = F.when(
        (F.col("kind") == "file") & F.col("hash").isNull(),
        F.concat(F.lit("open "), F.col("path"), F.lit(": no content")),
    )
    return files.select("path", "kind", "size", "hash", F.coalesce(error, unread).alias("error"))


def _digested(listing: DataFrame) -> DataFrame:
    """The same for files on disk."""
    return digest_files(spread_by_bytes(listing), "sha256")


def compare_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``path_a, path_b, equal, error`` for each of the given pairs.

    A side that is missing, not a regular file or not readable gives an error instead of a
    verdict, unless sizes differ, which says enough. A path listed twice counts once, and a
    path in very many pairs is spread over tasks.
    """
    on_disk = "content" not in files.columns and "hash" not in files.columns
    if on_disk:
        listed = _one_per_path(files, "kind", "size")
        sizes = _sides(pairs, listed)
        same = sizes.filter(
            (F.col("a.kind") == "file") & (F.col("b.kind") == "file") & (F.col("a.size") == F.col("b.size"))
        )
        wanted = same.select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct()
        hashes = _digested(wanted.join(files.groupBy("path").agg(F.max("size").alias("size")), "path"))
        files = (
            files.groupBy("path")
            .agg(F.max(F.struct("kind", "size")).alias("f"))
            .select("path", "f.*")
            .join(hashes.select("path", "hash", "error"), "path", "left")
        )
        known = _one_per_path(files, "kind", "size", "hash", "error")
    else:
        known = _one_per_path(_hashed(files), "kind", "size", "hash", "error")
    joined = _sides(pairs, known)

    def missing(name: str) -> Column:
        text = F.concat(F.lit("stat "), F.col(f"path_{name}"), F.lit(": no such file or directory"))
        return F.when(F.col(name).isNull(), text)

    irregular = F.when(
        (F.col("a.kind") != "file") | (F.col("b.kind") != "file"), F.lit("not regular files")
    )
    differ = F.col("a.size") != F.col("b.size")
    unread = F.when(~differ, F.coalesce("a.error", "b.error"))
    error = F.coalesce(missing("a"), missing("b"), irregular, unread)
    equal = F.when(differ, F.lit(False)).otherwise(F.col("a.hash") == F.col("b.hash"))
    return joined.select(
        "path_a", "path_b", F.when(error.isNull(), equal).alias("equal"), error.alias("error")
    )


def _one_per_path(files: DataFrame, *columns: str) -> DataFrame:
    """``path, file``; a failed reading counts only if there is no other."""
    first = [F.col("error").isNull()] if "error" in columns else []
    ordered = F.struct(*first, *columns)
    return files.groupBy("path").agg(F.max_by(F.struct(*columns), ordered).alias("file"))


def _sides(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs with ``a`` and ``b``, what is known of each side, NULL where nothing is."""
    sides = F.explode(F.array("path_a", "path_b")).alias("path")
    every = pairs.select(sides).distinct().join(known, "path", "left")
    rows = pairs.select("path_a", "path_b")
    for name, other in (("a", "path_b"), ("b", "path_a")):
        lookup = every.select(F.col("path").alias(f"path_{name}"), F.col("file").alias(name))
        rows = lookup_join(rows, lookup, f"path_{name}", salt_on=[other], small=False)
    return rows


def identical_files(files: DataFrame) -> DataFrame:
    """``keeper_path, path`` for each regular file that equals one with a smaller path.

    The pairs of a group share its smallest path. They say which files are equal with
    one row per file; all pairs of a group would grow with the square of its size. Files on
    disk are opened only if another has their size; those that cannot be read are left out.
    """
    regular = files.filter(F.col("kind") == "file")
    if "content" in files.columns:
        # Asked of the content, not of the digest, which would be taken twice.
        hashed = with_content_hash(regular.filter(F.col("content").isNotNull()))
    elif "hash" in files.columns:
        hashed = regular.filter(F.col("hash").isNotNull())
    else:
        shared = regular.groupBy("size").agg(F.count_distinct("path").alias("n")).filter("n > 1")
        candidates = lookup_join(regular, shared.select("size"), "size", salt_on=["path"], small=False)
        hashed = _digested(candidates.select("path", "size")).filter("hash is not null")
    same_bytes = F.concat(F.col("size").cast("string"), F.lit(":"), F.col("hash"))
    found = with_keeper(hashed, F.coalesce(same_bytes, F.lit("")), ["path"])
    pairs = found.select(F.col("keeper.path").alias("keeper_path"), "path")
    return pairs.filter(~F.col("keeper_path").eqNullSafe(F.col("path")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``rel_path, status``: added, removed, changed, same, or unknown without a hash.

    Both snapshots have ``rel_path, size, hash``. They are put side by side by one
    aggregation, which moves each row once and lets a path listed twice count once.
    """

    def tagged(side: DataFrame, name: str, other: str) -> DataFrame:
        seen = F.struct("size", "hash")
        return side.select("rel_path", seen.alias(name), F.when(F.lit(False), seen).alias(other))

    both = tagged(old, "before", "after").unionByName(tagged(new, "after", "before"))
    status = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before.hash").isNull() | F.col("after.hash").isNull(), "unknown")
        .when(F.col("before") == F.col("after"), "same")
        .otherwise("changed")
    )
    return (
        both.groupBy("rel_path")
        .agg(F.max("before").alias("before"), F.max("after").alias("after"))
        .select("rel_path", status.alias("status"))
    )
