"""Filters over a listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecorpus.functions.globs import ExcludeRules
from filecorpus.functions.paths import base_name, path_under_root, paths_from_root


def within_depth(listing: DataFrame, max_depth: int) -> DataFrame:
    """Entries of directories at most ``max_depth`` below their root; negative = all."""
    return listing if max_depth < 0 else listing.filter(F.col("depth") <= max_depth)


def _shown(root: Column, path: Column) -> Column:
    root_name = base_name(root)
    below = path_under_root(path, root)
    hidden_root = root_name.startswith(".") & ~root_name.isin(".", "..")
    return ~(hidden_root | below.startswith(".") | below.contains("/."))


def skip_hidden(listing: DataFrame) -> DataFrame:
    """Drop every entry with a dot-name between the root's own name and itself.

    Directories above the root do not count, and neither does a root given as ``.``.
    """
    return listing.filter(_shown(F.col("root"), F.col("path")))


def regular_files(listing: DataFrame) -> DataFrame:
    """Regular files only: no directories, links, devices or error rows."""
    return listing.filter(F.col("kind") == "file")


def max_file_size(listing: DataFrame, max_size: int) -> DataFrame:
    """Drop entries above ``max_size`` bytes; zero or negative = no limit."""
    return listing if max_size <= 0 else listing.filter(F.col("size") <= max_size)


def exclude_globs(listing: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Drop entries that a pattern excludes, by name or by whole path.

    A pattern that matches a directory at or below the root takes its whole subtree
    along. All patterns are folded into one literal regex per test, so this is a plain
    filter in the scan stage, whatever the number of patterns.
    """
    rules = ExcludeRules.of(list(patterns))
    root, path = F.col("root"), F.col("path")
    excluded = F.lit(False)
    if rules.names:
        below = F.concat(F.lit("/"), base_name(root), F.lit("/"), path_under_root(path, root))
        names = F.when(path != "/", below)
        matched = names.rlike(rf"/(?:{rules.names})(?=/|\z)")
        excluded = excluded | F.coalesce(matched, F.lit(False))
    if rules.paths:
        # Few paths pass the first test, a regex over the path as it is; the second sees
        # to it that the directory matched is not one above the root.
        candidate = path.rlike(rf"\A(?:{rules.paths})(?:(?=/|\z)|(?<=\A/))")
        excluded = excluded | (
            candidate
            & F.exists(paths_from_root(path, root), lambda p: p.rlike(rf"\A(?:{rules.paths})\z"))
        )
    return listing.filter(~excluded)


def without_errors(fingerprints: DataFrame) -> DataFrame:
    """Rows that were fingerprinted without an error."""
    return fingerprints.filter(F.col("error").isNull())


def scan_errors(listing: DataFrame) -> DataFrame:
    """The failures of a walk: one row each, none dropped; a table that is no walk has none."""
    known = [
        F.col(c) if c in listing.columns else F.lit(None).cast("string").alias(c)
        for c in ("root", "path", "op", "message")
    ]
    return listing.filter(F.col("kind") == "error").select(*known)


def below_roots(listing: DataFrame, roots: Sequence[str]) -> DataFrame:
    """The listing of several roots from that of a tree which holds them all, a bag union.

    An entry is there once for each root that is it or lies above it, as if each root had
    been walked, with ``root`` and ``depth`` accordingly.
    """
    path = F.col("path")
    above = F.filter(
        F.array(*map(F.lit, dict.fromkeys(roots))),
        lambda root: (path == root) | F.startswith(path, F.concat(root, F.lit("/"))),
    )
    others = [c for c in listing.columns if c not in ("root", "depth")]
    rows = listing.select(*others, F.explode(above).alias("root"))
    below = path_under_root(path, F.col("root"))
    steps = F.when(below == "", 0).otherwise(F.size(F.split(below, "/")))
    return rows.withColumn("depth", F.greatest(steps - (F.col("kind") != "dir").cast("int"), F.lit(0)))
