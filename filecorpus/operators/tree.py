"""Operators over the directory structure of a listing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecorpus.functions.paths import (
    ancestor_keys,
    file_extension,
    is_executable,
    is_hidden,
    normalize_path,
    parent_path,
    path_components,
    paths_from_root,
)
from filecorpus.operators.joins import BROADCAST_BYTES, lookup_join, table_bytes
from filecorpus.staging import stage


def path_component_rows(files: DataFrame) -> DataFrame:
    """``path, pos, component`` for each element of the normalised path."""
    return files.select("path", F.posexplode(path_components("path")).alias("pos", "component"))


def hidden_per_directory(listing: DataFrame) -> DataFrame:
    """``parent, files, hidden_files``: only the base name decides."""
    if "kind" in listing.columns:
        listing = listing.filter("kind not in ('error', 'skipped')")
    return listing.groupBy("parent").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(is_hidden("path")).alias("hidden_files")
    )


def directory_rollup(files: DataFrame) -> DataFrame:
    """Totals of whole subtrees: ``dir, files, bytes, unique_hashes``.

    Each file counts once for every directory from its root down, but neither files nor
    hashes are copied to those directories. In depth-first order the files of a subtree come
    together, and so do, of one hash, its files there: k of them with k - 1 pairs of
    neighbours. So a hash counts +1 in the directory of each file and -1 in the lowest common
    directory of each two neighbours, and what is left of that in a subtree is 1. Directories
    with their own sums are then added up in depth-first order, each range of them in one
    pass, and only directories on the way to a range's ends come out of more than one.
    """
    up = paths_from_root(parent_path("path"), "root")
    own = files.select(up.alias("up"), "size", "hash", "path")
    sums = own.groupBy("up").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count("hash").alias("hashes")
    )
    shared = _neighbours(own.filter("hash is not null"))
    both = sums.unionByName(
        shared.select(
            "up",
            F.lit(0).cast("long").alias("files"),
            F.lit(None).cast("long").alias("bytes"),
            (-F.col("pairs")).alias("hashes"),
        )
    )
    ranged = both.repartitionByRange("up").sortWithinPartitions("up")
    partial = ranged.mapInPandas(_subtree_sums, "dir string, files long, bytes long, hashes long")
    return partial.groupBy("dir").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("hashes").alias("unique_hashes")
    )


def _neighbours(hashed: DataFrame) -> DataFrame:
    """``up, pairs``: for directories, of how many neighbours by hash they are the lowest common one."""

    def paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, kind = TaskContext.get().partitionId(), None, pa.list_(pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("hash"), batch.column("up")
            first = before or tuple(pa.nulls(1, c.type) for c in keys)
            shifted = [pa.concat_arrays([f, c.slice(0, len(c) - 1)]) for f, c in zip(first, keys, strict=True)]
            edge = pa.array([part if before is None and i == 0 else None for i in range(len(keys[0]))], pa.int64())
            none = pa.nulls(len(keys[0]), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*keys, *shifted, edge, none], names=["hash", "up", "hash_before", "up_before", "first_of", "last_of"]
            )
            before = tuple(c.slice(len(c) - 1) for c in keys)
        if before:
            yield pa.RecordBatch.from_arrays(
                [*before, pa.nulls(1, pa.string()), pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.array([str(part)])],
                names=["hash", "up", "hash_before", "up_before", "first_of", "last_of"],
            )

    # Equal files of one directory have a place of their own, so no range has to hold them all.
    order = ["hash", "up", "path"]
    rows = hashed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).drop("path")
    pairs = rows.mapInArrow(
        paired,
        "hash string, up array<string>, hash_before string, up_before array<string>,"
        " first_of long, last_of string",
    )
    # What remains of a task: a row for each directory, and its first and last file.
    common = F.when(
        F.col("hash") == F.col("hash_before"), F.array_intersect("up", "up_before")
    )
    ends = F.when(
        F.col("first_of").isNotNull() | F.col("last_of").isNotNull(), F.struct("hash", "up")
    )
    counted = pairs.select(common.alias("common"), "first_of", F.col("last_of").cast("long"), ends.alias("end"))
    counted = counted.groupBy("common", "first_of", "last_of", "end").agg(F.count(F.lit(1)).alias("pairs"))
    counted = stage(counted, "rollup-pairs")
    # A task's first file follows the last one of the task before that had any: two rows a task.
    edges = counted.filter("end is not null").select("end", F.coalesce("first_of", "last_of").alias("part"), "last_of")
    before = F.lag("end").over(Window.orderBy("part", F.col("last_of").asc_nulls_first()))
    across = edges.withColumn("before", before).filter(
        F.col("last_of").isNull() & (F.col("before.hash") == F.col("end.hash"))
    )
    inside = counted.filter(F.size("common") > 0).select(F.col("common").alias("up"), "pairs")
    over = across.select(
        F.array_intersect("end.up", "before.up").alias("up"), F.lit(1).cast("long").alias("pairs")
    )
    every = inside.unionByName(over.filter(F.size("up") > 0))
    return every.groupBy("up").agg(F.sum("pairs").alias("pairs"))


def _subtree_sums(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each directory of a range over what lies in the range at or below it."""
    open_: list[list] = []  # from the root down: directory and its sums so far
    done: list[list] = []

    def close(depth: int) -> None:
        while len(open_) > depth:
            node = open_.pop()
            done.append(node)
            if open_:
                above = open_[-1]
                above[1] += node[1]
                above[2] = above[2] if node[2] is None else node[2] + (above[2] or 0)
                above[3] += node[3]

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(done, columns=["dir", "files", "bytes", "hashes"])
        done.clear()
        return made.astype({"bytes": "Int64"})

    for rows in frames:
        for up, files, size, hashes in zip(
            rows["up"], rows["files"], rows["bytes"], rows["hashes"], strict=True
        ):
            same = 0
            while same < min(len(open_), len(up)) and open_[same][0] == up[same]:
                same += 1
            close(same)
            open_.extend([directory, 0, None, 0] for directory in up[same:])
            node = open_[-1]
            node[1] += files
            node[2] = node[2] if pd.isna(size) else int(size) + (node[2] or 0)
            node[3] += hashes
        yield frame()
    close(0)
    yield frame()


def extension_profile(files: DataFrame) -> DataFrame:
    """``ext, files, bytes, executables, duplicates`` (repeats of a hash within it)."""
    return (
        files.select(
            file_extension("path").alias("ext"), "size", "hash", is_executable("mode").alias("exe")
        )
        .groupBy("ext")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("bytes"),
            F.count_if("exe").alias("executables"),
            (F.count("hash") - F.count_distinct("hash")).alias("duplicates"),
        )
    )


def files_under(
    files: DataFrame, dirs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row ``dir, path`` per directory of ``dirs(dir)`` and path that lies below it.

    A directory does not contain itself, except for the root (``/`` or ``''``), which
    contains everything. Paths meet directories on equal ancestor keys, so there is no
    prefix comparison between all pairs.
    """
    contained = F.col("_child") != F.col("_parent")
    keyed = dirs.distinct().withColumn("_parent", normalize_path("dir"))
    keyed = keyed.withColumn("key", F.regexp_replace("_parent", r"(?s)/\z", ""))
    children = files.select(
        "path", normalize_path("path").alias("_child"), F.explode(ancestor_keys("path")).alias("key")
    )
    small = table_bytes(keyed) <= broadcast_bytes
    joined = lookup_join(children, keyed, "key", salt_on=["path"], small=small)
    below = F.startswith("_child", "_parent") & contained
    return joined.filter((F.col("_parent") == "") | below).select("dir", "path")


# What a failure of the walk leaves unknown.
NO_SUCH_FILE = "no such file or directory"


def paths_exist(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, exists`` for each distinct path of ``wanted``; NULL where that cannot be told.

    That is so for paths at or below one that the walk could not look at. A link exists if
    its target does. Both sides are summed up per path in one shuffle, so repeated paths on
    either side are combined before they move.
    """
    known = listing.filter(F.col("kind") != "error")
    if "op" in listing.columns:
        known = known.filter(~F.coalesce(F.col("op") == "dangling", F.lit(False)))
    marked = wanted.select("path", F.lit(True).alias("_wanted"), F.lit(False).alias("_listed")).unionByName(
        known.select("path", F.lit(False).alias("_wanted"), F.lit(True).alias("_listed"))
    )
    found = (
        marked.groupBy("path")
        .agg(F.max("_wanted").alias("_wanted"), F.max("_listed").alias("exists"))
        .filter("_wanted")
        .select("path", "exists")
    )
    if "op" not in listing.columns:
        return found
    # Missing paths below what could not be looked at: met on equal ancestor keys.
    missing = F.coalesce(F.col("message") == NO_SUCH_FILE, F.lit(False))
    dark = listing.filter((F.col("kind") == "error") & ~missing).select(F.col("path").alias("key"))
    above = found.filter("not exists").select("path", F.explode(_at_and_above("path")).alias("key"))
    unknown = above.join(dark.distinct(), "key", "left_semi").select("path").distinct()
    marked = unknown.withColumn("_unknown", F.lit(True))
    return found.join(marked, "path", "left").select(
        "path", F.when(F.col("_unknown").isNull(), F.col("exists")).alias("exists")
    )


def _at_and_above(path: str) -> Column:
    """A path and all paths above it, as they are written in it."""
    steps = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda n: F.array_join(F.slice(steps, 1, n), "/"),
    )


def empty_directories(listing: DataFrame) -> DataFrame:
    """``path`` of each directory without any entry, hidden ones included.

    Every entry speaks for its parent and every directory for itself; so do entries that the
    walk has left out, which its ``skipped`` rows stand for, and a directory that could not
    be read is not known to be empty. The voices are counted per path in one pass and one
    shuffle, and a directory with very many entries is combined before it moves.
    """
    is_dir = F.col("kind") == "dir"
    unread = F.lit(False)
    if "op" in listing.columns:
        unread = F.coalesce((F.col("kind") == "error") & (F.col("op") == "read_dir"), F.lit(False))
    itself = F.struct(
        F.when(is_dir | unread, F.col("path")).alias("path"),
        F.when(unread, 0).otherwise(1).alias("_alone"),
    )
    parent = F.struct(F.col("parent").alias("path"), F.lit(0).alias("_alone"))
    voices = listing.select(F.inline(F.array(itself, parent)))
    return (
        voices.filter(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.min("_alone").alias("_alone"))
        .filter("_alone = 1")
        .select("path")
    )
