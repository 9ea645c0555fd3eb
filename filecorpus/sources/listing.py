"""File-tree listings.

Two ways to the same table (``schema.LISTING``):

* ``spark.read.format("file_listing")`` walks subtrees in parallel; the driver only
  opens the topmost directories to find enough subtrees;
* :func:`list_tree` lists level by level, each level being one Spark job over the
  directories found by the one before, for trees of any shape and size.

``spark.readStream.format("file_listing")`` gives the files that have come or changed since the
last trigger.

All see local paths, so on a cluster the tree must be mounted on every executor.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import stat
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from filecorpus.functions.globs import ExcludeRules
from filecorpus.schema import LISTING
from filecorpus.staging import stage

ARROW_LISTING = pa.schema(
    [
        ("root", pa.string()),
        ("path", pa.string()),
        ("parent", pa.string()),
        ("name", pa.string()),
        ("depth", pa.int32()),
        ("kind", pa.string()),
        ("size", pa.int64()),
        ("mod_time", pa.timestamp("us", tz="UTC")),
        ("mode", pa.int32()),
        ("op", pa.string()),
        ("message", pa.string()),
    ]
)
_ROWS_PER_BATCH = 10_000
NAMES_PER_TASK = 200_000
# Most directories that the driver opens to find subtrees to hand out.
MAX_SUBTREES = 4096


@dataclass(frozen=True)
class WalkOptions:
    """What a walk leaves out. Everything named here prunes whole subtrees."""

    max_depth: int = -1
    max_file_size: int = -1
    skip_symlinks: bool = True
    skip_hidden: bool = True
    exclude: tuple[str, ...] = ()

    @cached_property
    def _patterns(self) -> tuple[re.Pattern | None, re.Pattern | None]:
        rules = ExcludeRules.of(self.exclude)
        return tuple(re.compile(r) if r else None for r in (rules.names, rules.paths))

    def excludes(self, path: str) -> bool:
        names, paths = self._patterns
        return bool(
            (names and names.fullmatch(os.path.basename(path) or path))
            or (paths and paths.fullmatch(path))
        )

    def hides(self, name: str) -> bool:
        return self.skip_hidden and name.startswith(".") and name not in (".", "..")

    def too_deep(self, depth: int) -> bool:
        return 0 <= self.max_depth < depth


def _printable(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def _is_text(path: str) -> bool:
    try:
        path.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def _error(root: str, path: str, depth: int, op: str, cause: OSError | str) -> tuple:
    message = cause.strerror.lower() if isinstance(cause, OSError) and cause.strerror else str(cause)
    path = _printable(path)
    parent, name = os.path.split(path)
    return (root, path, parent, name, depth, "error", None, None, None, op, message)


def _kind(mode: int) -> str:
    if stat.S_ISREG(mode):
        return "file"
    if stat.S_ISDIR(mode):
        return "dir"
    return "symlink" if stat.S_ISLNK(mode) else "other"


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _entry(root: str, parent: str, path: str, depth: int, info: os.stat_result) -> tuple:
    name = os.path.basename(path)
    modified = _EPOCH + dt.timedelta(microseconds=info.st_mtime_ns // 1000)
    kind = _kind(info.st_mode)
    mode = stat.S_IMODE(info.st_mode)
    return (root, path, parent, name or path, depth, kind, info.st_size, modified, mode, None, None)


def open_root(root: str, options: WalkOptions) -> tuple | None:
    """The listing row of a root, an error row, or None if the options leave it out."""
    path = os.path.normpath(root)
    if not _is_text(path):
        return _error(_printable(path), path, 0, "name", "path is not valid UTF-8")
    try:
        info = os.lstat(path)
    except OSError as cause:
        return _error(path, path, 0, "access", cause)
    if options.hides(os.path.basename(path)):
        return None
    if stat.S_ISLNK(info.st_mode):
        if options.skip_symlinks:
            return None
        try:
            resolved = os.path.realpath(path, strict=True)
        except OSError as cause:
            return _error(path, path, 0, "resolve", cause)
        try:
            info = os.stat(resolved)
        except OSError as cause:
            return _error(path, resolved, 0, "access_resolved", cause)
        path = resolved
    if options.excludes(path) or _too_large(info, options):
        return None
    return _entry(path, os.path.dirname(path), path, 0, info)


def _too_large(info: os.stat_result, options: WalkOptions) -> bool:
    return 0 < options.max_file_size < info.st_size and stat.S_ISREG(info.st_mode)


def list_names(root: str, directory: str, depth: int, options: WalkOptions) -> Iterator[tuple]:
    """A row without a kind for each entry of one directory; a failure is an error row.

    Entries that the options leave out are one row together, of kind ``skipped``, whose size
    is their number.
    """
    try:
        entries = os.scandir(directory)
    except OSError as cause:
        yield _error(root, directory, depth, "read_dir", cause)
        return
    skipped = 0
    with entries:
        for entry in entries:
            path = os.path.normpath(os.path.join(directory, entry.name))
            if options.hides(entry.name) or (_is_text(path) and options.excludes(path)):
                skipped += 1
            elif not _is_text(path):
                yield _error(root, path, depth, "name", "path is not valid UTF-8")
            else:
                yield (root, path, directory, entry.name, depth, *[None] * 6)
    if skipped:
        yield _skipped(root, directory, depth, skipped)


def _skipped(root: str, directory: str, depth: int, number: int) -> tuple:
    return (root, None, directory, None, depth, "skipped", number, *[None] * 4)


def look_up(rows: Iterable[tuple], options: WalkOptions) -> Iterator[tuple]:
    """Listing rows of what :func:`list_names` found; its error rows pass."""
    for row in rows:
        root, path, directory, _, depth, kind, *_ = row
        if kind is not None:
            yield row
            continue
        try:
            info = os.lstat(path)
        except OSError as cause:
            yield _error(root, path, depth, "entry_info", cause)
            continue
        own_depth = depth + stat.S_ISDIR(info.st_mode)
        if options.too_deep(own_depth) or _too_large(info, options):
            yield _skipped(root, directory, depth, 1)
            continue
        entry = _entry(root, directory, path, own_depth, info)
        if stat.S_ISLNK(info.st_mode) and not os.path.exists(path):
            entry = (*entry[:-2], "dangling", None)
        yield entry


def list_directory(root: str, directory: str, depth: int, options: WalkOptions) -> Iterator[tuple]:
    """Listing rows of the entries of one directory; a failure is a row too."""
    return look_up(list_names(root, directory, depth, options), options)


def _subdirectories(rows: Iterable[tuple]) -> Iterator[tuple[str, str, int]]:
    for row in rows:
        if row[5] == "dir":
            yield row[0], row[1], row[4]


def open_directory(
    root: str, directory: str, depth: int, options: WalkOptions
) -> Iterator[tuple[str, str, int]]:
    """The subdirectories of one directory, without a look at its files.

    Failures are left to the task that lists the directory, which meets them again.
    """
    if options.too_deep(depth + 1):
        return
    try:
        entries = os.scandir(directory)
    except OSError:
        return
    with entries:
        for entry in entries:
            if options.hides(entry.name) or not entry.is_dir(follow_symlinks=False):
                continue
            path = os.path.normpath(os.path.join(directory, entry.name))
            if _is_text(path) and not options.excludes(path):
                yield root, path, depth + 1


def walk(root: str, directory: str, depth: int, options: WalkOptions) -> Iterator[tuple]:
    """Rows of everything below a directory."""
    pending = [(root, directory, depth)]
    while pending:
        for row in list_directory(*pending.pop(), options):
            yield row
            pending.extend(_subdirectories([row]))


def _record_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    chunk: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = zip(*chunk)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, ARROW_LISTING)]
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW_LISTING)

    for row in rows:
        chunk.append(row)
        if len(chunk) == _ROWS_PER_BATCH:
            yield flush()
            chunk.clear()
    if chunk:
        yield flush()


@dataclass
class Rows(InputPartition):
    """Rows found while the tree was opened on the driver: roots and their errors."""

    rows: list[tuple]


@dataclass
class Directories(InputPartition):
    """Directories to list; with ``deep`` also everything below them."""

    directories: list[tuple[str, str, int]]
    deep: bool


def split_paths(text: str) -> list[str]:
    """Roots or patterns of an option: a JSON array, or a comma-separated list."""
    if text.lstrip().startswith("["):
        try:
            return list(json.loads(text))
        except json.JSONDecodeError:
            pass
    return [part.strip() for part in text.split(",") if part.strip()]


def _flag(text: str) -> bool:
    return text.strip().lower() == "true"


class FileListing(DataSource):
    """``file_listing``: options paths, maxDepth, maxFileSize, skipSymlinks, skipHidden,
    exclude, numPartitions and pushDepth; for a stream also since and settle.

    Set pushDepth to true where ``spark.sql.python.filterPushdown.enabled`` is; Spark
    refuses a reader that takes filters anywhere else.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self):
        return LISTING

    def _walk(self) -> tuple[list[str], WalkOptions, int]:
        get = self.options.get
        roots = split_paths(get("paths", get("path", "")))
        if not roots:
            raise ValueError("at least one path must be specified")
        options = WalkOptions(
            max_depth=int(get("maxDepth", "-1")),
            max_file_size=int(get("maxFileSize", "-1")),
            skip_symlinks=_flag(get("skipSymlinks", "true")),
            skip_hidden=_flag(get("skipHidden", "true")),
            exclude=tuple(split_paths(get("exclude", ""))),
        )
        return roots, options, int(get("numPartitions", "64"))

    def reader(self, schema) -> FileListingReader:
        pushes = _flag(self.options.get("pushDepth", "false"))
        return (DepthPushingReader if pushes else FileListingReader)(*self._walk())

    def streamReader(self, schema) -> FileChangesReader:
        get = self.options.get
        return FileChangesReader(*self._walk(), float(get("since", "0")), float(get("settle", "2")))


class FileListingReader(DataSourceReader):
    def __init__(self, roots: list[str], options: WalkOptions, wanted: int) -> None:
        self.roots, self.options, self.wanted = roots, options, wanted

    def partitions(self) -> Sequence[InputPartition]:
        """Open directories from the top until there are enough subtrees to hand out.

        Of an opened directory only the subdirectories are looked at here; its entries
        are listed by a task. Directories are dealt round in turn, so there are never many
        more partitions than wanted, however many directories have been found.
        """
        found = [row for root in self.roots if (row := open_root(root, self.options))]
        frontier = list(_subdirectories(found))
        opened: list[tuple[str, str, int]] = []
        while frontier and len(frontier) + len(opened) < self.wanted:
            level, frontier = frontier, []
            for at, directory in enumerate(level):
                opened.append(directory)
                frontier.extend(open_directory(*directory, self.options))
                if len(frontier) + len(level) - at - 1 + len(opened) >= self.wanted:
                    frontier.extend(level[at + 1 :])
                    break
        return [
            Rows(found),
            *(Directories(d, deep=False) for d in _dealt(opened, self.wanted)),
            *(Directories(d, deep=True) for d in _dealt(frontier, self.wanted)),
        ]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        match partition:
            case Rows(rows=rows):
                return _record_batches(rows)
            case Directories(directories=directories, deep=deep):
                listed = walk if deep else list_directory
                rows = (listed(*directory, self.options) for directory in directories)
                return _record_batches(chain.from_iterable(rows))
        raise TypeError(f"unknown partition {partition!r}")


def _dealt(directories: list, n: int) -> list[list]:
    return [directories[i::n] for i in range(min(n, len(directories)))]


class DepthPushingReader(FileListingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Depth limits stop the walk; Spark still applies every filter itself."""
        for pushed in filters:
            limit = None
            match pushed:
                case LessThanOrEqual(attribute=("depth",), value=value) | EqualTo(
                    attribute=("depth",), value=value
                ):
                    limit = value
                case LessThan(attribute=("depth",), value=value):
                    limit = value - 1
            if limit is not None and (self.options.max_depth < 0 or limit < self.options.max_depth):
                fields = asdict(self.options) | {"max_depth": max(limit, 0)}
                self.options = WalkOptions(**fields)
            yield pushed


@dataclass
class Changes(InputPartition):
    """A part of the tree, and the times of change (exclusive, inclusive) that are asked for."""

    part: InputPartition
    after: int
    until: int


class FileChangesReader(DataSourceStreamReader):
    """Files that have come or changed, a trigger at a time.

    An offset is a point in time, in nanoseconds, up to which changes have been taken; a
    trigger takes the files whose inode has changed since the offset before. The inode's time
    is also that of a file moved in with an old modification time, and nobody can set it. So
    every version of a file that is there at a trigger comes once; a restarted query asks for
    the same interval again, from its checkpoint, and what has changed once more in between
    comes with its new time instead. Nothing but two numbers is kept, however large the tree.

    ``since`` (seconds since 1970) leaves out what is older. The last ``settle`` seconds are
    left to the next trigger: clocks of file servers may be that far behind. Directories,
    links and errors are for the batch reader.
    """

    def __init__(
        self, roots: list[str], options: WalkOptions, wanted: int, since: float, settle: float
    ) -> None:
        self._reader = FileListingReader(roots, options, wanted)
        self._since, self._settle = int(since * 1e9), int(settle * 1e9)

    def initialOffset(self) -> dict:
        return {"until": self._since}

    def latestOffset(self) -> dict:
        return {"until": max(self._since, time.time_ns() - self._settle)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Changes(part, start["until"], end["until"]) for part in self._reader.partitions()]

    def commit(self, end: dict) -> None:
        """Nothing is held back for a replay: the tree itself is read again."""

    def read(self, partition: Changes) -> Iterator[pa.RecordBatch]:
        def changed(path: str) -> bool:
            try:
                return partition.after < os.lstat(path).st_ctime_ns <= partition.until
            except OSError:
                return False

        for batch in self._reader.read(partition.part):
            kinds, paths = (batch.column(c).to_pylist() for c in ("kind", "path"))
            kept = [k == "file" and changed(p) for k, p in zip(kinds, paths, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))


def register(spark: SparkSession) -> None:
    """Make ``file_listing`` known to the session."""
    spark.dataSource.register(FileListing)


def read_changes(
    spark: SparkSession,
    roots: Sequence[str],
    options: WalkOptions = WalkOptions(),
    *,
    since: float = 0,
    settle: float = 2,
) -> DataFrame:
    """The stream of files that come or change below the roots (``FileChangesReader``)."""
    register(spark)
    reader = _with_options(spark.readStream, spark, roots, options)
    return reader.options(since=since, settle=settle).load()


def read_listing(spark: SparkSession, roots: Sequence[str], options: WalkOptions = WalkOptions()) -> DataFrame:
    """The listing of several roots through the data source; overlaps are listed twice."""
    register(spark)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return _with_options(spark.read, spark, roots, options).option("pushDepth", pushes).load()


def _with_options(reader, spark: SparkSession, roots: Sequence[str], options: WalkOptions):
    """A batch or stream reader of the data source."""
    subtrees = min(4 * spark.sparkContext.defaultParallelism, MAX_SUBTREES)
    return (
        reader.format("file_listing")
        .option("numPartitions", subtrees)
        .option("paths", json.dumps(list(roots)))
        .option("maxDepth", options.max_depth)
        .option("maxFileSize", options.max_file_size)
        .option("skipSymlinks", str(options.skip_symlinks).lower())
        .option("skipHidden", str(options.skip_hidden).lower())
        .option("exclude", json.dumps(list(options.exclude)))
    )


def parts_of(rows: int, parallelism: int) -> int:
    """Tasks for looking up so many names: all cores, and more where there are very many."""
    return max(1, min(rows, max(4 * parallelism, rows // NAMES_PER_TASK)))


def list_tree(spark: SparkSession, roots: Sequence[str], options: WalkOptions = WalkOptions()) -> DataFrame:
    """The listing of several roots, one Spark job per level of the tree.

    A level's directories are spread over tasks, and so are the names found in them
    before they are looked up, the slow part; so neither a large subtree nor a single
    large directory holds up the rest. Every level is a written table: the loop only
    asks whether it has directories, and a lost executor costs its own tasks.
    """

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directories = (row for batch in batches for row in batch.to_pylist())
        names = (list_names(**directory, options=options) for directory in directories)
        yield from _record_batches(chain.from_iterable(names))

    def look_up_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns))
            yield from _record_batches(look_up(rows, options))

    found = [row for root in roots if (row := open_root(root, options))]
    level = spark.createDataFrame(found, LISTING)
    listing = level
    while True:
        directories = level.filter(F.col("kind") == "dir").select(
            "root", F.col("path").alias("directory"), "depth"
        )
        tasks = min(directories.count(), 4 * spark.sparkContext.defaultParallelism)
        if not tasks:
            return listing
        names = directories.repartition(tasks).mapInArrow(open_all, LISTING)
        # Looking a name up is the slow part: names are spread by number, not by bytes.
        found = stage(names, "names")
        tasks = parts_of(found.count(), spark.sparkContext.defaultParallelism)
        level = stage(found.repartition(tasks).mapInArrow(look_up_all, LISTING), "listing")
        listing = listing.unionByName(level)
