"""File content: whole in a column, in pieces that cut no line or string, or digested.

Content of any size can be had: a file that is too large for a cell is read in ranges, each
a row of its own and each by whichever task gets it, and only its digest, which has to see
all bytes in order, is taken where the file is read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filecorpus.functions.content import (
    HASH_ALGORITHMS,
    MIN_STRING_LENGTH,
    content_lines,
    printable_runs,
)

# Content handed to Spark in one Arrow batch, and bytes of files read by one task.
BATCH_BYTES = 32 << 20
TASK_BYTES = 256 << 20
# Largest file that becomes one cell of a table: a task may hold a few copies of a cell at
# a time, as bytes, as text and as strings. Larger files are read in ranges of RANGE_BYTES.
CELL_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
RANGES_PER_TASK = 16
# Spark's limit for a value.
_MOST_BYTES = (1 << 31) - (1 << 20)
_BLOCK = 1 << 20

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
# What a read learns about a file; it replaces what the listing knew.
_STAT_FIELDS = [
    T.StructField("size", T.LongType()),
    T.StructField("mod_time", T.TimestampType()),
    T.StructField("mode", T.IntegerType()),
]


def spread_by_bytes(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Spread files over tasks of about as many bytes each.

    The listing is thin, so this moves paths, not content. Files come in the order of their
    sizes in ranges of equal weight, so large files do not meet in a task by chance: a file's
    weight is its bytes, or a small constant, as opening one has a price too.
    """
    weight = F.greatest(F.coalesce("size", F.lit(0)), F.lit(task_bytes // 4096))
    total, count = files.agg(F.sum(weight), F.count(F.lit(1))).first()
    if not count:
        return files
    parallelism = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(total // task_bytes + 1, min(count, parallelism))
    each = max(total // tasks, 1)
    # Files of one power of two share tasks by hash, as many tasks as the class weighs.
    kind = F.floor(F.log2(weight)).cast("int")
    classes = files.groupBy(kind.alias("kind")).agg(F.sum(weight).alias("weight")).collect()
    shares = {k: max(-(-w // each), 1) for k, w in classes}
    first, at = {}, 0
    for k in sorted(shares):
        first[k], at = at, at + shares[k]
    table = F.create_map(
        *(F.lit(x) for k in shares for x in (k, f"{first[k]},{shares[k]}"))
    )
    place = F.split(table[kind], ",")
    share = F.pmod(F.xxhash64("path"), place[1].cast("long"))
    dealt = files.withColumn("_task", (place[0].cast("long") + share).cast("int"))
    return dealt.repartitionById(at, "_task").drop("_task")


def _failure(step: str, call: str, path: str, cause: OSError) -> str:
    return f"{step} error: {call} {path}: {(cause.strerror or str(cause)).lower()}"


def _stat(path: str) -> tuple[tuple, str | None]:
    """(size, mod_time, mode) and the error, if any."""
    try:
        info = os.stat(path)
    except OSError as cause:
        return (None, None, None), _failure("stat", "stat", path, cause)
    time = _EPOCH + dt.timedelta(microseconds=info.st_mtime_ns // 1000)
    return (info.st_size, time, info.st_mode & 0o7777), None


def _replace_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {name: batch.column(name) for name in batch.schema.names}
    return pa.RecordBatch.from_pydict(kept | columns)


def _stat_columns(stats: list[tuple]) -> dict[str, pa.Array]:
    size, time, mode = zip(*stats)
    return {
        "size": pa.array(size, pa.int64()),
        "mod_time": pa.array(time, pa.timestamp("us", tz="UTC")),
        "mode": pa.array(mode, pa.int32()),
    }


def _output_schema(files: DataFrame, *extra: T.StructField) -> T.StructType:
    fields = {f.name: f for f in files.schema.fields}
    fields |= {f.name: f for f in (*_STAT_FIELDS, *extra)}
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])


def read_content(files: DataFrame, max_size: int | None = None, max_bytes: int = 0) -> DataFrame:
    """Adds ``content`` and ``error`` to rows with a ``path``, with a fresh stat.

    A file that cannot be read gives a row with an error. Files above ``max_size`` keep
    NULL content and are not opened; with ``max_bytes > 0`` only that many bytes of each
    file leave the disk. What is larger than ``CELL_BYTES`` is an error here; lines, strings
    and digests of such files come from :func:`lines_of_files`, :func:`strings_of_files`
    and :func:`digest_files`.
    """

    def read(path: str, size: int) -> tuple[bytes | None, str | None]:
        if max_size is not None and size > max_size:
            return None, None
        if (min(size, max_bytes) if max_bytes > 0 else size) > CELL_BYTES:
            return None, f"read error: {path}: more than {CELL_BYTES} bytes for one cell"
        try:
            with open(path, "rb") as file:
                return file.read(max_bytes if max_bytes > 0 else -1), None
        except OSError as cause:
            return None, _failure("open", "open", path, cause)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, stats, contents, errors = 0, 0, [], [], []
            paths = batch.column("path").to_pylist()
            for at, path in enumerate(paths, 1):
                stat_values, error = _stat(path)
                content = None
                if error is None:
                    content, error = read(path, stat_values[0])
                stats.append(stat_values)
                contents.append(content)
                errors.append(error)
                held += len(content or b"")
                if held >= BATCH_BYTES or at == len(paths):
                    columns = _stat_columns(stats) | {
                        "content": pa.array(contents, pa.binary()),
                        "error": pa.array(errors, pa.string()),
                    }
                    yield _replace_columns(batch.slice(start, at - start), columns)
                    start, held, stats, contents, errors = at, 0, [], [], []

    schema = _output_schema(
        files,
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    )
    return files.mapInArrow(read_all, schema)


def digest_files(files: DataFrame, algorithm: str, max_size: int | None = None) -> DataFrame:
    """Adds ``hash`` and ``error`` for files of any size, with a fresh stat.

    Files that turn out to be above ``max_size`` are refused.
    """
    if algorithm not in HASH_ALGORITHMS:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")

    def digest_one(path: str) -> tuple[tuple, str | None, str | None]:
        stat_values, error = _stat(path)
        if error is None and max_size is not None and stat_values[0] > max_size:
            error = f"file too large ({stat_values[0]} bytes)"
        if error is None:
            try:
                with open(path, "rb") as file:
                    return stat_values, hashlib.file_digest(file, algorithm).hexdigest(), None
            except OSError as cause:
                error = _failure("open", "open", path, cause)
        return stat_values, None, error

    def digest_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_one(path) for path in batch.column("path").to_pylist()]
            if found:
                stats, digests, errors = zip(*found)
                columns = _stat_columns(list(stats)) | {
                    "hash": pa.array(digests, pa.string()),
                    "error": pa.array(errors, pa.string()),
                }
                yield _replace_columns(batch, columns)

    schema = _output_schema(
        files, T.StructField("hash", T.StringType()), T.StructField("error", T.StringType())
    )
    return files.mapInArrow(digest_all, schema)


def _find(file, separator: re.Pattern, at: int, end: int | None) -> int | None:
    """Place after the first separator (one byte) from ``at`` and before ``end``, or None."""
    file.seek(at)
    while block := file.read(_BLOCK if end is None else max(min(_BLOCK, end - at), 0)):
        if found := separator.search(block):
            return at + found.end()
        at += len(block)
    return None


def _read_on(file, separator: re.Pattern, n: int) -> tuple[bytes | None, int]:
    """The next ``n`` bytes and what follows to the separator after them, and how many.

    What is too long for a value is only counted.
    """
    blocks = [file.read(n)]
    total = len(blocks[0])
    found = separator.match(blocks[0][-1:])
    while not found and (block := file.read(_BLOCK)):
        if found := separator.search(block):
            block = block[: found.end()]
        total += len(block)
        if total > _MOST_BYTES:
            blocks.clear()
        else:
            blocks.append(block)
    if total > _MOST_BYTES:
        return None, total
    return blocks[0] if len(blocks) == 1 else b"".join(blocks), total


def _piece(path: str, start: int, end: int | None, separator: re.Pattern | None) -> tuple:
    """(content, last, error) of a range: from the separator before it to the one at its end.

    Where a piece begins is looked for inside its range alone, and only the piece that holds
    the end of a range reads on from there. So no byte is read more than twice, however far
    separators are apart.
    """
    with open(path, "rb") as file:
        size = os.fstat(file.fileno()).st_size
        begin = start
        if separator is not None and start:
            begin = _find(file, separator, start - 1, None if end is None else end - 1)
            # No separator in the range: it is inside what an earlier range ends with.
            if begin is None:
                return b"", False, None
        file.seek(begin)
        if separator is not None and end is not None and end < size:
            content, n = _read_on(file, separator, min(end - begin, _MOST_BYTES + 1))
        else:
            n = (size if end is None else end) - begin
            content = file.read(n) if n <= _MOST_BYTES else None
        if content is None:
            error = f"read error: {path}: {n} bytes without a break from byte {begin}"
            return None, False, error
        return content, begin + n >= size, None


_PIECES = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("content", pa.binary()),
        ("last", pa.bool_()),
        ("error", pa.string()),
    ]
)


def read_pieces(
    files: DataFrame, separator: bytes | None, range_bytes: int | None = None
) -> DataFrame:
    """``path, start, content, last, error``: files of any size in pieces of about a range.

    ``separator`` is a regex for one byte: pieces end after such a byte, so what stands
    between two of them is never cut. Without one, ranges are exact. Every range is read by
    itself; ``last`` is set on the piece that ends the file.
    """
    each = range_bytes or RANGE_BYTES
    last = F.greatest(F.floor((F.col("size") - 1) / each), F.lit(0))
    numbers = F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0)))
    ranges = files.select("path", "size", F.explode(numbers).alias("_n")).select(
        "path",
        (F.col("_n") * each).alias("start"),
        # A file of unknown size is one range; the last one goes to the end, wherever it is.
        F.when(F.col("_n") < last, (F.col("_n") + 1) * each).alias("end"),
    )
    pattern = None if separator is None else re.compile(separator)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    found = _piece(path, start, end, pattern)
                except OSError as cause:
                    found = None, False, _failure("open", "open", path, cause)
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_PIECES.names, (path, start, *found)))], _PIECES
                )

    # Thin rows would be coalesced into one task if their number were left to Spark.
    n = ranges.count()
    parallelism = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(2 * parallelism, n // RANGES_PER_TASK)))
    dealt = ranges.select("path", "start", "end").repartition(tasks, "path", "start")
    return dealt.mapInArrow(
        read_all, "path string, start long, content binary, last boolean, error string"
    )


def lines_of_files(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """``path, line_no, line, error`` for files of any size, as ``file_lines`` has them.

    A file that cannot be read gives one row with an error. Lines are numbered from the
    line ends before each piece; those are counted in a pass of its own, so that only
    numbers move.
    """
    pieces = read_pieces(files, rb"\n", range_bytes)
    ends = F.when(F.octet_length("content") == 0, 0).otherwise(
        F.size(F.split(F.col("content").cast("string"), "\n", -1)) - 1
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.filter("error is null").groupBy("path", "start").agg(F.max(ends).alias("n"))
    bases = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    lines = content_lines(F.col("content"))
    # What follows the last line end of a piece is the next piece's first line.
    whole = F.when(F.col("last"), lines).otherwise(
        F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    )
    kept = pieces.filter("error is null").select("path", "start", F.posexplode(whole).alias("pos", "line"))
    numbered = kept.join(bases, ["path", "start"]).select(
        "path", (F.col("base") + F.col("pos")).alias("line_no"), "line", F.lit(None).cast("string").alias("error")
    )
    return numbered.unionByName(read_errors(pieces), allowMissingColumns=True)


def read_errors(pieces: DataFrame) -> DataFrame:
    """``path, error`` once for each file that could not be read."""
    return pieces.filter("error is not null").groupBy("path").agg(F.min("error").alias("error"))


def strings_of_files(
    files: DataFrame,
    min_length: int = MIN_STRING_LENGTH,
    block: int = 0,
    range_bytes: int | None = None,
) -> DataFrame:
    """``path, at, string, error``: each distinct string of files of any size, once a file.

    ``at`` orders a file's strings as they first come up. The expression is that of files in
    a cell: pieces end outside of printable runs, or, with ``block``, at multiples of it. A
    file that cannot be read gives one row with an error.
    """
    each = range_bytes or RANGE_BYTES
    if block > 0:
        pieces = read_pieces(files, None, max(each // block, 1) * block)
    else:
        pieces = read_pieces(files, rb"[^\x20-\x7E]", each)
    runs = F.posexplode(printable_runs(F.col("content"), min_length, block))
    found = (
        pieces.filter("error is null")
        .select("path", "start", runs.alias("pos", "string"))
        .groupBy("path", "string")
        .agg(F.min(F.struct("start", "pos")).alias("at"))
    )
    return found.unionByName(read_errors(pieces), allowMissingColumns=True)
