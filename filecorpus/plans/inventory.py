"""The whole job: list, filter, fingerprint, remove duplicates, batch, deliver, sum up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecorpus.functions.content import HASH_ALGORITHMS, MIN_STRING_LENGTH
from filecorpus.functions.paths import base_name, is_executable
from filecorpus.operators.batching import BATCH_SIZE, assemble_batches
from filecorpus.operators.dedup import dedup_key, dedup_summary, deduplicate
from filecorpus.operators.filters import regular_files, scan_errors
from filecorpus.operators.fingerprint import fingerprint
from filecorpus.schema import FINGERPRINT
from filecorpus.sinks.delivery import MAX_RETRIES, Send, deliver_batches, delivery_errors
from filecorpus.sources.content import (
    CELL_BYTES,
    digest_files,
    read_content,
    spread_by_bytes,
    strings_of_files,
)
from filecorpus.sources.listing import WalkOptions, list_tree
from filecorpus.staging import Folders, stage

# Most bytes of one large file's strings that become a cell of its record.
STRINGS_BYTES = 256 << 20


@dataclass(frozen=True)
class FingerprintOptions:
    """How files are fingerprinted.

    A file above ``max_size``, if one is given, is not read: its row has an error and counts
    among the errors. ``max_strings`` keeps the first strings of a file only. A file whose
    strings are more than ``STRINGS_BYTES`` in all has an error instead.
    """

    algorithm: str = "sha256"
    extract_strings: bool = False
    min_length: int = MIN_STRING_LENGTH
    max_size: int | None = None
    string_block: int = 0
    max_strings: int | None = None


@dataclass(frozen=True)
class Inventory:
    """The tables a run leaves behind, and its one-row summary.

    They are read from folders of the run below the staging folder, which ``clean_up``
    removes when they are no longer needed.
    """

    fingerprints: DataFrame
    unique: DataFrame
    batches: DataFrame
    scan_errors: DataFrame
    delivery_log: DataFrame | None
    summary: DataFrame
    folders: Folders = field(repr=False)

    def clean_up(self) -> None:
        self.folders.remove()


def fingerprint_files(files: DataFrame, options: FingerprintOptions = FingerprintOptions()) -> DataFrame:
    """Fingerprint rows of listed files.

    Content of ordinary files goes through Spark's own hash and string expressions. Files
    that are too large for a cell are digested where they are read; their strings come from
    the same expression over pieces of them.
    """
    algorithm = options.algorithm.lower()
    limit = options.max_size
    files = files.select("path", "size", "mod_time", "mode")

    def through_cells(files: DataFrame) -> DataFrame:
        return fingerprint(
            read_content(spread_by_bytes(files), max_size=limit),
            algorithm=algorithm,
            extract_strings=options.extract_strings,
            min_length=options.min_length,
            max_size=limit,
            string_block=options.string_block,
            max_strings=options.max_strings,
        )

    if algorithm not in HASH_ALGORITHMS or (limit is not None and limit <= CELL_BYTES):
        return through_cells(files)
    # A file of unknown size may be large; a large one that is refused is not opened.
    is_large = F.coalesce(F.col("size") > CELL_BYTES, F.lit(True))
    if limit is not None:
        is_large = is_large & F.coalesce(F.col("size") <= limit, F.lit(True))
    large = files.filter(is_large)
    digested = digest_files(spread_by_bytes(large), algorithm, limit)
    if options.extract_strings:
        digested = digested.join(_string_arrays(large, options), "path", "left")
        error = F.coalesce("error", "string_error")
        strings = F.when(error.isNull(), F.coalesce("strings", F.array().cast("array<string>")))
    else:
        strings, error = F.lit(None), F.col("error")
    derived = {
        "name": base_name("path"),
        "size": F.coalesce("size", F.lit(0)),
        "hash_algorithm": F.lit(algorithm),
        "mime_type": F.lit(None),
        "strings": strings,
        "error": error,
        "is_executable": F.coalesce(is_executable("mode"), F.lit(False)),
        "processed_at": F.current_timestamp(),
    }
    digested = digested.select(
        [derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in FINGERPRINT]
    )
    return through_cells(files.filter(~is_large)).unionByName(digested)


def _string_arrays(files: DataFrame, options: FingerprintOptions) -> DataFrame:
    """``path, strings, string_error`` of large files; a record holds all strings of its file.

    Strings of more than ``STRINGS_BYTES`` in all are no cell: their file has an error, and
    ``strings_of_files`` gives them as rows. With ``max_strings`` only the first ones count.
    """
    paths = files.groupBy("path").agg(F.max("size").alias("size"))
    found = strings_of_files(paths, options.min_length, options.string_block)
    if options.max_strings is not None:
        first = Window.partitionBy("path").orderBy("at")
        found = found.withColumn("_n", F.row_number().over(first))
        found = found.filter(F.col("_n") <= options.max_strings).drop("_n")
    # Measured before any are brought together, and the files are read once.
    found = stage(found, "strings")
    held = F.sum(F.octet_length("string") + 8)
    sizes = found.groupBy("path").agg(held.alias("bytes"), F.max("error").alias("string_error"))
    too_many = F.coalesce(F.col("bytes") > STRINGS_BYTES, F.lit(False))
    listed = F.sort_array(F.collect_list(F.when(F.col("error").isNull(), F.struct("at", "string"))))
    strings = (
        found.join(sizes.filter(~too_many).select("path"), "path", "left_semi")
        .groupBy("path")
        .agg(F.transform(listed, lambda item: item["string"]).alias("strings"))
    )
    message = F.format_string("strings error: %s: %d bytes of strings for one cell", "path", "bytes")
    return sizes.join(strings, "path", "left").select(
        "path", "strings", F.coalesce("string_error", F.when(too_many, message)).alias("string_error")
    )


def summarize(fingerprints: DataFrame, errors: DataFrame, log: DataFrame | None) -> DataFrame:
    """One row: the duplicate counts, ``scan_errors`` and ``delivery_errors``."""
    counts = dedup_summary(fingerprints)
    scans = errors.agg(F.count(F.lit(1)).alias("scan_errors"))
    parts = counts.unionByName(scans, allowMissingColumns=True)
    if log is not None:
        parts = parts.unionByName(delivery_errors(log), allowMissingColumns=True)
    # Each part is one row with its own columns set.
    names = [*counts.columns, "scan_errors"]
    failed = F.max("delivery_errors") if log is not None else F.lit(0)
    return parts.agg(
        *[F.max(name).alias(name) for name in names],
        failed.cast("bigint").alias("delivery_errors"),
    )


def inventory_of(
    listing: DataFrame,
    options: FingerprintOptions = FingerprintOptions(),
    send: Send | None = None,
    batch_size: int = BATCH_SIZE,
    max_retries: int = MAX_RETRIES,
    max_senders: int | None = None,
) -> Inventory:
    """The job from a listing on, which may be any table with the columns of one.

    If it has a ``content`` column, that is fingerprinted, and else the files themselves.
    The fingerprints are written before anything is derived from them: every file is
    read once, and a lost executor does not make the job read them again.
    """
    with Folders(listing.sparkSession) as folders:
        files = regular_files(listing)
        if "content" in listing.columns:
            rows = fingerprint(
                files,
                options.algorithm,
                options.extract_strings,
                options.min_length,
                options.max_size,
                options.string_block,
                options.max_strings,
            )
        else:
            rows = fingerprint_files(files, options)
        fingerprints = stage(rows, "fingerprints")
        unique = deduplicate(fingerprints)
        batches = assemble_batches(unique.withColumn("key", dedup_key()), ["key", "path"], batch_size)
        log = None
        if send is not None:
            log = deliver_batches(batches, send, max_retries, max_senders)
    errors = scan_errors(listing)
    summary = summarize(fingerprints, errors, log)
    return Inventory(fingerprints, unique, batches, errors, log, summary, folders)


def run_inventory(
    spark: SparkSession,
    roots: Sequence[str],
    walk: WalkOptions = WalkOptions(),
    options: FingerprintOptions = FingerprintOptions(),
    send: Send | None = None,
    batch_size: int = BATCH_SIZE,
    max_retries: int = MAX_RETRIES,
    max_senders: int | None = None,
    max_size: int | None = None,
) -> Inventory:
    """Run the job over file trees; ``send`` delivers the unique records in batches.

    There is no limit to the size of files unless ``max_size`` (or the one in ``options``)
    gives one: files above it are rows with an error, and counted.
    """
    if max_size is not None:
        options = replace(options, max_size=max_size)
    with Folders(spark) as folders:
        listing = list_tree(spark, roots, walk)
    result = inventory_of(listing, options, send, batch_size, max_retries, max_senders)
    return replace(result, folders=folders.joined(result.folders))
