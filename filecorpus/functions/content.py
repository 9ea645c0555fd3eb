"""Expressions over file content (a BINARY column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The supported hash algorithms.
HASH_ALGORITHMS = ("md5", "sha1", "sha256", "sha512")
# Fixed value: default minimum length of a printable string.
MIN_STRING_LENGTH = 4


def content_hash(content: Column, algorithm: str) -> Column:
    """Lower-case hex digest; NULL for an algorithm that is not supported."""
    match algorithm:
        case "md5":
            return F.md5(content)
        case "sha1":
            return F.sha1(content)
        case "sha256":
            return F.sha2(content, 256)
        case "sha512":
            return F.sha2(content, 512)
    return F.lit(None).cast("string")


def _runs(content: Column, min_length: int) -> Column:
    # Read as UTF-8, bytes outside ASCII become other characters, valid sequence or not,
    # and never take an ASCII byte along; so a run of characters in this range is exactly
    # a run of printable bytes.
    runs = F.lit(rf"[\x20-\x7E]{{{max(min_length, 1)},}}")
    return F.regexp_extract_all(content.cast("string"), runs, 0)


def printable_runs(content: Column, min_length: int = MIN_STRING_LENGTH, block: int = 0) -> Column:
    """All runs of printable ASCII bytes, in order, repeats included.

    With ``block > 0`` runs are also cut at every multiple of that many bytes.
    """
    if block <= 0:
        return _runs(content, min_length)
    blocks = F.sequence(
        F.lit(0), F.greatest(F.ceil(F.octet_length(content) / block).cast("int") - 1, F.lit(0))
    )
    return F.flatten(
        F.transform(
            blocks,
            lambda i: _runs(F.substring(content, i * block + 1, F.lit(block)), min_length),
        )
    )


def printable_strings(
    content: Column,
    min_length: int = MIN_STRING_LENGTH,
    block: int = 0,
    max_strings: int | None = None,
) -> Column:
    """Distinct printable strings in first-seen order, all or the first ``max_strings``."""
    strings = F.array_distinct(printable_runs(content, min_length, block))
    return strings if max_strings is None else F.slice(strings, 1, max_strings)


def content_prefix(content: Column, max_bytes: int) -> Column:
    """The first ``max_bytes`` bytes; all of them if the limit is zero or negative."""
    return content if max_bytes <= 0 else F.substring(content, 1, max_bytes)


def content_lines(content: Column) -> Column:
    """Lines as an array: ``\\r\\n`` and ``\\n`` end a line, a lone ``\\r`` does not.

    A final line end gives a last empty line; empty content gives no line.
    """
    text = content.cast("string")
    return F.when(F.octet_length(content) == 0, F.array().cast("array<string>")).otherwise(
        F.split(text, "\r?\n", -1)
    )
