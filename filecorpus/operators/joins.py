"""Equi-joins that hold up against hot keys and against large lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup table up to this size is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
# Pieces a hot key is spread over; a key with fewer rows has fewer. A power of two.
SALTS = 512


def salt_of(*columns: Column | str) -> Column:
    """A piece number below ``SALTS`` from the row's own values.

    It is never NULL, and Spark knows it, so a join on it adds no filter to one side
    only; that would keep the two sides of a self-join from sharing their shuffle.
    """
    return F.xxhash64(*columns).bitwiseAND(F.lit(SALTS - 1))


def table_bytes(df: DataFrame) -> int:
    """Upper estimate of the bytes held by the rows of a flat table."""
    per_row = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            per_row = per_row + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.sum(per_row.cast("long"))).first()[0] or 0


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    salt_on: list[str],
    small: bool,
) -> DataFrame:
    """Join many rows with a smaller table; ``small`` is the outcome of a size check.

    A small lookup table is broadcast and the rows do not move. Otherwise the rows move
    once, to (key, salt), so that a key that holds a third of them is spread over all
    salts; and a lookup row goes to just those salts at which its key really occurs,
    which every task sums up before anything moves.
    """
    if small:
        return rows.join(F.broadcast(lookup), key)
    # Too large to broadcast by our own measure, so the planner shall not try either.
    salted = rows.withColumn("_salt", salt_of(*salt_on)).hint("merge")
    pieces = salted.select(key, "_salt").distinct().hint("merge").join(lookup, key)
    return salted.join(pieces, [key, "_salt"]).drop("_salt")
