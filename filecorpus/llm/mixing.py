"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about ``BLOCK_CHARS`` characters. In a fluid mix all sources
that still have blocks are served at once, in proportion to their weights. A block may not
begin before the slot in which the fluid mix begins it, and must be over by the slot in which
the fluid mix ends it; serving the released block with the earliest deadline meets all
deadlines, since the fluid mix fills every slot exactly, and after any number of slots a
source has had what the fluid mix gives it to within one block. Weights are taken as exact
fractions, so this holds for any weights and any number of blocks.

When a source has no block left, the others share the stream in the proportions they had.
Nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecorpus.llm.common import parts, query, table, unused
from filecorpus.staging import stage

BLOCK_CHARS = 1 << 18
FLATTEN = 0.5
PART_ROWS = 100_000
PART_BYTES = 32 << 20


def block_slots(blocks: Sequence[int], weights: Sequence[float]) -> np.ndarray:
    """The slots of all blocks, source after source, for so many blocks of each (at least 1).

    Time ``v`` of the fluid mix is such that source ``i`` has had ``v * weights[i]`` blocks until
    it ends; with ``done`` blocks of ended sources and ``active`` weights of the others, that
    is slot ``done + active * v``. Ties go to the first source.
    """
    shares = [Fraction(w) for w in weights]
    scale = lcm(*(share.denominator for share in shares))
    whole = [int(share * scale) for share in shares]
    # Times as integers so fine that different fractions of weights stay different.
    fine = 2 * max(whole, default=0).bit_length()
    ends = [(n << fine) // w for n, w in zip(blocks, whole, strict=True)]
    order = sorted(range(len(ends)), key=ends.__getitem__)
    done = [0, *accumulate(blocks[i] for i in order)]
    total = sum(whole)
    active = [total - w for w in accumulate((whole[i] for i in order), initial=0)]
    ends.sort()

    def begun(i: int, k: int) -> int:
        j = bisect_right(ends, (k << fine) // whole[i])
        return done[j] + active[j] * k // whole[i]

    def over(i: int, k: int) -> int:
        j = bisect_right(ends, (k << fine) // whole[i])
        return done[j] - (-active[j] * k // whole[i])

    starts = [0, *accumulate(blocks)]
    slots = np.empty(starts[-1], np.int64)
    waiting, ready = [(0, i, 0) for i in range(len(blocks))], []  # by release, by deadline
    for slot in range(starts[-1]):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (over(i, k + 1), i, k))
        _, i, k = heapq.heappop(ready)
        slots[starts[i] + k] = slot
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, (begun(i, k + 1), i, k + 1))
    return slots


def assign_slots(
    rows: DataFrame, weights: Mapping[str, float] | None = None, *, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``number, block, slot, before`` for ``number, source, doc_id, size``.

    A source's rows are in ascending ``doc_id`` order (null first, ties by ``number``), and
    ``before`` is the size of those before; the block is the whole number of blocks in it.
    A null source is a source. ``weights`` gives targets by source (null by ``None``), and a
    source without one comes after all others. Without ``weights`` a source's share is in
    proportion to the power ``FLATTEN`` of its blocks.

    Only these numbers move. They are ordered in ranges, so a source with a third of all rows
    is in as many ranges as it needs. The driver gets one number a source, of which there may be
    any number, and makes the schedule, one number a block.
    """
    rows = stage(rows.select("number", "source", "doc_id", "size"), "sizes")
    ranged = stage(
        rows.repartitionByRange(parts(rows.count(), PART_ROWS), "source", "doc_id", "number").withColumn(
            "part", F.spark_partition_id()
        ),
        "ranges",
    )
    within = Window.partitionBy("part", "source")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part", "source")
        .agg(F.sum("size").alias("size"))
        .select("part", "source", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    )
    so_far = F.sum("size").over(
        within.orderBy("doc_id", "number").rowsBetween(Window.unboundedPreceding, -1)
    )
    same = [F.col("r.part") == F.col("o.part"), F.col("r.source").eqNullSafe(F.col("o.source"))]
    placed = stage(
        ranged.withColumn("so_far", F.coalesce(so_far, F.lit(0)))
        .alias("r")
        .join(offsets.alias("o"), same)
        .select("number", "r.source", (F.col("offset") + F.col("so_far")).alias("before"))
        .withColumn("block", F.floor(F.col("before") / block_chars)),
        "blocks",
    )
    found = placed.groupBy("source").agg((F.max("block") + 1).alias("n")).toArrow()
    blocks = dict(zip(*(found[c].to_pylist() for c in ("source", "n")), strict=True))
    held = rows.sparkSession.sparkContext.broadcast(_slots(blocks, weights))

    def slotted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, slots = held.value
        for frame in frames:
            source = frame["source"].astype(object).where(frame["source"].notna(), None)
            codes, names = pd.factorize(source, use_na_sentinel=False)
            start = np.array([starts[None if pd.isna(s) else s] for s in names], np.int64)
            slot = slots[start[codes] + frame["block"].to_numpy()]
            yield frame.assign(slot=slot)[["number", "block", "slot", "before"]]

    return placed.mapInPandas(slotted, "number long, block long, slot long, before long")


def _slots(
    blocks: Mapping[str | None, int], weights: Mapping[str | None, float] | None
) -> tuple[dict[str | None, int], np.ndarray]:
    """Where each source's blocks begin in the array of slots, and that."""
    if weights is None:
        weights = {s: n**FLATTEN for s, n in blocks.items()}
    # A null source has to sort with the others.
    names = sorted(blocks, key=lambda s: (s is not None, s or ""))
    wanted = [s for s in names if weights.get(s, 0) > 0]
    others = [s for s in names if not weights.get(s, 0) > 0]
    first = block_slots([blocks[s] for s in wanted], [weights[s] for s in wanted])
    last = block_slots([blocks[s] for s in others], [1] * len(others))
    names = wanted + others
    starts = dict(zip(names, accumulate((blocks[s] for s in names), initial=0)))
    return starts, np.concatenate([first, len(first) + last])


def sized(docs: DataFrame, number: Column) -> DataFrame:
    """``number, source, doc_id, size``; the size of a null text is 0."""
    return docs.select(
        number.alias("number"),
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
    )


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """All rows with the same columns, in the order of the mix from file to file and row to row.

    Needs ``doc_id, text, source``; see ``assign_slots``. Equal rows stay as many as they are.
    A null text has no size, a null id comes first in its source. Other columns may have any
    names. An empty table gives no row.
    """
    number, slot, before = (unused(c, docs.columns) for c in ("__number", "__slot", "__before"))
    rows = stage(docs.withColumn(number, F.monotonically_increasing_id()), "unmixed")
    slots = assign_slots(sized(rows, F.col(number)), weights, block_chars=block_chars).select(
        F.col("number").alias(number), F.col("slot").alias(slot), F.col("before").alias(before)
    )
    joined = rows.join(slots, number)
    chars = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    n = parts(rows.agg(chars).head()[0] or 0, PART_BYTES)
    order = [slot, before, number]
    return (
        joined.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select(*docs.columns)
    )


@query()
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block and slot of every document when sources are mixed by the root of their sizes."""
    docs = table(spark, sf_dir, "documents").withColumn("__number", F.monotonically_increasing_id())
    rows = stage(sized(docs, F.col("__number")), "documents")
    return rows.join(assign_slots(rows), "number").select(
        "doc_id", "source", F.col("size").alias("n_chars"), "block", "slot", "before"
    )
