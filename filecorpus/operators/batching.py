"""Batches of JSON records with a dense, ordered numbering."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecorpus.functions.records import json_record
from filecorpus.staging import stage

# Fixed value: default number of records per batch.
BATCH_SIZE = 100


def with_row_index(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``idx`` = 0, 1, 2, … in the given order, without ever using one partition.

    The order should tell rows apart, as rows that are equal in it share a partition.
    The rows are range-partitioned, sorted and written once, together with their
    partition and position; after that the numbering cannot shift, even if a task has
    to run again. Only one count per partition comes to the driver.
    """
    spark = rows.sparkSession
    # monotonically_increasing_id is (partition << 33) + position in the partition.
    placed = stage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ordered",
    )
    part, position = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame(
        [(p, start) for (p, _), start in zip(counts, starts)], "_part long, _offset long"
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("idx", F.col("_offset") + position)
        .drop("_mid", "_part", "_offset")
    )


def assemble_batches(
    rows: DataFrame,
    order: Sequence[str],
    batch_size: int = BATCH_SIZE,
    record: Column | None = None,
) -> DataFrame:
    """``batch_id, n_items, payload`` from rows, in the given order.

    Every batch but the last is full; a size of one or less gives one record per batch
    and no rows give no batch. The payload is a JSON array of the records, by default
    those of fingerprint rows; they are made after the rows are in place, so only once.
    A group is never larger than a batch.
    """
    size = max(batch_size, 1)
    record = json_record() if record is None else record
    numbered = with_row_index(rows, order).select("idx", record.alias("record"))
    grouped = numbered.groupBy(F.expr(f"idx div {size}").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sort_array(F.collect_list(F.struct("idx", "record"))).alias("_items"),
    )
    payload = F.concat(
        F.lit("["), F.array_join(F.transform("_items", lambda item: item["record"]), ","), F.lit("]")
    )
    return grouped.select("batch_id", "n_items", payload.alias("payload"))
