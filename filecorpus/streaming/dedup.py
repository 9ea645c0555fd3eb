"""Duplicate removal over a stream of fingerprint rows.

The keys seen so far live in the checkpointed state of the query, so a key of an earlier
batch suppresses later ones, across restarts too. A new checkpoint folder is a reset.
With ``write_unique_by_table`` they live in a table of keys instead, which batch jobs and
other streams can go on with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filecorpus.operators.dedup import dedup_key
from filecorpus.operators.filters import without_errors
from filecorpus.operators.joins import salt_of
from filecorpus.operators.seen import SeenKeys
from filecorpus.staging import Folders

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicate_stream(fingerprints: DataFrame, by: str = "hash", within: str | None = None) -> DataFrame:
    """Rows without errors whose key comes up for the first time.

    Repeats are removed per (key, salt) first, so a hot key is spread over tasks and only
    one row per salt, ever, reaches the second step. With ``within`` (as ``"7 days"``)
    keys are forgotten that long after they have arrived; the time of arrival counts, as
    files do not come in the order of their modification. Without it the result is exact
    and the state grows with the number of keys.
    """
    rows = without_errors(fingerprints).withColumn("_key", dedup_key(by))
    rows = rows.withColumn("_salt", salt_of("path"))
    if within is None:
        unique = rows.dropDuplicates(["_key", "_salt"]).dropDuplicates(["_key"])
    else:
        unique = (
            rows.withColumn("_arrived", F.current_timestamp())
            .withWatermark("_arrived", within)
            .dropDuplicatesWithinWatermark(["_key", "_salt"])
            .dropDuplicatesWithinWatermark(["_key"])
            .drop("_arrived")
        )
    return unique.drop("_key", "_salt")


def write_unique(
    stream: DataFrame, output: str, checkpoint: str, by: str = "hash", within: str | None = None
) -> StreamingQuery:
    """Start a query that appends unique rows to a parquet table until the input is used up.

    State goes to RocksDB on the executors' disks, as it may outgrow their heap; a query
    takes the setting over when it starts, so the session gets its own back afterwards.
    """
    spark = stream.sparkSession
    unique = deduplicate_stream(stream, by, within)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return (
            unique.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(output)
        )
    finally:
        spark.conf.set(STATE_STORE, before)


def write_unique_by_table(
    stream: DataFrame, output: str, checkpoint: str, seen: SeenKeys, by: str = "hash"
) -> StreamingQuery:
    """Start a query that writes the unique rows of each batch, until the input is used up.

    A key is held once, by the table; of a batch the smallest path is kept. Rows go to
    ``output/batch=n``, and the files that lost to them, as ``SeenKeys.suppressed`` gives
    them, to ``output-suppressed/batch=n``. A batch that runs again after a failure writes
    the same rows to the same place.
    """

    def one(rows: DataFrame, number: int) -> None:
        name = f"{checkpoint}#{number}"
        with Folders(rows.sparkSession) as staged:
            unique = seen.accept(rows, name, by)
            unique.write.mode("overwrite").parquet(f"{output}/batch={number}")
            lost = seen.suppressed(rows, name, by)
            lost.write.mode("overwrite").parquet(f"{output}-suppressed/batch={number}")
        staged.remove()

    return (
        stream.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
