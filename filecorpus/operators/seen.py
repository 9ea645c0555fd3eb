"""Keys of the files accepted so far, in a table that is never moved or rewritten.

The table is cut into hash buckets of the key. A batch is reduced to one row per key and those
rows go to the buckets; the table is read where it lies, and an append adds one file a bucket.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.operators.dedup import KEEP_ORDER, dedup_key, first_per_key
from filecorpus.operators.filters import without_errors
from filecorpus.operators.joins import lookup_join
from filecorpus.staging import Folders, stage

# The number of buckets of a new table; some 100 MB of keys in each is a good size.
BUCKETS = 64


class SeenKeys:
    """A table ``key, path, batch`` below ``folder``: each key once, and the file that is kept for it.

    A folder that already holds one is carried on with, whatever ``buckets`` says. Batches are
    accepted one after the other, by one driver at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self._spark, self.folder = spark, folder.rstrip("/")
        self.buckets = self._made() or buckets
        self.name = "seen_keys_" + hashlib.sha256(self.folder.encode()).hexdigest()[:32]
        self._create()

    def _made(self) -> int | None:
        """The number of buckets of the table in the folder; it is part of the table's path."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return next((int(n.removeprefix("buckets-")) for n in names if n.startswith("buckets-")), None)

    def _create(self) -> None:
        location = f"{self.folder}/buckets-{self.buckets}".replace("\\", "\\\\").replace("'", "\\'")
        self._spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._spark.sql(
            f"CREATE TABLE {self.name} (key STRING, path STRING, batch STRING) USING parquet "
            f"CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def keys(self, spark: SparkSession | None = None) -> DataFrame:
        """``key, path, batch`` of all accepted keys."""
        spark = spark or self._spark
        # Another session (that of a stream's batch) may have appended.
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name)

    def unseen(self, fingerprints: DataFrame, by: str = "hash", batch: str | None = None) -> DataFrame:
        """Rows without errors, one per key, whose key no other batch has brought; with their ``key``."""
        fresh = first_per_key(without_errors(fingerprints), dedup_key(by), KEEP_ORDER)
        fresh = fresh.withColumn("key", dedup_key(by)).repartition(self.buckets, "key")
        earlier = self.keys(fingerprints.sparkSession)
        if batch is not None:
            earlier = earlier.filter(F.col("batch") != batch)
        return fresh.join(earlier.select("key"), "key", "left_anti")

    def accept(self, fingerprints: DataFrame, batch: str, by: str = "hash") -> DataFrame:
        """The rows of ``unseen``; their keys are in the table from then on.

        ``batch`` names the batch. Accepting it again, as after a failure, gives the same rows
        and adds no key twice.
        """
        fresh = stage(self.unseen(fingerprints, by, batch), "fresh")
        own = self.keys(fingerprints.sparkSession).filter(F.col("batch") == batch).select("key")
        added = fresh.select("key", "path", F.lit(batch).alias("batch"))
        added = added.repartition(self.buckets, "key").join(own, "key", "left_anti")
        # An insert goes by position.
        added.select("key", "path", "batch").write.insertInto(self.name)
        return fresh.drop("key")

    def suppressed(self, fingerprints: DataFrame, batch: str, by: str = "hash") -> DataFrame:
        """What an accepted batch lost: ``key, path, kept_path, copies``.

        ``copies`` counts the filtered rows of that path; the kept file of the batch itself is
        not one of them. Rows meet their keepers on (key, salt), so a hot key is spread out.
        """
        rows = without_errors(fingerprints).select(dedup_key(by).alias("key"), "path")
        keepers = self.keys(fingerprints.sparkSession).select(
            "key", F.col("path").alias("kept_path"), (F.col("batch") == batch).alias("own")
        )
        found = lookup_join(rows, keepers, "key", ["path"], small=False)
        kept = (F.col("own") & F.col("path").eqNullSafe(F.col("kept_path"))).cast("long")
        counted = found.groupBy("key", "path", "kept_path", "own").agg(F.count(F.lit(1)).alias("n"))
        copies = (F.col("n") - kept).alias("copies")
        return counted.select("key", "path", "kept_path", copies).filter("copies > 0")

    def reset(self) -> None:
        """Forget all keys; the files of the table are deleted."""
        self._spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        Folders(self._spark, [f"{self.folder}/buckets-{self.buckets}"]).remove()
        self._create()
