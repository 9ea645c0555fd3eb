"""Files through Spark's ``binaryFile`` source, for storage that is not mounted.

It reads any file system Spark knows and streams new files, but it is not a faithful
lister: it leaves out ``_x`` next to ``.x`` names and files of length zero, follows links
inside directories, and knows no mode bits. A file above Spark's limit for a value has no
content and an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.functions.paths import base_name, parent_path, path_under_root

MOST_BYTES = (1 << 31) - (1 << 20)
_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def binary_files(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Listing columns and ``content`` of the files below ``root``, or a stream of new ones.

    Filters on ``size`` and ``mod_time`` reach the source, and the content is read only
    by queries that use it.
    """
    reader = spark.readStream if stream else spark.read
    files = (
        reader.format("binaryFile")
        .schema(_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    if not stream:
        # The filters reach the source, so what is too large is not opened.
        large = files.filter(F.col("length") > MOST_BYTES).withColumn(
            "content", F.lit(None).cast("binary")
        )
        files = files.filter(F.col("length") <= MOST_BYTES).unionByName(large)
    root = root.rstrip("/") or "/"
    # Spark gives full addresses; without a scheme in the root only their paths count.
    address = "file:(//)?" if "://" in root else "[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    path = F.regexp_replace("path", f"^{address}(?=/)", "")
    listed = files.select(
        F.lit(root).alias("root"),
        path.alias("path"),
        parent_path(path).alias("parent"),
        base_name(path).alias("name"),
        F.lit("file").alias("kind"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mod_time"),
        F.lit(None).cast("int").alias("mode"),
        "content",
        F.when(F.col("length") > MOST_BYTES, F.lit("read error: too large for a value")).alias("error"),
    )
    depth = F.size(F.split(path_under_root("path", "root"), "/")) - 1
    return listed.withColumn("depth", depth)
