"""Written tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder(application_id: str) -> str:
    folder = tempfile.mkdtemp(prefix="filecorpus-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def staging_folder(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, or what was set by code.

    Without either a folder of our own stands in, which goes when the driver ends, but only
    in local mode, where driver and executors share one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(context.applicationId)


_open: ContextVar[tuple[Folders, ...]] = ContextVar("open", default=())


class Folders:
    """The folders made while it is open as a context; ``remove`` deletes them."""

    def __init__(self, spark: SparkSession, made: list[str] | None = None) -> None:
        self._spark, self.made = spark, made or []

    def __enter__(self) -> Folders:
        self._token = _open.set((*_open.get(), self))
        return self

    def __exit__(self, *error) -> None:
        _open.reset(self._token)

    def joined(self, other: Folders) -> Folders:
        return Folders(self._spark, self.made + other.made)

    def remove(self) -> None:
        """Delete them through Spark's file systems; tables read from them are gone then."""
        jvm, hadoop = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        for folder in self.made:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
        self.made.clear()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the staging folder."""
    folder = f"{staging_folder(spark)}/filecorpus/{label}-{uuid.uuid4().hex}"
    for scope in _open.get():
        scope.made.append(folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a new table in the staging folder and read them back."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
