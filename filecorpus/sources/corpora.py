"""Tables of documents, pages and conversations seen as file corpora.

Each adapter only adds columns, so a query that does not use ``content`` does not read
the text: Spark prunes it from the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecorpus.functions.paths import base_name, parent_path

ROOT = "/corpus"
# The attributes that rows get by their number (extension, execute bits, …).
EXTENSIONS = (".txt", ".log", ".bin")
MODE_PLAIN, MODE_EXECUTABLE = 0o644, 0o755


def _every(n: int, then: Column, otherwise: Column) -> Column:
    return F.when(F.col("doc_id") % n == 0, then).otherwise(otherwise)


def document_files(documents: DataFrame, root: str = ROOT) -> DataFrame:
    """Documents as files ``<root>/<source>[/<lang>]/<name>``, with content."""
    extension = F.element_at(
        F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int")
    )
    name = F.concat(
        _every(10, F.lit("."), F.lit("")), F.col("doc_id").cast("string"), extension
    )
    parent = F.concat(
        F.lit(root + "/"),
        F.col("source"),
        _every(4, F.lit(""), F.concat(F.lit("/"), F.col("lang"))),
    )
    return documents.select(
        "doc_id",
        "lang",
        F.lit(root).alias("root"),
        F.concat(parent, F.lit("/"), name).alias("path"),
        parent.alias("parent"),
        name.alias("name"),
        _every(4, F.lit(1), F.lit(2)).alias("depth"),
        _every(13, F.lit("symlink"), F.lit("file")).alias("kind"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("mod_time"),
        _every(7, F.lit(MODE_EXECUTABLE), F.lit(MODE_PLAIN)).alias("mode"),
        F.col("text").cast("binary").alias("content"),
    )


def document_tree(documents: DataFrame, root: str = ROOT) -> DataFrame:
    """``path, parent, name, kind`` of the files of a corpus and of its directories.

    Every source has a directory for each of its languages, so some languages that only
    have files one level up have an empty one.
    """
    files = document_files(documents, root).select("path", "parent", "name", "kind")
    source = F.concat(F.lit(root + "/"), F.col("source"))
    paths = F.array(F.lit(root), source, F.concat(source, F.lit("/"), F.col("lang")))
    directories = documents.select(F.explode(paths).alias("path")).distinct()
    return files.unionByName(
        directories.select(
            "path",
            parent_path("path").alias("parent"),
            base_name("path").alias("name"),
            F.lit("dir").alias("kind"),
        )
    )


def page_files(pages: DataFrame) -> DataFrame:
    """Pages as files: the path is the URL without scheme, query and fragment."""
    path = F.regexp_extract("url", r"^[^:/]+://([^?#]*)", 1)
    return pages.select(
        "page_id",
        F.substring_index(path, "/", 1).alias("root"),
        path.alias("path"),
        parent_path(path).alias("parent"),
        base_name(path).alias("name"),
        F.octet_length("html").cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("mod_time"),
        F.lit(MODE_PLAIN).alias("mode"),
        F.col("html").cast("binary").alias("content"),
    )


def conversation_files(conversations: DataFrame) -> DataFrame:
    """Conversation turns as files ``<conv_id>/<turn>``."""
    folder, name = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return conversations.select(
        folder.alias("root"),
        F.concat(folder, F.lit("/"), name).alias("path"),
        folder.alias("parent"),
        name.alias("name"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("mod_time"),
        F.lit(MODE_PLAIN).alias("mode"),
        F.col("text").cast("binary").alias("content"),
    )
