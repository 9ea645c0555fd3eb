"""Documents to packed training sequences, stage by stage.

Each stage gets the documents that the one before has kept, written as Parquet and read
again, and all but the last return the columns of documents:

1. quality rules: failing lines go, and documents that are rejected
2. quality classifier: documents that score under 0.7 go
3. near-duplicates: one document of each group stays
4. mixing: the rows come in the order of the mix, from file to file and row to row
5. packing: pieces of at most 1024 tokens in sequences that follow that order
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm import mixing, near_duplicates, packing, quality_classifier, quality_rules
from filecorpus.llm.common import table
from filecorpus.staging import Folders, stage


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; so do documents that lose too much or fail the base rules."""
    return quality_rules.clean(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents as they were before any stage, judges those here."""
    model = quality_classifier.learn(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return quality_classifier.keep_good(docs, model)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays."""
    return near_duplicates.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the root of their sizes, as long as they last."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, sequence, offset and place in the order of the mix."""
    return packing.pack_documents(
        docs, public_tokenizers.path(packing.BYTE_TOKENIZER), place=_place(docs)
    )


def _place(docs: DataFrame) -> Column | None:
    """The order of rows in written files; documents that are not read from files have none."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return None
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return F.shiftleft(file, 36) + F.col("_metadata.row_index")


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near-duplicates", duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

# Trees, signatures and packing are not said in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; one row for each piece of a kept document.

    Null and empty texts have no words, so the rules reject them; of equal rows and of rows
    that share an id and are near-duplicates one stays; a null id is an id like others, and
    other columns may have any names. No documents give no row. What a stage has written on
    its way, and its input, is deleted as soon as its result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        with Folders(spark) as used:
            made = function(spark, docs, sf_dir)
        with Folders(spark) as result:
            docs = stage(made, name.replace(" ", "-"))
        used.remove()
        if before is not None:
            before.remove()
        before = result
    return docs
