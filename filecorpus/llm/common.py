"""What the operators share: tables, folds, registration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL if that can say it."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id counts as the empty text (0)."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit(""))
    return F.crc32(text.cast("binary")) % n


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows; it sizes blocks and shards, nothing else."""
    return docs.agg(F.sum(F.octet_length(column))).head()[0] or 0


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, longer by as many underscores as it takes to be none of the columns'."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(amount: int, each: int) -> int:
    return max(1, -(-amount // each))


def batches_of(schema: pa.Schema, rows: Iterable[tuple], size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows each."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, so that lists made of them stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def components_sql(words: int, percent: int) -> str:
    """DuckDB SQL of ``doc_id, n_shingles, component_id`` under links of shingle sets."""
    return rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
        range(1, greatest(len(w) - {words - 1}, 1) + 1),
        lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS s
    FROM docs
), shingles AS (SELECT r, unnest(s) AS g FROM sets
), common AS (
    SELECT a.r AS x, b.r AS y, count(*) AS n
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.r <> b.r GROUP BY ALL
), links AS (
    SELECT x, y FROM common JOIN sets a ON a.r = x JOIN sets b ON b.r = y
    WHERE 100 * n >= {percent} * (len(a.s) + len(b.s) - n)
), reach AS (
    SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT any_value(a.doc_id) AS doc_id, any_value(len(a.s))::BIGINT AS n_shingles,
    min(b.doc_id) AS component_id
FROM reach JOIN sets a ON a.r = reach.x JOIN sets b ON b.r = reach.y GROUP BY a.r
"""
