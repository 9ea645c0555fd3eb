"""Token-ID output: Arrow stream files whose batches are fixed-size lists.

A file holds one shard of the corpus in ascending document order: the ids of all its
documents, one after the other, cut into rows of ``length`` ids. Columns of a row:

``ids``   fixed-size list of ``length`` token ids, zero where nothing is left to fill it
``mask``  fixed-size list of ``length`` booleans, true for ids, false for the filling
``docs``  the documents that begin in the row: id, place in the row, number of ids

All batches but the last hold ``ROWS_PER_BATCH`` rows. A reader maps the file, and row ``i``
is then a slice of one buffer: no copy and no search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecorpus.llm.common import batches_of, parts, query, slices, table, text_bytes
from filecorpus.llm.tokens import Encoder
from filecorpus.staging import new_folder, stage

LENGTH = 1024
ROWS_PER_BATCH = 512
SHARD_BYTES = 16 << 20
END_ID = 2
WORD_TOKENIZER = "word_bpe_49k.json"

_WRITTEN = pa.schema([("shard", pa.int64()), ("n_tokens", pa.int64())])
_DOCUMENT = pa.struct([("doc_id", pa.int64()), ("place", pa.int32()), ("n_tokens", pa.int64())])


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("docs", pa.list_(_DOCUMENT)),
        ]
    )


class ShardWriter:
    """Rows of one shard, written batch by batch as they fill."""

    def __init__(self, sink, dtype: np.dtype, length: int) -> None:
        self._schema, self._dtype, self._length = file_schema(dtype, length), dtype, length
        self._writer = pa.ipc.new_stream(sink, self._schema)
        self._held, self._held_ids, self._docs = [], 0, []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((self._held_ids, doc_id, len(ids)))
        self._held.append(ids)
        self._held_ids += len(ids)
        self.n_tokens += len(ids)
        if self._held_ids >= ROWS_PER_BATCH * self._length:
            self._flush(whole_batches=True)

    def _flush(self, *, whole_batches: bool) -> None:
        flat = np.concatenate([np.empty(0, self._dtype), *self._held])
        step = ROWS_PER_BATCH * self._length
        end = len(flat) // step * step if whole_batches else len(flat)
        for a in range(0, end, step):
            docs = [d for d in self._docs if a <= d[0] < a + step]
            self._write(flat[a : min(a + step, end)], [(p - a, i, n) for p, i, n in docs])
        # A document that begins at the very end begins in the next batch.
        self._docs = [(p - end, i, n) for p, i, n in self._docs if p >= end]
        self._held, self._held_ids = [flat[end:]], len(flat) - end

    def _write(self, ids: np.ndarray, docs: list[tuple]) -> None:
        n_rows = -(-len(ids) // self._length)
        filled = np.zeros(n_rows * self._length, self._dtype)
        filled[: len(ids)] = ids
        mask = np.arange(len(filled)) < len(ids)
        per_row: list[list] = [[] for _ in range(n_rows)]
        for place, doc_id, n in docs:
            per_row[place // self._length].append((doc_id, place % self._length, n))
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (filled, mask)
        ]
        columns.append(pa.array(per_row, self._schema.field("docs").type))
        self._writer.write_batch(pa.record_batch(columns, schema=self._schema))

    def close(self) -> None:
        if self._held_ids or self._docs:
            self._flush(whole_batches=False)
        self._writer.close()


class Shard:
    """A shard file in memory or mapped; rows are views of its buffers."""

    def __init__(self, source) -> None:
        reader = pa.ipc.open_stream(source)
        self.length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def row(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view, not a copy) and mask of row ``i``."""
        batch, k = self.batches[i // ROWS_PER_BATCH], i % ROWS_PER_BATCH
        return self._values(batch, "ids")[k * self.length : (k + 1) * self.length], (
            batch.column("mask")[k].values
        )

    @staticmethod
    def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).values.to_numpy(zero_copy_only=True)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, first place in the shard, and ids."""
        flat = [self._values(b, "ids") for b in self.batches]
        ids = np.concatenate(flat) if flat else np.empty(0, "<u2")
        base = 0
        for batch in self.batches:
            for row, docs in enumerate(batch.column("docs").to_pylist()):
                for d in docs:
                    first = base + row * self.length + d["place"]
                    yield d["doc_id"], first, ids[first : first + d["n_tokens"]]
            base += batch.num_rows * self.length


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    *,
    spaces_in_tokens: bool = False,
    end_id: int = END_ID,
    length: int = LENGTH,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write ``doc_id, text`` as shards in ``folder``; returns ``shard, n_tokens, start``.

    Shards follow each other in ascending ``doc_id`` order (null first; rows that share an id
    by their text), and ``start`` is the number of ids in all shards before. A null or empty
    text gives the end id alone; an empty table gives no shard. Other columns are ignored.

    The rows are dealt out by ranges of ``doc_id``, so a shard is one task's work, and no
    other key matters. A shard appears under its name only when it is complete, so a task
    may be run again. ``folder`` is any place that ``pyarrow.fs`` can write to.
    """
    n = parts(text_bytes(docs), shard_bytes)
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    shared = docs.sparkSession.sparkContext.broadcast(
        Encoder(tokenizer, spaces_in_tokens=spaces_in_tokens)
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, path = pa.fs.FileSystem.from_uri(folder)
        draft, writer = f"{path}/.{shard}-{uuid.uuid4().hex}", None
        encoder = shared.value
        end = np.array([end_id], encoder.dtype)
        for batch in slices(batches):
            if writer is None:
                sink = fs.open_output_stream(draft)
                writer = ShardWriter(sink, encoder.dtype, length)
            texts = encoder.ids(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, encoder.dtype), end]))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(draft, f"{path}/{shard:08d}.arrow")
            yield from batches_of(_WRITTEN, [(shard, writer.n_tokens)], 1)

    written = stage(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "shard long, n_tokens long"),
        "shards",
    )
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return written.select("shard", "n_tokens", start.alias("start"))


def read_documents(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files of ``folder``.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the ids of all
    documents before.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder)
    named = files.select(
        F.regexp_extract("path", r"(\d+)\.arrow$", 1).cast("long").alias("shard"), "content"
    )
    schema = pa.schema(
        [
            ("shard", pa.int64()),
            ("doc_id", pa.int64()),
            ("first", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids", pa.binary()),
        ]
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    number = batch.column("shard")[i].as_py()
                    content = batch.column("content")[i].as_buffer()
                    for doc_id, first, ids in Shard(content).documents():
                        yield number, doc_id, first, len(ids), ids.astype("<u4").tobytes()

        yield from batches_of(schema, rows(), 500)

    found = named.mapInArrow(
        read, "shard long, doc_id long, first long, n_tokens long, ids binary"
    )
    return found.join(shards.select("shard", "start"), "shard").select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids"
    )



@query()
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, and what the files say of each document."""
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    if "://" not in folder:
        folder = f"file://{folder}"
    shards = write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), folder
    )
    found = read_documents(spark, folder, shards)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
