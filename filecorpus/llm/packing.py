"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their
own; the rest is packed by repeating one step: take the longest piece left, find by a
subset-sum over the lengths left the combination that fills the sequence most, and remove
it, as many times over as the pieces allow. Only lengths matter for that, so a shard of
pieces is solved on a histogram of at most ``capacity`` counts.

Pieces that have an order are solved ``WINDOW`` at a time, and of the combinations found the
one that holds the earliest piece left is made next, of the earliest pieces of its lengths.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm.common import batches_of, parts, query, slices, table
from filecorpus.llm.tokens import Encoder
from filecorpus.staging import stage

CAPACITY = 1024
SHARD_PIECES = 131_072
WINDOW = 4096
END_ID = 2
PIECES_KEPT = 700_000
BYTE_TOKENIZER = "byte_bpe_50k.json"

_PIECES = "doc_id long, piece int, start long, length long, ids binary, place long"
_PIECES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("place", pa.int64()),
    ]
)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return list(zip(starts, [first] + [capacity] * (len(starts) - 1), strict=True))


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    place: Column | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids, place`` of every document's pieces.

    A null or empty text has the end id alone. ``ids`` are little-endian 32-bit integers,
    ``place`` is an integer by which the documents are ordered, if they are.
    """

    shared = docs.sparkSession.sparkContext.broadcast(
        Encoder(tokenizer, spaces_in_tokens=True, kept=PIECES_KEPT)
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        end = np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                texts = encoder.ids(batch.column("text").to_pylist())
                places = batch.column("place").to_pylist()
                for doc_id, at, ids in zip(
                    batch.column("doc_id").to_pylist(), places, texts, strict=True
                ):
                    wide = np.frombuffer(ids, encoder.dtype).astype("<u4").tobytes() + end
                    for piece, (start, length) in enumerate(cut(len(wide) // 4, capacity)):
                        held = wide[4 * start : 4 * (start + length)]
                        yield doc_id, piece, start, length, held, at

        yield from batches_of(_PIECES_ARROW, rows(), 500)

    chosen = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        (F.lit(None) if place is None else place).cast("long").alias("place"),
    )
    return chosen.mapInArrow(encode, _PIECES)


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, times) of lengths that together come as near to ``room`` as they can.

    Bit ``s`` of ``reach`` says that some of the lengths seen so far add up to ``s``.
    """
    if room < len(counts) and counts[room]:
        return [(room, 1)]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = min(int(counts[length]), room // length)
        times = 1
        while left:
            k = min(times, left)
            before, reach = reach, (reach | reach << (length * k)) & mask
            if reach != before:
                steps.append((length, k, before))
            left -= k
            times *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + k
            total -= length * k
    return list(chosen.items())


def combinations(counts: np.ndarray, capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """The sequences to make: ((length, times)…, how many such sequences)."""
    counts = counts.copy()
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return
        counts[longest] -= 1
        picked = fullest(counts, capacity - longest)
        counts[longest] += 1
        content: dict[int, int] = {longest: 1}
        for length, times in picked:
            content[length] = content.get(length, 0) + times
        repeats = min(int(counts[length]) // times for length, times in content.items())
        for length, times in content.items():
            counts[length] -= times * repeats
        yield list(content.items()), repeats


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place of each length (1 to ``capacity``)."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(counts)])  # where a length begins in ``order``
    sequence, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for content, repeats in combinations(counts, capacity):
        numbers, offset = np.arange(made, made + repeats), 0
        for length, times in content:
            for _ in range(times):
                rows = order[next_of[length] : next_of[length] + repeats]
                next_of[length] += repeats
                sequence[rows], place[rows] = numbers, offset
                offset += length
        made += repeats
    return sequence, place


def pack_in_order(
    lengths: np.ndarray, capacity: int, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place of each length, where sequences follow the order given.

    The earliest piece left is always in the next sequence, and the others in it are of the
    same ``window`` short pieces, the earliest of their lengths. Full pieces come at their
    place in the order.
    """
    sizes = lengths.tolist()
    sequence, place = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    # A window ends where the next one's first short piece is.
    first = np.flatnonzero(lengths < capacity)[::window]
    starts = [0, *first[1:].tolist()]
    made = 0
    for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
        waiting, having = defaultdict(deque), defaultdict(list)
        for i in range(start, end):
            waiting[sizes[i]].append(i)
        counts = np.bincount(lengths[start:end], minlength=capacity + 1)
        found = list(combinations(counts, capacity))
        left = [repeats for _, repeats in found]
        for k, (content, _) in enumerate(found):
            for length, _ in content:
                having[length].append(k)
        for i in range(start, end):
            if sequence[i] >= 0:
                continue
            of = having[sizes[i]]
            while not left[of[-1]]:
                of.pop()
            left[of[-1]] -= 1
            offset = 0
            for length, times in found[of[-1]][0]:
                for _ in range(times):
                    j = waiting[length].popleft()
                    sequence[j], place[j] = made, offset
                    offset += length
            made += 1
    return sequence, place


def pack(
    pieces: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``capacity``.

    Pieces are staged once with a row number, so repeated rows stay apart. They are dealt in
    ranges into shards of about ``shard_pieces``, each packed on its own: no shard leaves
    more than its last few sequences unfilled, and none grows with the data. Only numbers
    move for that; ``ids`` and other columns are joined back by row number.

    With a column ``place`` the ranges are of ``place`` (then of that number), and sequence
    ids follow that order, full pieces included (``pack_in_order``). Without one the order is
    free, and full pieces need not be dealt.
    """
    number, of_number, of_place = "__row", "sequence_id", "offset"
    kept = [c for c in pieces.columns if c not in (of_number, of_place)]
    ordered = "place" in kept
    rows = stage(pieces.select(*kept, F.monotonically_increasing_id().alias(number)), "pieces")
    dealt = rows if ordered else rows.filter(F.col("length") < capacity)
    order = ["place", number] if ordered else [number]
    shards = parts(dealt.count(), shard_pieces)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            group = pd.concat(held)
            lengths = group["length"].to_numpy()
            sequence, place = (pack_in_order if ordered else pack_lengths)(lengths, capacity)
            first = TaskContext.get().partitionId() << 32
            yield pd.DataFrame(
                {number: group[number], of_number: first + sequence, of_place: place}
            )

    ranged = dealt.select(*order, "length").repartitionByRange(shards, *order)
    # A shard's rows in one order, whenever they come, so that a task run again deals the same.
    ranged = ranged.sortWithinPartitions(*order).drop("place")
    placed = ranged.mapInPandas(solve, f"{number} long, {of_number} long, {of_place} long")
    packed = dealt.join(placed, number).select(*kept, of_number, of_place)
    if ordered:
        return packed
    full = rows.filter(F.col("length") >= capacity).select(
        *kept, (-1 - F.col(number)).alias(of_number), F.lit(0).cast("long").alias(of_place)
    )
    return packed.unionByName(full)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, place: Column | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` for ``doc_id, text``.

    With ``place``, sequences follow it and it is a column too. An empty table gives no row.
    Rows that share an id are separate documents. Other columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, capacity=capacity, place=place)
    return pack(pieces.drop("place") if place is None else pieces, capacity=capacity)


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    pieces = token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER)
    )
    # The digest is asked for, not the ids: they need not move with their pieces.
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "place")
    return pack(digested)
