"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words with one blank between them and a newline at the end. A byte
is eight binary decisions, and each decision has a tree of contexts: the bytes before, the
nearest first, down to ``DEPTH``. A node (context and decision) has counts of zeros and
ones, its Krichevsky-Trofimov estimate ``e``, and the weighted probability

    w = e / 2 + (product of its children's w) / 2,      w = e at the full depth,

so all depths are mixed, each node with its own weight. Learned from one part of the corpus,
the tree predicts every byte of every text; the scores are log10 probabilities.

What moves between tasks are grams, never texts by word or byte. Runs of documents list
their distinct grams (context and byte) and words once, packed by bucket (hash of the two
nearest bytes, or of the word). Lists of a bucket are added up in groups of runs, and groups
in groups, so no task gets more than a group; what is left is the bucket's distinct grams,
from which its part of the trees is built. Each group of runs is then answered with one
number for each gram and word of each run, in the run's order. The levels above the buckets'
have at most 256 contexts and go through the driver. Grams that only held-out texts have are
in the lists with count zero, so a bucket knows all it is asked for, and no table is
broadcast but that of the upper levels.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm.common import (
    batches_of,
    distinct,
    parts,
    query,
    remainder,
    slices,
    table,
    text_bytes,
)
from filecorpus.staging import stage

DEPTH = 5  # bytes of context; with the byte itself they fit 56 bits up to 6
SPLIT = 2  # nearest bytes that say the bucket
RUN_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 4096
FAN_IN = 16
FOLDS, HELD_OUT = 10, 0
START = b"\n"
LN10 = float(np.log(10))


# Packing.


def pack(values: np.ndarray) -> bytes:
    """Integers or floats, their bytes by place, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, dtype: str) -> np.ndarray:
    if not n:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n, "<u8"), dtype=np.uint64)


def pack_words(words: list[bytes]) -> tuple[int, bytes, int]:
    """Their number, and the words, compressed, with the size they had."""
    joined = b"\n".join(words)
    return len(words), pa.compress(joined, codec="zstd", asbytes=True), len(joined)


def unpack_words(n: int, data: bytes, size: int) -> list[bytes]:
    return pa.decompress(data, int(size), codec="zstd", asbytes=True).split(b"\n") if n else []


# Grams of a run.


def canonical(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def grams(pieces: list[tuple[bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of every piece, and where each piece begins.

    A piece is (the ``depth`` bytes before it, its bytes). A gram is an integer whose bytes
    are the context, the nearest first, and then the byte itself.
    """
    raw = np.frombuffer(b"".join(x for piece in pieces for x in piece), np.uint8)
    sizes = np.array([len(text) for _, text in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    whole = len(raw) - depth
    key = raw[depth - 1 : depth - 1 + whole].astype(np.uint64)
    for back in range(2, depth + 1):
        key <<= np.uint64(8)
        key |= raw[depth - back : depth - back + whole]
    key <<= np.uint64(8)
    key |= raw[depth:]
    # Bytes of the contexts between pieces have a gram too, which nobody asked for.
    own = np.ones(whole, bool)
    for i in range(1, len(pieces)):
        first = starts[i] + (i - 1) * depth
        own[first : first + depth] = False
    return key[own], starts


def bucket_of(keys: np.ndarray, depth: int, n: int) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth + 1 - SPLIT))
    return ((near * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(n)).astype(np.int64)


def word_bucket(word: bytes, n: int) -> int:
    return zlib.crc32(word) % n


@dataclass(frozen=True)
class Listed:
    """The distinct grams and words of a run, in the order in which buckets answer."""

    keys: np.ndarray
    key_places: list[np.ndarray]  # by bucket
    words: list[list[bytes]]  # by bucket

    @staticmethod
    def of(keys: np.ndarray, words: Iterable[bytes], depth: int, n: int) -> Listed:
        """``keys`` are sorted and distinct, as ``words`` are distinct."""
        bucket = bucket_of(keys, depth, n)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=n))[:-1]
        by_bucket: list[list[bytes]] = [[] for _ in range(n)]
        for word in sorted(words):
            by_bucket[word_bucket(word, n)].append(word)
        return Listed(keys, np.split(order, ends), by_bucket)


# The trees.


class _LogGamma:
    """log Gamma of k/2 for integers k, by a table and beyond it by Stirling's series."""

    SIZE = 4096

    def __init__(self) -> None:
        at = np.arange(self.SIZE) / 2
        table_ = np.zeros(self.SIZE)
        table_[1], table_[2] = np.log(np.pi) / 2, 0.0
        for k in range(3, self.SIZE):
            table_[k] = table_[k - 2] + np.log(at[k - 2])
        self.table = table_

    def __call__(self, twice: np.ndarray) -> np.ndarray:
        x = np.maximum(twice, self.SIZE) / 2
        series = (x - 0.5) * np.log(x) - x + np.log(2 * np.pi) / 2 + 1 / (12 * x)
        return np.where(twice < self.SIZE, self.table[np.minimum(twice, self.SIZE - 1)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    gamma = _LogGamma()
    both = gamma(2 * zeros + 1) + gamma(2 * ones + 1) - gamma(2 * (zeros + ones) + 2)
    return both - np.log(np.pi)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability, and the weight of the node's own estimate."""
    total = np.logaddexp(own, children) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


def chance(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)


@dataclass
class Level:
    """Nodes of one depth: ``key`` is context times 256 plus decision."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    total: np.ndarray
    weight: np.ndarray
    parent: np.ndarray | None = None  # place in the level above


def decisions(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each byte and the bits taken [8, byte]."""
    j = np.arange(8)[:, None]
    symbol = symbol.astype(np.int64)[None, :]
    return (1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1


def build_levels(
    keys: np.ndarray, counts: np.ndarray, depth: int
) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels from ``depth`` up to ``SPLIT``, and each gram's eight nodes and bits.

    ``keys`` are distinct grams; a count may be zero.
    """
    node, bit = decisions(keys & np.uint64(255))
    entry = (((keys >> np.uint64(8)) << np.uint64(8))[None, :] | node.astype(np.uint64)).ravel()
    key, place = distinct(entry)
    many = np.broadcast_to(counts, node.shape).ravel()
    ones = np.bincount(place, many * bit.ravel(), len(key)).astype(np.int64)
    zeros = np.bincount(place, many, len(key)).astype(np.int64) - ones
    own = log_kt(zeros, ones)
    levels = [Level(key, zeros, ones, own, np.ones(len(key)))]
    for _ in range(depth - SPLIT):
        below = levels[-1]
        up = ((below.key >> np.uint64(16)) << np.uint64(8)) | (below.key & np.uint64(255))
        key, below.parent = distinct(up)
        zeros, ones = (
            np.bincount(below.parent, x, len(key)).astype(np.int64) for x in (below.zeros, below.ones)
        )
        children = np.bincount(below.parent, below.total, len(key))
        levels.append(Level(key, zeros, ones, *weighted(log_kt(zeros, ones), children)))
    return levels, place.reshape(node.shape), bit


@dataclass(frozen=True)
class Top:
    """Depths 1 and 0 [context, decision]: own weight and the counts."""

    weight: tuple[np.ndarray, np.ndarray]
    zeros: tuple[np.ndarray, np.ndarray]
    ones: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> Top:
        """From the sums over depth 2 for each context of one byte [256, 256]."""
        total, weight = weighted(log_kt(zeros, ones), children)
        root_zeros, root_ones = zeros.sum(axis=0)[None], ones.sum(axis=0)[None]
        _, root = weighted(log_kt(root_zeros, root_ones), total.sum(axis=0)[None])
        return Top((root, weight), (root_zeros, zeros), (root_ones, ones))


def log10_chances(
    keys: np.ndarray,
    levels: list[Level],
    place: np.ndarray,
    bit: np.ndarray,
    top: Top,
    depth: int,
) -> np.ndarray:
    """log10 of each gram's probability: its byte after its context."""
    p = None
    for level in levels:
        own = chance(level.zeros[place], level.ones[place], bit)
        weight = level.weight[place]
        p = own if p is None else weight * own + (1 - weight) * p
        if level.parent is not None:
            place = level.parent[place]
    node, _ = decisions(keys & np.uint64(255))
    nearest = (keys >> np.uint64(8 * depth)).astype(np.int64)[None, :]
    for d, context in ((1, nearest), (0, np.zeros_like(nearest))):
        own = chance(top.zeros[d][context, node], top.ones[d][context, node], bit)
        weight = top.weight[d][context, node]
        p = weight * own + (1 - weight) * p
    return np.log10(p).sum(axis=0)


# Spark.

_RUNS = (
    "run long, bucket int, n_keys int, keys binary, counts binary, n_words int, words binary,"
    " words_size long, word_counts binary, uids array<long>, ids array<long>, held array<boolean>,"
    " sizes array<long>, before binary, text binary"
)
_RUNS_ARROW = pa.schema(
    [
        ("run", pa.int64()), ("bucket", pa.int32()), ("n_keys", pa.int32()), ("keys", pa.binary()),
        ("counts", pa.binary()), ("n_words", pa.int32()), ("words", pa.binary()),
        ("words_size", pa.int64()), ("word_counts", pa.binary()), ("uids", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("before", pa.binary()),
        ("text", pa.binary()),
    ]
)


def _cut(text: bytes, depth: int, most: int) -> Iterator[tuple[bytes, bytes]]:
    """Pieces of a text of about ``most`` bytes, between words, each with what stands before."""
    padded, a = START * depth + text, 0
    while a < len(text):
        b = text.find(b" ", a + most) + 1 or len(text)
        yield padded[a : a + depth], text[a:b]
        a = b


def _run_rows(run: int, held_pieces: list[tuple], depth: int, n: int) -> Iterator[tuple]:
    """The lists of a run by bucket, and the run itself."""
    pieces = [(before, text) for _, _, _, before, text in held_pieces]
    held = np.array([h for _, _, h, _, _ in held_pieces], bool)
    keys, starts = grams(pieces, depth)
    sizes = np.array([len(text) for _, text in pieces], np.int64)
    marked = (keys << np.uint64(1)) | np.repeat(held, sizes)
    marked.sort()
    keys = marked >> np.uint64(1)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    learned = np.add.reduceat((marked & np.uint64(1)) ^ np.uint64(1), first).astype("<i8")
    keys = keys[first]
    del marked
    words: Counter[bytes] = Counter()
    for (_, text), h in zip(pieces, held, strict=True):
        if h:
            words.update(dict.fromkeys(text.split(), 0))
        else:
            words.update(text.split())
    listed = Listed.of(keys, words, depth, n)
    for bucket, (places, own) in enumerate(zip(listed.key_places, listed.words, strict=True)):
        if len(places) or own:
            yield (
                run, bucket, len(places), pack_sorted(keys[places]), pack(learned[places]),
                *pack_words(own), pack(np.array([words[w] for w in own], "<i8")), *[None] * 6,
            )
    text = b"".join(t for _, t in pieces)
    yield (
        run, -1, *[None] * 7,
        [p[0] for p in held_pieces], [p[1] for p in held_pieces], held.tolist(), sizes.tolist(),
        b"".join(b for b, _ in pieces), pa.compress(text, codec="zstd", asbytes=True),
    )


def list_runs(docs: DataFrame, depth: int, buckets: int, run_bytes: int) -> DataFrame:
    """Runs of documents as they are read, each with its lists of grams and words."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            run, uid, size, pieces = task << 24, task << 40, 0, []
            for batch in slices(batches):
                for doc_id, held, text in zip(
                    *(batch.column(c).to_pylist() for c in ("doc_id", "held", "text")), strict=True
                ):
                    for before, piece in _cut(canonical(text), depth, run_bytes):
                        pieces.append((uid, doc_id, held, before, piece))
                        size += len(piece)
                        if size >= run_bytes:
                            yield from _run_rows(run, pieces, depth, buckets)
                            run, size, pieces = run + 1, 0, []
                    uid += 1
            if pieces:
                yield from _run_rows(run, pieces, depth, buckets)

        yield from batches_of(_RUNS_ARROW, rows(), 32)

    chosen = docs.select(
        F.col("doc_id").cast("long"),
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held"),
        F.col("text").cast("string"),
    )
    return stage(chosen.mapInArrow(listed, _RUNS), "runs")


@dataclass(frozen=True)
class Added:
    """Lists of one bucket, added up."""

    keys: np.ndarray
    counts: np.ndarray
    words: dict[bytes, int]

    @staticmethod
    def of(group: pd.DataFrame) -> Added:
        keys, learned, totals = [], [], Counter()
        for row in group.itertuples():
            keys.append(unpack_sorted(row.keys, row.n_keys))
            learned.append(unpack(row.counts, row.n_keys, "<i8"))
            words = unpack_words(row.n_words, row.words, row.words_size)
            counts = unpack(row.word_counts, row.n_words, "<i8").tolist()
            for word, c in zip(words, counts, strict=True):
                totals[word] += c
        every, place = distinct(np.concatenate(keys))
        counts = np.bincount(place, np.concatenate(learned), len(every)).astype(np.int64)
        return Added(every, counts, totals)


_ADDED = (
    "bucket int, part long, n_keys int, keys binary, counts binary, n_words int, words binary,"
    " words_size long, word_counts binary"
)


def _add(group: pd.DataFrame) -> pd.DataFrame:
    added = Added.of(group)
    words = sorted(added.words)
    n, data, size = pack_words(words)
    row = (
        group["bucket"].iloc[0], group["part"].iloc[0], len(added.keys), pack_sorted(added.keys),
        pack(added.counts.astype("<i8")), n, data, size,
        pack(np.array([added.words[w] for w in words], "<i8")),
    )
    names = [c.split()[0] for c in _ADDED.split(", ")]
    return pd.DataFrame([row], columns=names)


def add_up(lists: DataFrame, groups: int, fan_in: int) -> DataFrame:
    """Lists of each bucket and ``part`` added up, until at most ``fan_in`` parts are left."""
    added = stage(lists.groupBy("bucket", "part").applyInPandas(_add, _ADDED), "added")
    while groups > fan_in:
        groups = parts(groups, fan_in)
        fewer = added.withColumn("part", F.pmod("part", F.lit(groups)))
        added = stage(fewer.groupBy("bucket", "part").applyInPandas(_add, _ADDED), "added")
    return added


_SUMS = "context int, decision int, zeros long, ones long, children double, tokens long, types long"


def _sum_bucket(depth: int):
    def summed(group: pd.DataFrame) -> pd.DataFrame:
        bucket = Added.of(group)
        levels, _, _ = build_levels(bucket.keys, bucket.counts, depth)
        last = levels[-1]
        up = ((last.key >> np.uint64(16)) << np.uint64(8)) | (last.key & np.uint64(255))
        key, place = distinct(up)
        rows = pd.DataFrame(
            {
                "context": (key >> np.uint64(8)).astype(np.int32),
                "decision": (key & np.uint64(255)).astype(np.int32),
                "zeros": np.bincount(place, last.zeros, len(key)).astype(np.int64),
                "ones": np.bincount(place, last.ones, len(key)).astype(np.int64),
                "children": np.bincount(place, last.total, len(key)),
                "tokens": 0,
                "types": 0,
            }
        )
        seen = [c for c in bucket.words.values() if c]
        words = pd.DataFrame([(-1, -1, 0, 0, 0.0, sum(seen), len(seen))], columns=rows.columns)
        return pd.concat([rows, words])

    return summed


_MODEL = (
    "bucket int, n_keys int, keys binary, logs binary, n_words int, words binary,"
    " words_size long, totals binary"
)


def _model_bucket(depth: int, top: Top):
    def built(group: pd.DataFrame) -> pd.DataFrame:
        bucket = Added.of(group)
        levels, place, bit = build_levels(bucket.keys, bucket.counts, depth)
        # float32 keeps seven digits of each byte's logarithm; sums are float64.
        logs = log10_chances(bucket.keys, levels, place, bit, top, depth).astype("<f4")
        words = sorted(bucket.words)
        n, data, size = pack_words(words)
        totals = pack(np.array([bucket.words[w] for w in words], "<i8"))
        row = (
            group["bucket"].iloc[0], len(bucket.keys), pack_sorted(bucket.keys), logs.tobytes(),
            n, data, size, totals,
        )
        return pd.DataFrame([row], columns=[c.split()[0] for c in _MODEL.split(", ")])

    return built


def _answer(lists: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
    """One number for each gram and each word of each run in a group."""
    if not len(lists):  # a part that has no run with grams of the bucket
        return pd.DataFrame([], columns=["run", "bucket", "logs", "totals"])
    (model,) = models.itertuples()
    keys = unpack_sorted(model.keys, model.n_keys)
    logs = np.frombuffer(model.logs, "<f4")
    words = unpack_words(model.n_words, model.words, model.words_size)
    totals = dict(zip(words, unpack(model.totals, model.n_words, "<i8").tolist(), strict=True))
    out = []
    for row in lists.itertuples():
        found = logs[np.searchsorted(keys, unpack_sorted(row.keys, row.n_keys))]
        own = unpack_words(row.n_words, row.words, row.words_size)
        counts = pack(np.array([totals[w] for w in own], "<i8"))
        out.append((row.run, row.bucket, found.tobytes(), counts))
    return pd.DataFrame(out, columns=["run", "bucket", "logs", "totals"])


_SCORES = (
    "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double,"
    " score double"
)


def _score_run(depth: int, buckets: int, tokens: int, types: int, ends: int):
    def scored(runs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_run = {k: g for k, g in answers.groupby("run")}
        for row in runs.itertuples():
            sizes = np.array(row.sizes, np.int64)
            ends_at = np.cumsum(sizes)
            text = pa.decompress(row.text, int(ends_at[-1]), codec="zstd", asbytes=True)
            pieces = [
                (row.before[i * depth : (i + 1) * depth], text[b - n : b])
                for i, (n, b) in enumerate(zip(sizes.tolist(), ends_at.tolist(), strict=True))
            ]
            keys, starts = grams(pieces, depth)
            order = np.argsort(keys)
            keys = keys[order]
            changes = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            times = np.diff(changes, append=len(keys))
            split = [piece.split() for _, piece in pieces]
            listed = Listed.of(keys[changes], set().union(*split), depth, buckets)
            logs, totals = np.empty(len(changes), np.float32), {}
            answered = by_run[row.run]
            for bucket, found, counts in zip(
                answered["bucket"], answered["logs"], answered["totals"], strict=True
            ):
                logs[listed.key_places[bucket]] = np.frombuffer(found, "<f4")
                own = listed.words[bucket]
                totals.update(zip(own, unpack(counts, len(own), "<i8").tolist(), strict=True))
            each = np.empty(len(keys))
            each[order] = np.repeat(logs, times)
            scores = np.add.reduceat(each, starts)
            for i, words in enumerate(split):
                seen = [totals[w] for w in words]
                if pieces[i][1].endswith(b"\n"):
                    seen.append(ends)
                c = np.array(seen, np.float64)
                base = np.log10((c + 0.1) / (tokens + 0.1 * (types + 1))).sum()
                doc_id = row.ids[i]
                known = int((c > 0).sum())
                out.append(
                    (
                        row.uids[i], None if pd.isna(doc_id) else int(doc_id), bool(row.held[i]),
                        len(seen), known, float(base), float(scores[i]),
                    )
                )
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        found = pd.DataFrame(out, columns=names)
        return found.astype({"doc_id": "Int64"})

    return scored


def context_tree_scores(
    docs: DataFrame, *, depth: int = DEPTH, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Learn from the rows outside the held-out fold and score every row of ``doc_id, text``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null
    or empty text has one token, the end. Rows that share an id, or are equal, are separate
    documents. Without a training row, all counts are zero. A text longer than a run is
    scored in pieces that know the bytes before them, and the pieces are added up. Other
    columns are ignored.
    """
    buckets = min(MOST_BUCKETS, parts(text_bytes(docs), bucket_bytes))
    runs = list_runs(docs, depth, buckets, run_bytes)
    # A run's list of a bucket is the smaller, the more buckets there are.
    fan_in = max(FAN_IN, buckets)
    groups = parts(runs.filter("bucket = -1").count(), fan_in)
    lists = runs.filter("bucket >= 0").select(
        "run", "bucket", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("part"), "n_keys", "keys",
        "counts", "n_words", "words", "words_size", "word_counts",
    )
    added = add_up(lists, groups, fan_in)
    sums = (
        added.groupBy("bucket")
        .applyInPandas(_sum_bucket(depth), _SUMS)
        .groupBy("context", "decision")
        .agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "children", "tokens", "types")))
        .collect()  # at most 256 * 255 rows and one
    )
    zeros, ones = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64)
    children, tokens, types = np.zeros((256, 256)), 0, 0
    for r in sums:
        if r["context"] < 0:
            tokens, types = r["tokens"], r["types"]
        else:
            at = r["context"], r["decision"]
            zeros[at], ones[at], children[at] = r["zeros"], r["ones"], r["children"]
    # Every document has one end, in its last piece.
    learned = docs.filter(remainder("doc_id", FOLDS) != HELD_OUT).count()
    tokens, types = tokens + learned, types + (learned > 0)
    top = Top.of(zeros, ones, children)
    models = stage(added.groupBy("bucket").applyInPandas(_model_bucket(depth, top), _MODEL), "models")
    each_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    answers = (
        lists.select("run", "bucket", "part", "n_keys", "keys", "n_words", "words", "words_size")
        .groupBy("bucket", "part")
        .cogroup(models.withColumn("part", each_part).groupBy("bucket", "part"))
        .applyInPandas(_answer, "run long, bucket int, logs binary, totals binary")
    )
    texts = runs.filter("bucket = -1").select("run", "uids", "ids", "held", "sizes", "before", "text")
    scored = (
        texts.groupBy("run")
        .cogroup(answers.groupBy("run"))
        .applyInPandas(_score_run(depth, buckets, tokens, types, learned), _SCORES)
    )
    names = ["n_tokens", "n_known", "base_score", "score"]
    return (
        scored.groupBy("uid")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("held_out").alias("held_out"),
            *(F.sum(c).alias(c) for c in names),
        )
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
            "base_score", "score",
        )
    )


@query()
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document, by the trees and by single words."""
    return context_tree_scores(table(spark, sf_dir, "documents"))
