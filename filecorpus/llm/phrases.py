"""Phrase collocations by an FM-index per shard of the corpus.

A shard is a million words of a task's documents, as word ids with a separator between
pieces. Its index orders the positions by the words from there on (and, the other way, by
the words up to there); the words before the positions, in that order, are its transform.
The occurrences of a phrase are an interval of each order. Phrases are extended all at once:
a stable sort of a transform by word (the index's step from row to row) puts each extension's
occurrences next to each other, and where they begin is the new interval; the interval of the
other order follows from the smaller words in the old one. At the last step the lengths of the
intervals are enough, and extensions are counted without their places. Depth is limited to the phrases
asked for, so positions are ordered by no more words than that.

Counts are summed over shards in three scans of the documents:

1. Words are counted, and rare ones become separators: a phrase has at least the count asked
   for only if its words have.
2. Indexes give 64-bit hashes of phrases and counts, packed by the leading bits of the hash
   and summed bucket by bucket. A sum is never below the phrase's count.
3. Phrases whose sum is large enough are counted exactly, by their words.

Frequent words and phrases come back to the scans as bitmaps of hashes of a bounded size. What
the bitmaps let through beyond that is work, never a difference in results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecorpus.llm.common import parts, query, slices, table
from filecorpus.staging import stage

MIN_COUNT = 10
LONGER_PERCENT = 50
TOP = 2000
SHARD_TOKENS = 1_000_000
WORD_BYTES = 16
BUCKET_TOKENS = 2_000_000
FAN_BITS = 12
ROW_KEYS = 1 << 18
LEAST_BITS, MOST_BITS = 20, 30

# A blank, a separator that no UTF-8 text holds, what bytes of a text become.
_BLANK, _SEPARATOR = 0x20, 0xFF
_PLAIN = bytes(range(256)).lower().translate(
    bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + b"\xff" * 10)
)


# --- shards -----------------------------------------------------------------------------


@dataclass
class Shard:
    """Word ids from 1 on, 0 between pieces and at both ends; words of each id, and their language."""

    tokens: np.ndarray
    words: pa.Array
    lang_of: np.ndarray
    langs: list[str]

    def hashes(self) -> np.ndarray:
        """64 bits that stand for a word of its language."""
        by_lang = pd.util.hash_array(np.array(self.langs, object), categorize=False)
        words = self.words.to_numpy(zero_copy_only=False)
        own = pd.util.hash_array(words, categorize=False)
        return _mixed(own + by_lang[self.lang_of] * _TIMES[3])

    def text_of(self, ids: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(ids)).cast(pa.string())

    def lang_names(self, ids: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang_of[ids]))


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and separators of the texts, one after the other, and where each begins."""
    ended = pc.binary_join_element_wise(texts.fill_null(""), "\n", "")
    ended.validate(full=True)
    held = ended.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(ended)).as_py()]
    plain = np.frombuffer(held.translate(_PLAIN), np.uint8)
    separates = plain == _SEPARATOR
    solid = plain != _BLANK
    begins = separates.copy()
    begins[0] = True
    begins[1:] |= separates[:-1] | ~solid[:-1]
    return plain[solid], np.flatnonzero(begins[solid]).astype(np.int32)


def _by_lang(batch: pa.RecordBatch, size: int) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language, some ``size`` bytes at a time, texts whole."""
    lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    cuts = (np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // size)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        run = batch.slice(a, b - a)
        langs = run.column("lang").dictionary_encode()
        names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for number, name in enumerate(names):
            texts = run.column("text")
            yield name, texts if len(names) == 1 else texts.filter(pa.array(of == number))


def _encoded(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.Array]:
    """Ids of the words of one language, and the words; the first one is the separator."""
    contents, starts = [np.array([_SEPARATOR], np.uint8)], [np.zeros(1, np.int32)]
    size = 1 + sum(len(content) for content, _ in pieces)
    number, kind = (np.int32, pa.binary()) if size < 1 << 31 else (np.int64, pa.large_binary())
    held = 1
    for content, begins in pieces:
        contents.append(content)
        starts.append(begins.astype(number) + number(held))
        held += len(content)
    offsets = np.concatenate([*starts, np.array([held], number)])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(contents))]
    encoded = pa.Array.from_buffers(kind, len(offsets) - 1, buffers).dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary.cast(pa.binary())


def _shard(by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Shard:
    tokens, words, lang_of, known = [], [pa.array([b""], pa.binary())], [np.zeros(1, np.int32)], 0
    for number, pieces in enumerate(by_lang.values()):
        ids, own = _encoded(pieces)
        tokens.append(np.where(ids > 0, ids + np.int32(known), np.int32(0)))
        words.append(own[1:])
        lang_of.append(np.full(len(own) - 1, number, np.int32))
        known += len(own) - 1
    return Shard(np.concatenate(tokens), pa.concat_arrays(words), np.concatenate(lang_of), list(by_lang))


def shards(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[Shard]:
    """The documents ``lang, text`` of a task as shards of about ``size`` tokens, texts whole.

    Shards of long words have fewer tokens, as the words are held until their ids are made.
    """
    by_lang, held = {}, 0
    for batch in slices(batches):
        for lang, texts in _by_lang(batch, size):
            content, begins = _split(texts)
            by_lang.setdefault(lang, []).append((content, begins))
            held += max(len(begins), len(content) // WORD_BYTES)
            if held >= size:
                yield _shard(by_lang)
                by_lang, held = {}, 0
    if held:
        yield _shard(by_lang)


_TIMES = np.array(  # fixed values: odd multipliers
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64
)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


# --- the index --------------------------------------------------------------------------


def stable_order(*columns: np.ndarray) -> np.ndarray:
    """Stable order by columns of symbols from 0 to 2^31, the first one leading.

    Symbols are sorted with their place in the last bits, as many columns at a time as 64 bits hold.
    """
    size = len(columns[0])
    place = np.uint64(size.bit_length())
    order, left = None, list(columns)
    while left:
        key, used = np.arange(size, dtype=np.uint64), int(place)
        while left and used + (width := int(left[-1].max(initial=0)).bit_length()) <= 64:
            symbols = left.pop()
            symbols = symbols if order is None else symbols[order]
            if width:
                key |= symbols.astype(np.uint64) << np.uint64(used)
            used += width
        key.sort()
        key &= (np.uint64(1) << place) - np.uint64(1)
        moved = key.astype(np.int32)
        order = moved if order is None else order[moved]
    return order


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    first = np.flatnonzero(first).astype(np.int32)
    return first, np.diff(np.append(first, np.int32(len(ordered))))


@dataclass
class Intervals:
    """Phrases as intervals [start, start + size) of the forward and of the backward order.

    ``parent`` is the place of the phrase that was extended, ``word`` what was added.
    """

    start: np.ndarray
    back: np.ndarray
    size: np.ndarray
    word: np.ndarray
    parent: np.ndarray

    def __len__(self) -> int:
        return len(self.size)


class PhraseIndex:
    """A bidirectional index of ``tokens`` for phrases of at most ``depth`` words.

    0 separates, and is first and last.
    """

    def __init__(self, tokens: np.ndarray, depth: int) -> None:
        self.tokens, self.depth = tokens, depth
        self._forward = self._ordered(1)
        self._backward = self._ordered(-1)

    def _ordered(self, step: int) -> np.ndarray:
        """Positions by the word there, then the next ones in the direction of ``step``.

        An extension needs one word less than the phrase it makes, and sorts by that itself.
        """
        places = np.arange(len(self.tokens), dtype=np.int32)
        return stable_order(*(self._at(places, step * k) for k in range(max(1, self.depth - 1))))

    def _at(self, order: np.ndarray, shift: int) -> np.ndarray:
        """Words at positions moved by ``shift``; beyond the ends are separators, as at the ends."""
        return self.tokens.take(order + np.int32(shift), mode="clip")

    def single(self) -> Intervals:
        """All words."""
        counts = np.bincount(self.tokens).astype(np.int32)
        starts = np.cumsum(counts, dtype=np.int32) - counts
        words = np.flatnonzero(counts)
        words = words[words > 0]
        return Intervals(starts[words], starts[words], counts[words], words, np.full(len(words), -1))

    def left(self, of: Intervals) -> Intervals:
        """Every phrase of one more word before; ``of`` must be shorter than ``depth``."""
        start, back, size, word, parent = self._extended(self._forward, -1, of.start, of.back, of)
        return Intervals(start, back, size, word, parent)

    def right(self, of: Intervals) -> Intervals:
        """Every phrase of one more word after."""
        back, start, size, word, parent = self._extended(self._backward, 1, of.back, of.start, of)
        return Intervals(start, back, size, word, parent)

    def right_counts(self, of: Intervals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``word, parent, size`` of every phrase of one more word after, where no other step follows."""
        owner, symbols = self._rows(self._backward, 1, of.back, of)
        real = (owner >= 0) & (symbols > 0)
        key = owner[real].astype(np.int64) << 32 | symbols[real]
        key.sort()
        first, size = _runs(key)
        key = key[first]
        return (key & 0xFFFFFFFF).astype(np.int32), (key >> 32).astype(np.int32), size

    def _rows(self, order, step, here, of: Intervals) -> tuple[np.ndarray, np.ndarray]:
        """Each row's phrase, -1 where it has none, and the word that extends it."""
        change = np.zeros(len(order) + 1, np.int32)
        number = np.arange(1, len(of) + 1, dtype=np.int32)
        change[here] += number
        change[here + of.size] -= number
        return np.cumsum(change, dtype=np.int32)[:-1] - 1, self._at(order, step)

    def _extended(self, order, step, here, there, of: Intervals) -> tuple[np.ndarray, ...]:
        """New intervals in this order and in the other one."""
        owner, symbols = self._rows(order, step, here, of)
        moved = stable_order(symbols)
        owner, symbols = owner[moved], symbols[moved]
        first, size = _runs(owner.astype(np.int64) << 32 | symbols)
        owner, symbols = owner[first], symbols[first]
        known = owner >= 0
        first, size, owner, symbols = (x[known] for x in (first, size, owner, symbols))
        # Within the old interval of the other order, extensions lie in the order of the words.
        by_owner = stable_order(owner)
        before = np.empty(len(size), np.int32)
        running = np.cumsum(size[by_owner], dtype=np.int32) - size[by_owner]
        begins = np.ones(len(size), bool)
        begins[1:] = np.diff(owner[by_owner]) != 0
        base = np.maximum.accumulate(np.where(begins, running, 0))
        before[by_owner] = running - base
        other = there[owner] + before
        real = symbols > 0
        return first[real], other[real], size[real], symbols[real], owner[real]


def phrases_of(tokens: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs (first, second, count) and triples (first, second, third, count) of neighbours."""
    # Words between separators, and all but one of separators in a row, are in no phrase.
    empty = tokens == 0
    empty[1:-1] |= empty[:-2] & empty[2:]
    tokens = np.where(empty, 0, tokens)
    index = PhraseIndex(np.append(tokens[:1], tokens[1:][~(empty[1:] & empty[:-1])]), 3)
    words = index.single()
    pairs = index.left(words)
    second = words.word[pairs.parent]
    third, parent, size = index.right_counts(pairs)
    return [pairs.word, second, pairs.size], [pairs.word[parent], second[parent], third, size]


# --- sums over shards -------------------------------------------------------------------


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    first = np.flatnonzero(first)
    return key[first], np.add.reduceat(count, first) if len(first) else count


_PACKED = pa.schema(
    [("bucket", pa.int64()), ("salt", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
)
_PACKED_SPARK = "bucket long, salt long, keys binary, counts binary"


def _packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys cut by their first ``bits`` bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), int)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], edges]).tolist() if len(keys) else []
    ends = [*edges.tolist(), len(keys)]
    rows = []
    for a, b in zip(starts, ends, strict=False):
        held = counts[a:b]
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if held.max() <= np.iinfo(k).max)
        salt = int(keys[a] & np.uint64(0xFFFF))
        rows.append((int(bucket[a]), salt, keys[a:b].tobytes(), held.astype(kind).tobytes()))
        if len(rows) == 256:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)],
        schema=_PACKED,
    )


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for bucket, keys, counts in zip(
        *(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True
    ):
        key = np.frombuffer(keys, "<u8")
        kind = f"<u{len(counts) // len(key)}"
        yield bucket, key, np.frombuffer(counts, kind).astype(np.int64)


def _merged(
    batches: Iterable[pa.RecordBatch], most: int | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of each bucket of rows that come by bucket, or of runs of ``most`` keys of it."""
    number, keys, counts, held = None, [], [], 0
    for batch in slices(batches, 64):
        for bucket, key, count in _unpacked(batch):
            if keys and (bucket != number or (most and held >= most)):
                yield summed(keys, counts)
                keys, counts, held = [], [], 0
            number = bucket
            keys.append(key)
            counts.append(count)
            held += len(key)
            if len(keys) > 1 and held > 4 * ROW_KEYS and len(keys) % 32 == 0:
                # Repeated keys are added up as they come, so a bucket holds distinct ones.
                key, count = summed(keys, counts)
                keys, counts = [key], [count]
    if keys:
        yield summed(keys, counts)


def frequent_keys(packed: DataFrame, bits: int, least: int, *, fan: int = FAN_BITS) -> DataFrame:
    """``key`` of the packed keys whose sum over all rows is at least ``least``.

    Rows are cut by at most ``fan`` bits at first. Where more buckets are needed, runs of a
    bucket's rows are added up and cut by more bits, so that neither the number of rows nor a
    task grows with the square of the corpus.
    """
    done = min(bits, fan)
    while done < bits:
        more = min(bits, done + fan)

        def cut(batches: Iterable[pa.RecordBatch], more: int = more) -> Iterator[pa.RecordBatch]:
            for key, count in _merged(batches, BUCKET_TOKENS):
                yield from _packed(key, count, more)

        dealt = packed.repartition(1 << more, "bucket", "salt").sortWithinPartitions("bucket")
        packed, done = dealt.mapInArrow(cut, _PACKED_SPARK), more

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, count in _merged(batches, None):
            found = key[count >= least].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["key"])

    dealt = packed.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(kept, "key long")


class Bitmap:
    """Which of 2^bits hash prefixes occur."""

    def __init__(self, bits: int, held: np.ndarray) -> None:
        self.bits, self.held = bits, held

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.bits)
        byte = self.held[(slot >> np.uint64(3)).astype(np.int64)]
        return (byte >> (slot & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def bitmap(keys: DataFrame) -> Bitmap:
    """A bitmap of the column ``key``, of some 16 bits a key and at most 2^MOST_BITS (128 MB)."""
    bits = max(LEAST_BITS, min(MOST_BITS, (16 * max(1, keys.count()) - 1).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("held")
    )
    held = np.zeros(max(1 << (bits - 3), 4096), np.uint8)  # Spark's blocks have 4096 bytes
    for block, content in blocks.collect():
        at = (block - 1) * len(content)
        held[at : at + len(content)] = np.frombuffer(content, np.uint8)
    return Bitmap(bits, held)


# --- the operator -----------------------------------------------------------------------


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )


def word_counts(docs: DataFrame, *, least: int = MIN_COUNT) -> DataFrame:
    """``lang, word, f`` of words with ``f >= least``; the row without a word has all words' sum."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # No index is made here, so more tokens fit.
        for shard in shards(batches, 4 * SHARD_TOKENS):
            counts = np.bincount(shard.tokens, minlength=len(shard.words))
            counts[0] = 0
            ids = np.arange(1, len(shard.words))
            for i in range(0, len(ids), 50_000):
                some = ids[i : i + 50_000]
                yield pa.record_batch(
                    [shard.lang_names(some), shard.text_of(some), pa.array(counts[some])],
                    schema=schema,
                )
            sums = np.bincount(shard.lang_of, counts, len(shard.langs)).astype(np.int64)
            yield pa.record_batch(
                [pa.array(shard.langs), pa.nulls(len(shard.langs), pa.string()), pa.array(sums)],
                schema=schema,
            )

    counted_rows = _chosen(docs).mapInArrow(counted, "lang string, word string, f long")
    sums = counted_rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return sums.filter((F.col("f") >= least) | F.col("word").isNull())


def _word_keys(words: DataFrame) -> DataFrame:
    """The hashes of ``lang, word`` that shards use."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 10_000):
            langs = batch.column("lang").dictionary_encode()
            of = langs.indices.to_numpy().astype(np.int32)
            texts = batch.column("word").cast(pa.binary())
            shard = Shard(np.empty(0, np.int32), texts, of, langs.dictionary.to_pylist())
            keys = shard.hashes().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    return words.select("lang", "word").mapInArrow(hashed, "key long")


def _keyed_phrases(shard: Shard, frequent: Bitmap) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Pairs, then triples, of a shard's frequent words, each with its hash."""
    hashes = shard.hashes()
    kept = frequent.has(hashes)
    kept[0] = False
    for found in phrases_of(np.where(kept[shard.tokens], shard.tokens, 0)):
        key = np.zeros(len(found[0]), np.uint64)
        for k, ids in enumerate(found[:-1]):
            key += hashes[ids] * _TIMES[k]
        yield found, _mixed(key)


def phrase_counts(docs: DataFrame, words: DataFrame, *, least: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase, f`` of phrases of two and three words with ``f >= least``.

    ``words`` is what ``word_counts`` gives.
    """
    context = docs.sparkSession.sparkContext
    tokens = words.filter("word is null").agg(F.sum("f")).head()[0] or 0
    bits = (parts(tokens, BUCKET_TOKENS) - 1).bit_length()
    frequent = context.broadcast(bitmap(stage(_word_keys(words.filter("word is not null")), "word-keys")))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, SHARD_TOKENS):
            both = [(key, found[-1]) for found, key in _keyed_phrases(shard, frequent.value)]
            keys, counts = zip(*both, strict=True)
            if sum(map(len, keys)):
                yield from _packed(*summed(list(keys), list(counts)), min(bits, FAN_BITS))

    packed = _chosen(docs).mapInArrow(hashed, _PACKED_SPARK)
    keys = stage(frequent_keys(packed, bits, least), "phrase-keys")
    wanted = context.broadcast(bitmap(keys))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, SHARD_TOKENS):
            for found, key in _keyed_phrases(shard, frequent.value):
                chosen = np.flatnonzero(wanted.value.has(key))
                for i in range(0, len(chosen), 50_000):
                    some = chosen[i : i + 50_000]
                    texts = [shard.text_of(ids[some]) for ids in found[:-1]]
                    yield pa.record_batch(
                        [
                            shard.lang_names(found[0][some]),
                            pc.binary_join_element_wise(*texts, " "),
                            pa.array(found[-1][some].astype(np.int64)),
                        ],
                        schema=schema,
                    )

    exact = _chosen(docs).mapInArrow(counted, "lang string, phrase string, f long")
    return exact.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _cuts(phrases: DataFrame) -> DataFrame:
    """``k, left, right`` of every cut of every phrase."""
    words = F.size(F.split("phrase", " "))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), words - 1)))
    return cuts.withColumns(
        {
            "left": F.expr("substring_index(phrase, ' ', k)"),
            "right": F.expr("substring_index(phrase, ' ', k - size(split(phrase, ' ')))"),
        }
    )


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits."""
    wide = [c.cast("decimal(16,0)") for c in (a, l, r)]
    over = (wide[0] * wide[0]).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    under = (wide[1] * wide[2]).cast("decimal(32,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), under)


def collocations(
    docs: DataFrame,
    *,
    least: int = MIN_COUNT,
    longer_percent: int = LONGER_PERCENT,
    top: int | None = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language.

    A null language is ``und``, a null or empty text has no words, repeated rows count as
    often as they occur. Ties in score and ``a`` go by the phrase's bytes, so ranks do not
    depend on the order of rows. An empty table gives no row. Other columns are ignored.
    Counts may have up to 16 digits.
    """
    words = stage(word_counts(docs, least=least), "words")
    phrases = stage(phrase_counts(docs, words, least=least), "phrases")
    known = words.filter("word is not null").withColumnRenamed("word", "phrase").unionByName(phrases)
    cuts = _cuts(phrases.withColumnRenamed("f", "a"))
    for side, count in (("left", "l"), ("right", "r")):
        part = known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cuts = cuts.join(part, ["lang", side])
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    longer = (
        phrases.filter(F.size(F.split("phrase", " ")) == 3)
        .withColumn(
            "inside",
            F.explode(F.array(*(F.substring_index("phrase", " ", k) for k in (2, -2)))),
        )
        .groupBy("lang", F.col("inside").alias("phrase"))
        .agg(F.max("f").alias("of_longer"))
    )
    held = F.coalesce("of_longer", F.lit(0)) * 100 >= F.col("a") * longer_percent
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(~held)
    totals = words.filter("word is null").select("lang", F.col("f").alias("n"))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


_WORDS_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), pieces AS (
    SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
    SELECT lang, unnest(w) AS phrase, 1 AS k FROM lists
), grams AS (
    SELECT lang, phrase, k FROM words
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2
        FROM lists WHERE len(w) >= 2
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM lists WHERE len(w) >= 3
), f AS (
    SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang
), parted AS (
    SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
    SELECT p.lang, p.phrase, p.a, c.cut, x.f AS l, y.f AS r,
        (1000000::HUGEINT * p.a * p.a) // (x.f::HUGEINT * y.f) AS score
    FROM parted p, (VALUES (1), (2)) c(cut), f x, f y
    WHERE c.cut < p.k AND x.lang = p.lang AND y.lang = p.lang
        AND x.phrase = array_to_string(p.w[1:c.cut], ' ')
        AND y.phrase = array_to_string(p.w[c.cut + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM parted WHERE k = 3
), held AS (SELECT lang, phrase, max(a) AS longest FROM longer GROUP BY ALL
), kept AS (
    SELECT o.* FROM lowest o LEFT JOIN held h ON h.lang = o.lang AND h.phrase = o.phrase
    WHERE 100 * coalesce(h.longest, 0) < 50 * o.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r,
    t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


@query(_WORDS_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))
