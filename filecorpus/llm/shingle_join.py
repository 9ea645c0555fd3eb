"""N-gram Jaccard join by size: subsets of small sets, inverted lists for large ones.

A document is the set of its four-word shingles. Equal sets are one class, and classes are
what is joined. Two sets of the similarity share so many shingles that, with all shingles in
one order, they share ``SUBSET`` of the first n - ceil(0.85 n) + ``SUBSET`` of each, and one of
the first n - ceil(0.85 n) + 1. So

- a small set is filed under every ``SUBSET``-sized subset of its first shingles: few keys, and
  sets meet only if they share several rare shingles;
- a large set, which has too many subsets, goes to the inverted list of each of its first
  shingles, and so do the small sets that are large enough to be similar to a large one; the
  lists are scanned for its partners.

The boundary is where keys, list entries and comparisons cost least, from the numbers of sets
and the lengths of their lists by size. The order is from rare to frequent: by a fixed number
of counters that shingles are hashed to, then by hash. Any order gives the same links; a rough
count only makes lists of very frequent shingles longer.

Only components are asked for, so pairs of a list are not written out: its members are linked
to the smallest one, and where components are left, members of different ones are compared:
of short lists all, many lists at once, of long ones in blocks. Set sizes and the parity of hashed shingles give
a bound that spares most pairs (each differing bit is a differing shingle); what is left is
confirmed on the full sets. A block with many such pairs is compared with the sets beside it
and gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm.common import batches_of, components_sql, parts, query, slices, table
from filecorpus.llm.near_duplicates import components, mixed
from filecorpus.llm.phrases import bitmap
from filecorpus.operators.joins import BROADCAST_BYTES, table_bytes
from filecorpus.staging import Folders, stage

WORDS = 4
PERCENT = 85
SUBSET = 2
COUNTER_BITS = 21
COUNTERS_A_ROW = 1 << 14
PARITY_BITS = 1024
LARGEST_BOUNDARY = 1024
COMPARISON_COST = 0.02  # of one shuffled row
SHORT_LIST = 64
SHARE = 512
BLOCK, MEMBERS = 2048, 32_768
BLOCK_SHINGLES = 4 << 20
DENSE = 256
AT_ONCE = 1 << 16
ROWS_PER_TASK = 20_000

_TIMES = np.array(  # fixed values: odd multipliers, one for each word of a shingle
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64
)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A text of one to three words has one, that of all its words; without words there is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = pd.util.hash_array(np.array(words, object), categorize=False)
    n = min(len(words), WORDS)
    rows = len(words) - n + 1
    total = np.full(rows, n, np.uint64)
    for k in range(n):
        total += hashed[k : k + rows] * _TIMES[k]
    return np.unique(mixed(total))


def set_id(hashes: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set."""
    first = mixed(hashes).sum(dtype=np.uint64)
    second = mixed(hashes * _TIMES[0] + _TIMES[1]).sum(dtype=np.uint64)
    return first.tobytes() + second.tobytes()


def parity(hashes: np.ndarray) -> bytes:
    """The parity of the number of shingles hashed to each bit."""
    slots = (hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=PARITY_BITS) & 1).tobytes()


def first_shingles(n: int, shared: int) -> int:
    """How many of its first shingles a set of ``n`` needs to share ``shared`` with a similar one."""
    return n - -(-PERCENT * n // 100) + shared


def can_differ(n: int) -> bool:
    """Whether a set of ``n`` can be similar to one that is not equal, of one shingle more."""
    return 100 * n >= PERCENT * (n + 1)


# --- the sets and the order of shingles ---------------------------------------------------

_SETS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_id", pa.binary()),
        ("parity", pa.binary()),
        ("chunk", pa.int64()),
        ("counts", pa.binary()),
    ]
)


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _chosen(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("text_hash"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """What stands for the set of every row, and, in rows with a ``chunk``, counts of shingles."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            np.add.at(counts, _counter(np.concatenate(sets)), np.uint32(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([f(s) for s in sets], pa.binary()) for f in (set_id, parity)),
                    pa.nulls(len(sets), pa.int64()),
                    pa.nulls(len(sets), pa.binary()),
                ],
                schema=_SETS,
            )
        for chunk, some in enumerate(counts.reshape(-1, min(len(counts), COUNTERS_A_ROW))):
            if some.any():
                kind = next(k for k in ("<u1", "<u2", "<u4") if some.max() <= np.iinfo(k).max)
                row = [None, None, None, None, None, chunk, some.astype(kind).tobytes()]
                yield pa.record_batch(
                    [pa.array([v], f.type) for v, f in zip(row, _SETS, strict=True)], schema=_SETS
                )

    return _chosen(docs).mapInArrow(
        made,
        "doc_id long, text_hash long, n_shingles long, set_id binary, parity binary, chunk long, "
        "counts binary",
    )


def counters(made: DataFrame) -> np.ndarray:
    """The counters of all rows: 2^COUNTER_BITS numbers (8 MB), whatever the corpus."""
    width = min(1 << COUNTER_BITS, COUNTERS_A_ROW)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                held = np.frombuffer(counts.as_buffer(), np.uint8)
                held = held.view(f"<u{len(held) // width}").astype(np.int64)
                sums[chunk] = sums.get(chunk, 0) + held
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([total.tobytes()])], names=["chunk", "counts"]
            )

    rows = made.filter("chunk is not null").select("chunk", "counts").repartition("chunk")
    out = np.zeros((1 << COUNTER_BITS) // width * width, np.int64).reshape(-1, width)
    for chunk, counts in rows.mapInArrow(added, "chunk long, counts binary").collect():
        out[chunk] += np.frombuffer(counts, np.int64)
    return np.minimum(out.ravel(), 0xFFFFFFFF).astype(np.uint32)


def in_order(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of sorted hashes, from rare to frequent, equally rare ones by hash."""
    return np.argsort(counts[_counter(hashes)], kind="stable")


def first_of_sets(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``set_id, n_shingles, first, scan`` of every row whose set can have a partner.

    ``first`` are its first shingles, ``scan`` says how long their lists are about. All rows
    of a set have the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    # Counters hold other shingles too; what stands out from that counts as list length.
    mean = float(counts.mean())
    usual = mean + 3 * mean**0.5
    schema = pa.schema(
        [
            ("set_id", pa.binary()),
            ("n_shingles", pa.int64()),
            ("first", pa.binary()),
            ("scan", pa.int64()),
        ]
    )

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_counter = shared.value

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                for text in batch.column("text").to_pylist():
                    hashes = shingles(text)
                    n = len(hashes)
                    if can_differ(n):
                        first = hashes[in_order(hashes, of_counter)[: first_shingles(n, SUBSET)]]
                        lists = of_counter[_counter(first[: first_shingles(n, 1)])]
                        scan = int(np.maximum(lists - usual, 0).sum())
                        yield set_id(hashes), n, first.tobytes(), scan

        yield from batches_of(schema, rows(), 1024)

    return (
        _chosen(docs)
        .select("text")
        .mapInArrow(chosen, "set_id binary, n_shingles long, first binary, scan long")
    )


def texts_of(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows asked for, with a ``node``, beside its ``set_id`` and the texts that should have it.

    A short list of them goes to the texts. Of a longer one the places alone go there first, so
    that texts nobody asks for stay where they are.
    """
    kept = classes.select("node", "set_id", "rep", "rep_hash")
    asked = stage(asked.join(kept, "node"), "asked")

    def here(rep: str, rep_hash: str) -> Column:
        # Ids may be repeated, or null.
        return F.col("doc_id").eqNullSafe(F.col(rep)) & (F.col("text_hash") == F.col(rep_hash))

    chosen = _chosen(docs)
    if table_bytes(asked) <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    else:
        places = asked.select(F.col("rep").alias("at"), F.col("rep_hash").alias("at_hash")).distinct()
        if table_bytes(places) <= BROADCAST_BYTES:
            places = F.broadcast(places)
        chosen = chosen.join(places, here("at", "at_hash"), "left_semi")
    return chosen.join(asked, here("rep", "rep_hash")).drop("doc_id", "text_hash", "rep", "rep_hash")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, hashes`` of the nodes asked for."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                for node, wanted, text in zip(
                    *(batch.column(c).to_pylist() for c in ("node", "set_id", "text")), strict=True
                ):
                    found = shingles(text)
                    # Other rows may have the same id and another text.
                    if set_id(found) == wanted:
                        yield node, found.tobytes()

        yield from batches_of(schema, rows(), 256)

    found = texts_of(docs, classes, nodes.distinct()).select("node", "set_id", "text")
    held = found.mapInArrow(hashed, "node long, hashes binary")
    # Rows repeated as a whole give a set several times.
    return held.dropDuplicates(["node"])


# --- light and heavy sets -----------------------------------------------------------------


def boundary(sizes: list[tuple[int, int, int]]) -> int:
    """Sets of fewer shingles than this are small, from (size, number of sets, list entries scanned).

    Rows beyond the largest boundary may be given as one.
    """
    size, number, scan = (np.array(x, np.int64) for x in zip(*sizes, strict=True))
    first = np.array([first_shingles(int(n), 1) for n in size], np.int64)
    subsets = number * (first + 1) * first // 2  # SUBSET of first + 1
    best = None
    for x in range(1, LARGEST_BOUNDARY + 1):
        light = subsets[size < x].sum()
        lists = (number * first)[100 * size >= PERCENT * x].sum()
        cost = light + lists + COMPARISON_COST * scan[size >= x].sum()
        if best is None or cost < best[0]:
            best = cost, x
    return best[1]


def keys_of(first: np.ndarray, n: int, bound: int) -> np.ndarray:
    """What a set is filed under: subsets of its first shingles, single shingles, or both."""
    keys = []
    if n < bound:
        i, j = np.triu_indices(len(first), 1)
        keys.append(mixed(first[i] * _TIMES[2] + mixed(first[j] ^ _TIMES[3])))
    if 100 * n >= PERCENT * bound:
        keys.append(first[: first_shingles(n, 1)])
    return np.concatenate(keys).view(np.int64)


def shared_keys(firsts: DataFrame, bound: int) -> DataFrame:
    """``key, node`` of every set, as far as others have the key.

    Most keys are of one set only. Those of several are found first, and a bitmap of bounded
    size keeps most others from being sent with their nodes.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def filed(known: Broadcast | None) -> DataFrame:
        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1024):
                lists = [
                    keys_of(np.frombuffer(held.as_buffer(), np.uint64), n, bound)
                    for n, held in zip(
                        batch.column("n_shingles").to_pylist(), batch.column("first"), strict=True
                    )
                ]
                keys = np.concatenate(lists)
                nodes = np.repeat(batch.column("node").to_numpy(), [len(k) for k in lists])
                if known is not None:
                    kept = known.value.has(keys.view(np.uint64))
                    keys, nodes = keys[kept], nodes[kept]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], schema=schema)

        chosen = firsts.select("node", "n_shingles", "first")
        return chosen.mapInArrow(rows, "key long, node long")

    several = filed(None).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    several = stage(several, "shared-keys")
    known = firsts.sparkSession.sparkContext.broadcast(bitmap(several))
    return filed(known).join(several, "key")


# --- pairs ----------------------------------------------------------------------------------


def _parities(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)


def may_link(n: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sizes and parities leave room for the similarity."""
    both = n + m
    good = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    differ = np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)
    return good & ((100 + PERCENT) * differ <= (100 - PERCENT) * both)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted, have the similarity."""
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that sizes and parities do not rule out."""
    both = pairs
    for side in "ab":
        renamed = [F.col(c).alias(f"{c}_{side}") for c in ("n_shingles", "parity")]
        both = both.join(classes.select(F.col("node").alias(side), *renamed), side)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            sizes = [batch.column(f"n_shingles_{s}").to_numpy() for s in "ab"]
            marks = [_parities(batch.column(f"parity_{s}")) for s in "ab"]
            yield batch.select(["a", "b"]).filter(pa.array(may_link(*sizes, *marks)))

    return both.mapInArrow(near, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a written table) whose full sets have the similarity.

    A text goes once to where the pairs of its ``a`` are, those of many in several shares, and
    its set is made there: texts take less room than sets. Rows repeated as a whole are one.
    """
    number = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    share = F.pmod(F.xxhash64("b"), "shares").alias("share")
    dealt = stage(pairs.join(number, "a").select("a", "b", share), "dealt")
    asked = dealt.select("a", "share", F.col("a").alias("node")).distinct()
    asked = asked.unionByName(dealt.select("a", "share", F.col("b").alias("node")))
    # As a is the smaller end, it comes first.
    placed = (
        texts_of(docs, classes, asked)
        .repartition("a", "share")
        .sortWithinPartitions("a", "share", "node")
    )

    def good(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def rows() -> Iterator[tuple]:
            one, done, hashes = None, None, None
            for batch in slices(batches):
                for a, node, wanted, text in zip(
                    *(batch.column(c).to_pylist() for c in ("a", "node", "set_id", "text")), strict=True
                ):
                    if (a, node) == done or (a == node == one):
                        continue
                    found = shingles(text)
                    if set_id(found) != wanted:
                        continue
                    done = a, node
                    if a == node:
                        one, hashes = a, found
                    elif a == one and linked(hashes, found):
                        yield a, node

        yield from batches_of(schema, rows(), AT_ONCE)

    return placed.select("a", "node", "set_id", "text").mapInArrow(good, "a long, b long")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, component`` of the lists that hold more than one component."""
    own = F.coalesce("component", F.col("node")).alias("component")
    known = members.join(labels, "node", "left").select("key", "node", own)
    several = (
        known.groupBy("key")
        .agg(F.min("component").alias("c"), F.max("component").alias("d"))
        .filter("c <> d")
        .select("key")
    )
    return known.join(several, "key")


def _with_smallest(members: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each member with the smallest of its list."""
    hubs = members.groupBy("key").agg(F.min(F.struct("node", "component")).alias("hub"))
    pairs = members.join(hubs, "key").filter(F.col("hub.component") != F.col("component"))
    both = ("node", "hub.node")
    return pairs.select(F.least(*both).alias("a"), F.greatest(*both).alias("b")).distinct()


def _blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``group, role, node, component, n_shingles`` of what is to be compared.

    Members outside the largest component of a list (role 0) meet all its members (role 1),
    both in blocks bounded in number and in shingles. Short lists are whole, in role 1.
    """
    sized = members.join(classes.select("node", "n_shingles"), "node")
    counts = sized.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")
    )
    lists = counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.sum("n").alias("members"),
        _number(F.sum("n") - F.max("n"), BLOCK).alias("blocks"),
        _number(F.sum("n"), MEMBERS).alias("shares"),
    )
    short, one = F.col("members") <= SHORT_LIST, F.lit(1).cast("long")
    lists = lists.withColumns(
        {c: F.when(short, one).otherwise(F.col(c)) for c in ("blocks", "shares")}
    )
    known = sized.join(lists, "key").withColumn("dealt", F.xxhash64("node"))
    kept = ["node", "component", "n_shingles"]

    def role(rows: DataFrame, number: int, own: str, other: str) -> DataFrame:
        return rows.select(
            "key",
            *kept,
            F.lit(number).alias("role"),
            F.pmod("dealt", own).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
        )

    asked = role(known.filter((F.col("component") != F.col("main")) & ~short), 0, "blocks", "shares")
    met = role(known, 1, "shares", "blocks")
    return asked.unionByName(met).select(
        F.xxhash64("key", "blocks", "shares").alias("group"), "role", *kept
    )


def _number(members: Column, each: int) -> Column:
    return F.greatest(F.ceil(members / each), F.ceil(F.sum("shingles") / BLOCK_SHINGLES))


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come by group, in tables that cut no group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column("group").to_numpy()
        if not len(numbers):
            continue
        last = int(np.flatnonzero(numbers == numbers[-1])[0])
        if held and held[-1].column("group")[0].as_py() != numbers[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _edges(numbers: np.ndarray) -> list[tuple[int, int]]:
    cuts = (np.flatnonzero(np.diff(numbers)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(numbers)], strict=True))


def _in_short_lists(lists: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that may be linked, of all lists at once: each row and the s-th after it."""
    numbers, component, n = (
        lists.column(c).to_numpy() for c in ("group", "component", "n_shingles")
    )
    marks = _parities(lists.column("parity").combine_chunks())
    s, rows = 1, np.arange(len(numbers))
    while len(rows := rows[rows < len(numbers) - s]):
        rows = rows[numbers[rows] == numbers[rows + s]]
        apart = rows[component[rows] != component[rows + s]]
        for i in range(0, len(apart), AT_ONCE):
            x = apart[i : i + AT_ONCE]
            y = x + s
            near = may_link(n[x], n[y], marks[x], marks[y])
            yield x[near], y[near]
        s += 1


def _near_in(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components in a group that may be linked, some at a time."""
    role, component, n = (group.column(c).to_numpy() for c in ("role", "component", "n_shingles"))
    marks = _parities(group.column("parity").combine_chunks())
    asked, met = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    # Similar sets are of similar size.
    met = met[np.argsort(n[met], kind="stable")]
    asked = asked[np.argsort(n[asked], kind="stable")]
    step = 64
    for i in range(0, len(asked), step):
        some = asked[i : i + step]
        low, high = n[some[0]] * PERCENT // 100, n[some[-1]] * 100 // PERCENT + 1
        a, b = np.searchsorted(n[met], [low, high + 1])
        width = max(1, AT_ONCE // len(some))
        for j in range(a, b, width):
            others = met[j : min(j + width, b)]
            near = may_link(n[some][:, None], n[others][None], marks[some][:, None], marks[others][None])
            near &= component[some][:, None] != component[others][None]
            x, y = np.nonzero(near)
            yield some[x], others[y]


def _forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]], nodes: np.ndarray, sets) -> list[tuple]:
    """Links that connect what the links among the pairs connect, and no more of them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    links = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(int(nodes[i])), root(int(nodes[j]))
            if a != b and linked(sets[i], sets[j]):
                parent[a] = b
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _across(
    members: DataFrame, classes: DataFrame, docs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Possible pairs ``a, b`` of members of different components, and links from dense blocks."""
    rows = stage(_blocks(members, classes), "blocks")
    tasks = parts(rows.count(), ROWS_PER_TASK)
    marks = classes.select("node", "parity")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "group").sortWithinPartitions("group", "role")

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.int64())])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(nodes: np.ndarray, pairs: list[tuple]) -> pa.RecordBatch:
            left, right = (nodes[np.concatenate(side)] for side in zip(*pairs, strict=True))
            ends = np.unique(np.sort(np.stack([left, right]), axis=0), axis=1)
            arrays = [*map(pa.array, ends), pa.nulls(ends.shape[1], pa.int64())]
            return pa.record_batch(arrays, schema=schema)

        for groups in _whole_groups(batches):
            # Long lists have rows of both roles.
            both, short = [], np.ones(len(groups), bool)
            roles = groups.column("role").to_numpy()
            for a, b in _edges(groups.column("group").to_numpy()):
                if roles[a] == 0:
                    both.append((a, b))
                    short[a:b] = False
            lists = groups.filter(pa.array(short))
            if pairs := list(_in_short_lists(lists)):
                yield links(lists.column("node").to_numpy(), pairs)
            for a, b in both:
                group = groups.slice(a, b - a)
                nodes, pairs, n = group.column("node").to_numpy(), [], 0
                for pair in _near_in(group):
                    pairs.append(pair)
                    n += len(pair[0])
                    if n > max(DENSE, b - a):
                        number = group.column("group")[0].as_py()
                        row = [pa.array([v], pa.int64()) for v in (None, None, number)]
                        yield pa.record_batch(row, schema=schema)
                        break
                else:
                    if n:
                        yield links(nodes, pairs)

    found = stage(
        dealt(rows.join(marks, "node")).mapInArrow(compared, "a long, b long, dense long"), "found"
    )
    dense = stage(
        rows.join(found.filter("dense is not null").select(F.col("dense").alias("group")), "group"),
        "dense",
    )
    sets = full_sets(docs, classes, dense.select("node"))
    again = dense.join(marks, "node").join(sets, "node")

    def connected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole_groups(batches):
            for i, j in _edges(groups.column("group").to_numpy()):
                group = groups.slice(i, j - i)
                held = [np.frombuffer(h.as_buffer(), np.uint64) for h in group.column("hashes")]
                links = _forest(_near_in(group), group.column("node").to_numpy(), held)
                a, b = zip(*links, strict=True) if links else ([], [])
                arrays = [pa.array(x, pa.int64()) for x in (a, b)]
                yield pa.record_batch(arrays, names=["a", "b"])

    pairs = found.filter("dense is null").select("a", "b").distinct()
    return pairs, dealt(again).mapInArrow(connected, "a long, b long")


# --- the operator -----------------------------------------------------------------------------


def shingle_join(docs: DataFrame, *, bound: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, component`` for ``doc_id, text``: one row for every row.

    ``component_id`` is the smallest id that links reach (a null id is no id), ``component`` a
    number of the component, null for texts without words. Texts that are null or have no word
    are linked with nothing and are their own component. Rows that share an id, or are
    repeated as a whole, are separate documents. An empty table gives no row. Other columns
    are ignored. ``bound`` sets the boundary between small and large sets instead of its cost.
    """
    spark = docs.sparkSession
    made = stage(shingle_sets(docs), "sets")
    every = made.filter("chunk is null").select(
        "doc_id", "text_hash", "n_shingles", "set_id", "parity"
    )
    # Null ids are the last.
    smallest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = stage(
        every.filter("n_shingles > 0")
        .groupBy("set_id")
        .agg(
            smallest.alias("row"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("parity").alias("parity"),
        )
        .select(
            "set_id",
            F.col("row.doc_id").alias("rep"),
            F.col("row.text_hash").alias("rep_hash"),
            "n_shingles",
            "parity",
            F.monotonically_increasing_id().alias("node"),
        ),
        "classes",
    )
    # What is written on the way goes when it has been used up.
    with Folders(spark) as lists:
        with Folders(spark) as spent:
            firsts = stage(
                first_of_sets(docs, counters(made))
                .dropDuplicates(["set_id"])
                .join(classes.select("set_id", "node"), "set_id")
                .select("node", "n_shingles", "first", "scan"),
                "firsts",
            )
            if bound is None:
                size = F.least("n_shingles", F.lit(LARGEST_BOUNDARY)).alias("size")
                sizes = firsts.groupBy(size).agg(F.count("*"), F.sum("scan")).collect()
                bound = boundary([tuple(r) for r in sizes]) if sizes else 1
            keyed = shared_keys(firsts, bound)
        members = stage(keyed, "members")
    spent.remove()
    labels = spark.createDataFrame([], "node long, component long")
    for round_ in ("smallest", "rest"):
        with Folders(spark) as spent:
            if round_ == "smallest":
                # Every node is a component of its own.
                apart = members.withColumn("component", F.col("node"))
            else:
                apart = stage(_apart(members, labels), "apart")
            some = bool(apart.head(1))
            if some and round_ == "rest":
                pairs, sure = _across(apart, classes, docs)
            elif some:
                pairs, sure = possible(_with_smallest(apart), classes), None
            if some:
                found = confirmed(stage(pairs, "pairs"), docs, classes)
                known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                links = known.unionByName(found)
                links = links if sure is None else links.unionByName(sure)
        if some:
            labels = components(links)
        spent.remove()
        if not some:
            break
    lists.remove()
    of_class = classes.join(labels, "node", "left").select(
        "set_id", "rep", F.coalesce("component", F.col("node")).alias("component")
    )
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = of_class.join(smallest, "component").select("set_id", "component", "component_id")
    full = every.filter("n_shingles > 0").join(of_set, "set_id")
    empty = every.filter("n_shingles = 0").withColumns(
        {"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}
    )
    chosen = ["doc_id", "n_shingles", "component_id", "component"]
    return full.select(*chosen).unionByName(empty.select(*chosen))


@query(components_sql(WORDS, PERCENT))
def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of shingle sets."""
    return shingle_join(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )
