"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its five-word shingles. Equal sets are one class, and classes are
what is compared. A signature has ``POSITIONS`` b-bit minima, and two signatures are
candidates if at most ``RADIUS`` positions differ. Cut into ``CHUNKS`` chunks, such a pair
has, by pigeonhole, a chunk with at most ``RADIUS // CHUNKS`` = 1 error; so a signature is
filed, for each chunk and each position left out of it, under the values of the rest of the
chunk, and every pair within the radius meets in a bucket. (At similarity 0.75 a pair has 16
differing positions on average and more than 31 once in some 60,000 times.) A second, wider
signature of ``WIDE`` one-byte minima, within ``WIDE_RADIUS`` by the same measure, spares
most pairs that are not similar enough.

Only components are asked for, so a bucket's pairs are never written out. Its members are
first linked to its smallest member, then, where more than one component is left, to its
largest, and at last members of different components are compared in blocks, by signature;
only pairs within both radii leave a block, each from the first bucket it shares. A block
with more such pairs than members does not write them out: it is compared once more with the
full sets beside it, and only a spanning forest of its links leaves it. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm.common import batches_of, parts, query, slices, table, unused
from filecorpus.staging import stage

WORDS = 5
PERCENT = 75
POSITIONS, CHUNKS = 64, 16
RADIUS = 31
WIDE, WIDE_RADIUS = 256, 96
BLOCK, MEMBERS = 2048, 65_536
BLOCK_SHINGLES = 4 << 20
PAIRS_AT_ONCE = 16_384
DENSE = 256
ROWS_PER_TASK = 20_000

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: a 64-bit finaliser


def _odd_numbers(seed: int, n: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    return random.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BY_WORD = _odd_numbers(1, WORDS)
_XOR, _TIMES = _odd_numbers(2, POSITIONS), _odd_numbers(3, POSITIONS)
_WIDE_XOR, _WIDE_TIMES = (_odd_numbers(s, WIDE).astype(np.uint32) for s in (4, 5))


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in zip((30, 27), _MIX, strict=True):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A text of one to four words has one, that of all its words; without words there is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = pd.util.hash_array(np.array(words, object), categorize=False)
    n = min(len(words), WORDS)
    rows = len(words) - n + 1
    total = np.full(rows, n, np.uint64)
    for k in range(n):
        total += hashed[k : k + rows] * _BY_WORD[k]
    return np.unique(mixed(total))


def set_id(hashes: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set."""
    first = mixed(hashes).sum(dtype=np.uint64)
    second = mixed(hashes * _TIMES[0] + _XOR[0]).sum(dtype=np.uint64)
    return first.tobytes() + second.tobytes()


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of each position's minimum [set, position], of both signatures.

    Empty sets have zeros.
    """
    narrow = np.zeros((len(sets), POSITIONS), np.uint16)
    wide = np.zeros((len(sets), WIDE), np.uint8)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        every = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for k in range(POSITIONS):
            least = np.minimum.reduceat((every ^ _XOR[k]) * _TIMES[k], starts)
            narrow[full, k] = least & np.uint64(0xFFFF)
        every = (every >> np.uint64(32)).astype(np.uint32)
        for k in range(WIDE):
            least = np.minimum.reduceat((every ^ _WIDE_XOR[k]) * _WIDE_TIMES[k], starts)
            wide[full, k] = least & np.uint32(0xFF)
    return narrow, wide


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """The buckets of each signature [signature, chunk and position left out]."""
    size, wide = POSITIONS // CHUNKS, signature.astype(np.uint64)
    keys = []
    for chunk in range(CHUNKS):
        for left_out in range(size):
            key = np.full(len(wide), chunk * size + left_out, np.uint64)
            for i in range(size):
                if i != left_out:
                    key = (key << np.uint64(16)) ^ wide[:, chunk * size + i]
            keys.append(mixed(key * _TIMES[1]).view(np.int64))
    return np.stack(keys, axis=1)


def first_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first bucket (its place in ``bucket_keys``) that the signatures of each pair share."""
    size = POSITIONS // CHUNKS
    same = (left == right).reshape(-1, CHUNKS, size)
    chunk = (same.sum(axis=2) >= size - 1).argmax(axis=1)
    return chunk * size + same[np.arange(len(same)), chunk].argmin(axis=1)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _signatures_of(batch: pa.RecordBatch, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    return (
        _matrix(batch.column(f"signature{side}"), "<u2", POSITIONS),
        _matrix(batch.column(f"wide{side}"), "u1", WIDE),
    )


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_id", pa.binary()),
        ("signature", pa.binary()),
        ("wide", pa.binary()),
    ]
)


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id, signature, wide`` of every row of ``doc_id, text``."""

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) for s in sets], pa.binary()),
                    *(pa.array([s.tobytes() for s in x], pa.binary()) for x in signatures(sets)),
                ],
                schema=_SIGNED,
            )

    chosen = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")
    )
    return chosen.mapInArrow(
        signed,
        "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary, wide binary",
    )


def shared_buckets(classes: DataFrame) -> DataFrame:
    """``key, slot, node`` of every class in a bucket with others; ``slot`` tells its kind."""
    schema = pa.schema([("key", pa.int64()), ("slot", pa.int8()), ("node", pa.int64())])

    def filed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            keys = bucket_keys(_matrix(batch.column("signature"), "<u2", POSITIONS))
            slots = np.tile(np.arange(keys.shape[1], dtype=np.int8), len(keys))
            nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                list(map(pa.array, (keys.ravel(), slots, nodes))), schema=schema
            )

    keys = classes.select("node", "signature").mapInArrow(filed, "key long, slot byte, node long")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return keys.join(several, "key")


def within_radius(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures and set sizes allow a link."""
    both = pairs
    for side in "ab":
        renamed = [F.col(c).alias(f"{c}_{side}") for c in ("n_shingles", "signature", "wide")]
        both = both.join(classes.select(F.col("node").alias(side), *renamed), side)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            sizes = [batch.column(f"n_shingles_{side}").to_numpy() for side in "ab"]
            (left, left_wide), (right, right_wide) = (_signatures_of(batch, f"_{s}") for s in "ab")
            good = _close(left, right, RADIUS) & _close(left_wide, right_wide, WIDE_RADIUS)
            yield batch.select(["a", "b"]).filter(pa.array(good & _alike(*sizes)))

    return both.mapInArrow(near, "a long, b long")


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    return (left != right).sum(axis=-1) <= radius


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of such sizes can have the similarity."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted, have the similarity."""
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    both = pairs
    for side in "ab":
        both = both.join(sets.select(F.col("node").alias(side), F.col("hashes").alias(f"h{side}")), side)

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for left, right in zip(batch.column("ha"), batch.column("hb"), strict=True):
                good.append(_linked(*(np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(linked, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, hashes`` for ``node, rep, set_id``; ``rep`` is the id of a document with the set."""
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

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.join(nodes, texts["doc_id"].eqNullSafe(nodes["rep"])).select(
        "node", "set_id", "text"
    )
    # Rows repeated as a whole give a set several times.
    return found.mapInArrow(hashed, "node long, hashes binary").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b``: the smallest node it can reach.

    Large-star and small-star steps until all edges are stars (Kiveris et al.); every state is
    written, so a lost executor costs one step at most. The loop ends when a large-star step
    has moved no edge and every node has one smaller neighbour.
    """
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stage(ordered.filter("u <> v").distinct(), "edges")
    while True:
        large = stage(_large_star(edges), "edges")
        most, moved = _shape(large)
        edges = large.select("u", "v")
        # Where no node has two smaller neighbours, a small-star step changes nothing.
        if most > 1:
            edges = stage(_small_star(edges), "edges")
        elif not moved:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every edge goes from its larger end to the smallest neighbour of its smaller one."""
    below = _least(edges).withColumnRenamed("u", "v")
    found = edges.join(below, "v", "left").select(
        "u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")
    )
    return found.groupBy("u", "v").agg(F.max("moved").alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of these."""
    least = _least(edges)
    small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """The most smaller neighbours of a node, and whether any edge has moved."""
    nodes = edges.groupBy("u").agg(F.count("*").alias("n"), F.max("moved").alias("moved"))
    most, moved = nodes.agg(F.max("n"), F.max("moved")).head()
    return most or 0, bool(moved)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with their ``component``."""
    own = F.coalesce("component", F.col("node")).alias("component")
    known = members.join(labels, "node", "left").select("key", "slot", "node", own)
    several = (
        known.groupBy("key")
        .agg(F.min("component").alias("c"), F.max("component").alias("d"))
        .filter("c <> d")
        .select("key")
    )
    return known.join(several, "key")


def _to_hub(members: DataFrame, hub: str) -> DataFrame:
    """Pairs of each member with the smallest or largest of its bucket (``min`` or ``max``)."""
    of_key = members.groupBy("key").agg(
        getattr(F, hub)(F.struct("node", "component")).alias("hub")
    )
    apart = members.join(of_key, "key").filter(F.col("hub.component") != F.col("component"))
    return apart.select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")
    ).distinct()


def _blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows ``group, role, slot, node, component, n_shingles`` of blocks to be compared.

    Members outside the component that has most of a bucket are dealt into blocks, bounded in
    number and in the size of their sets (role 0), and every member (role 1) meets every block
    of its bucket; so a bucket's work is split over as many tasks as it needs, and a bucket of
    one large component costs little.
    """
    sized = members.join(classes.select("node", "n_shingles"), "node")
    counts = sized.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")
    )
    buckets = counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.greatest(
            F.ceil((F.sum("n") - F.max("n")) / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)
        ).alias("blocks"),
        F.ceil(F.sum("n") / MEMBERS).alias("shares"),
    )
    known = sized.join(buckets, "key").withColumn("dealt", F.xxhash64("node"))
    own_block, own_share = (F.pmod("dealt", F.col(c)) for c in ("blocks", "shares"))
    numbers = {c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("blocks", "shares")}
    kept = ["slot", "node", "component", "n_shingles"]
    asked = known.filter("component <> main").select(
        "key", *kept, own_block.alias("block"), numbers["shares"].alias("share"), F.lit(0).alias("role")
    )
    met = known.select(
        "key", *kept, numbers["blocks"].alias("block"), own_share.alias("share"), F.lit(1).alias("role")
    )
    return asked.unionByName(met).select(
        F.xxhash64("key", "block", "share").alias("group"), "role", *kept
    )


@dataclass
class _Group:
    """The block being compared, and the pairs that it has so far."""

    number: int | None = None
    asked: list[list[np.ndarray]] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    n_asked: int = 0
    n_pairs: int = 0

    parent: dict[int, int] = field(default_factory=dict)

    def dense(self) -> bool:
        return self.n_pairs > max(DENSE, self.n_asked)

    def _root(self, node: int) -> int:
        parent = self.parent
        while (up := parent.get(node, node)) != node:
            parent[node] = parent.get(up, up)
            node = up
        return node

    def forest(self, who, x, full, node, y, sets) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs the links that connect what no earlier link of the group connects."""
        kept = []
        for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            a, b = self._root(int(who[i])), self._root(int(node[j]))
            if a != b and _linked(full[i], sets[j]):
                self.parent[a] = b
                kept.append(k)
        return x[kept], y[kept]


def _compare(batches: Iterable[pa.RecordBatch], whole: bool) -> Iterator[tuple[_Group, bool]]:
    """The group, after each of its parts; the flag says that it is complete.

    Rows come by group and role. With ``whole`` they have the full sets, and pairs are links.
    """
    group = _Group()
    for batch in slices(batches, 1024):
        numbers, role, slot, node, component, size = (
            batch.column(c).to_numpy()
            for c in ("group", "role", "slot", "node", "component", "n_shingles")
        )
        signature, wide = _signatures_of(batch)
        sets = np.empty(len(node), object)
        if whole:
            sets[:] = [np.frombuffer(h.as_buffer(), np.uint64) for h in batch.column("hashes")]
        rows = (node, component, size, signature, wide, sets)
        edges = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *edges], [*edges, len(numbers)], strict=True):
            if numbers[a] != group.number:
                yield group, True
                group = _Group(numbers[a])
            met = a + int(np.searchsorted(role[a:b], 1))
            if met > a:
                held = [x[a:met].copy() for x in rows]
                held[-1][:] = [x.copy() if whole else None for x in held[-1]]
                group.asked.append(held)
                group.n_asked += met - a
            for who, of, n, marks, more, full in group.asked:
                # So many at a time that the comparison fits in the cache.
                step = max(1, PAIRS_AT_ONCE // len(who))
                for i in range(met, b, step):
                    if group.dense() and not whole:
                        break
                    j = min(i + step, b)
                    near = _close(marks[:, None], signature[None, i:j], RADIUS)
                    near &= _alike(n[:, None], size[None, i:j])
                    x, y = np.nonzero(near & (of[:, None] != component[None, i:j]))
                    y += i
                    good = _close(more[x], wide[y], WIDE_RADIUS)
                    good &= first_slots(marks[x], signature[y]) == slot[y]
                    x, y = x[good], y[good]
                    if whole:
                        x, y = group.forest(who, x, full, node, y, sets)
                    group.pairs.append(np.sort(np.stack([who[x], node[y]]), axis=0))
                    group.n_pairs += len(x)
            yield group, False
    yield group, True


def _across(members: DataFrame, classes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates ``a, b``, and links ``a, b``, of bucket members in different components."""
    rows = stage(_blocks(members, classes), "blocks")
    marks = classes.select("node", "signature", "wide")

    # Rows are few for the work they make, so their number says how many tasks there are.
    tasks = parts(rows.count(), ROWS_PER_TASK)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "group").sortWithinPartitions("group", "role")

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.int64())])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, over in _compare(batches, whole=False):
            if group.dense():
                group.pairs = []
            if over and group.n_pairs:
                if group.dense():
                    a, b, dense = [None], [None], [group.number]
                else:
                    (a, b), dense = np.concatenate(group.pairs, axis=1), None
                    dense = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(dense, pa.int64())],
                    schema=schema,
                )

    found = stage(
        dealt(rows.join(marks, "node")).mapInArrow(compared, "a long, b long, dense long"), "found"
    )
    dense = found.filter("dense is not null").select(F.col("dense").alias("group"))
    again = rows.join(dense, "group").join(marks, "node").join(sets, "node")

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in _compare(batches, whole=True):
            if group.n_pairs:
                a, b = np.concatenate(group.pairs, axis=1)
                group.pairs, group.n_pairs = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    candidates = found.filter("dense is null").select("a", "b").distinct()
    return candidates, dealt(again).mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component, component_id, kept`` for ``doc_id, text``.

    One row for every row. ``component_id`` is the smallest id that links reach (a null id is
    no id), ``kept`` says that it is the row's own; ``component`` is a number of the component
    (null for texts without words), which tells those apart whose smallest ids are equal or
    null. Texts that are null or have no word are linked with nothing and are their own
    component. Rows that share id and text give equal rows; rows that share an id only are
    separate documents. An empty table gives no row. Other columns are ignored.
    """
    signed = stage(sign(docs), "signed")
    classes = stage(
        signed.filter("n_shingles > 0")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("wide").alias("wide"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    members = stage(shared_buckets(classes), "members")
    nodes = members.select("node").distinct().join(classes.select("node", "rep", "set_id"), "node")
    sets = stage(full_sets(docs, nodes), "sets")
    labels = docs.sparkSession.createDataFrame([], "node long, component long")
    for round_ in ("min", "max", "rest"):
        apart = stage(_labelled(members, labels), "apart")
        if not apart.head(1):
            break
        if round_ == "rest":
            pairs, sure = _across(apart, classes, sets)
            found = stage(confirmed(stage(pairs, "pairs"), sets).unionByName(sure), "links")
        else:
            pairs = within_radius(_to_hub(apart, round_), classes)
            found = stage(confirmed(stage(pairs, "pairs"), sets), "links")
        known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(known.unionByName(found))
    of_class = classes.join(labels, "node", "left").select(
        "set_id", "rep", F.coalesce("component", F.col("node")).alias("component")
    )
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = of_class.join(smallest, "component").select("set_id", "component", "component_id")
    full = signed.filter("n_shingles > 0").join(of_set, "set_id")
    empty = signed.filter("n_shingles = 0").withColumns(
        {"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}
    )
    chosen = ["doc_id", "text_hash", "n_shingles", "component", "component_id"]
    return (
        full.select(*chosen)
        .unionByName(empty.select(*chosen))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all columns; of equal rows, one.

    Texts without words are no group, so all their rows stay, but for equal ones. A null id
    is an id like others, smaller than all. Other columns may have any names. An empty table
    gives no row.
    """
    kept = stage(near_duplicates(docs).filter("kept"), "kept")
    # Rows that share an id may be linked: one of them stays.
    one = F.when(F.col("n_shingles") > 0, F.lit(0)).otherwise(F.col("text_hash"))
    chosen = kept.groupBy("doc_id", "component", one.alias("one")).agg(
        F.min("text_hash").alias("hash")
    )
    chosen = chosen.select(F.col("doc_id").alias("kept_id"), "hash")
    hashed = unused("__hash", docs.columns)
    rows = docs.withColumn(hashed, F.xxhash64("text"))
    same = rows["doc_id"].cast("long").eqNullSafe(chosen["kept_id"]) & (rows[hashed] == chosen["hash"])
    found = rows.join(chosen, same, "left_semi")
    # Only if rows are repeated need whole rows meet once more.
    if kept.groupBy("doc_id", "text_hash").count().filter("count > 1").head(1):
        found = found.dropDuplicates(["doc_id", hashed])
    return found.drop(hashed)


@query()
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document, and whether it is the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )
