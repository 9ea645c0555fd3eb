"""The trie of conversation prefixes by truncation peeling.

A task has a range of the conversations in the order of their turns. It descends from the
deepest of them: at each depth it puts the conversations that end there beside the nodes that
have survived from below, regroups both by the path that they share (neighbours in the order
share it as far as their common beginning goes), writes the nodes that this makes, strips
their last turn and goes on.

Only nodes on the way to a range's first or last conversation may have members in other
ranges. Those stay open: of them a task gives what its other nodes add up to, as an item that
can be peeled again like a conversation, and the few items of all ranges are dealt into ranges
and peeled in turn, until one range holds them. So neither a node of very many members nor one
conversation that occurs very often, nor any depth, makes a task larger or more jobs needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm.common import batches_of, parts, query, slices, table
from filecorpus.operators.joins import BROADCAST_BYTES, lookup_join, table_bytes
from filecorpus.staging import stage

SHARED_EVERY, SHARED_TURNS = 100, 6
RANGE_ITEMS = 20_000
RANGE_TURNS = 2_000_000
IDS_A_CHUNK = 4096

_ITEM = ["path", "lengths", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
# Items that stay open, nodes that are done, and pieces of the lists of open nodes' ends.
_PEELED = pa.schema(
    [
        ("kind", pa.string()),
        ("path", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends", pa.string()),
    ]
)
_PEELED_SPARK = (
    "kind string, path array<long>, lengths array<int>, node binary, parent binary, conv_id long,"
    " depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends string"
)
NODE = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as digest and length.

    Turns come by number (null first); of equal number, by digest. A null role or text is
    empty. Rows without an id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.length(text).alias("chars"),
    )
    known = conversations.select(F.col("conv_id").cast("long"), turn.alias("t")).filter(
        "conv_id is not null"
    )
    lists = known.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select(
        "conv_id", F.transform("turns", lambda t: t.dropFields("turn")).alias("turns")
    )


def with_shared_beginnings(lists: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % 100, if there are any.

    h is crc32 of the decimal c, mod 6; if the other one is absent the first h turns just go.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    heads = lists.filter(c % SHARED_EVERY == 0).select(
        c.alias("base"), F.slice("turns", 1, SHARED_TURNS).alias("head")
    )
    own = lists.withColumn("base", c - c % SHARED_EVERY)
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def items_of(lists: DataFrame) -> DataFrame:
    """Conversations as items: the path is the digests of the turns, two numbers a turn."""
    path = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    zero = F.lit(0).cast("long")
    return lists.select(
        path.alias("path"),
        F.col("turns.chars").alias("lengths"),
        "conv_id",
        F.lit(1).cast("long").alias("n_convs"),
        *(zero.alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )


def _node_id(path: np.ndarray, depth: int) -> bytes:
    return hashlib.md5(path[: 2 * depth].tobytes()).digest()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return (int(differ[0]) if len(differ) else n) // 2


def _groups(first: np.ndarray, row_group: np.ndarray) -> np.ndarray:
    """Where groups of neighbours begin, for parts that begin at rows ``first``."""
    of = row_group[first]
    begins = np.ones(len(of), bool)
    begins[1:] = of[1:] != of[:-1]
    return np.flatnonzero(begins)


class Peeling:
    """Items of a range, in the order of paths and ids, peeled from the deepest to the root.

    Those of the ``first`` round are conversations; with ``whole`` there is no other range.
    """

    def __init__(self, rows: list[tuple], first: bool, whole: bool) -> None:
        self.paths = [np.asarray(r[0], np.int64) for r in rows]
        self.lengths = [r[1] for r in rows]
        self.depths = np.array([len(p) // 2 for p in self.paths], np.int64)
        # conv_id, n_convs, n_children, n_leaves, saved_tokens
        self.values = np.array([r[2:7] for r in rows], np.int64).reshape(-1, 5)
        common = [_common(x, y) for x, y in zip(self.paths, self.paths[1:], strict=False)]
        self.common = np.array([-1, *common], np.int64)
        self.first, self.whole = first, whole

    def _open_depths(self) -> tuple[int, int]:
        """Down to which depth nodes with the first and the last row may go on elsewhere."""
        return (-1, -1) if self.whole else (int(self.depths[0]), int(self.depths[-1]))

    def peel(self) -> Iterator[tuple]:
        """Rows of ``_PEELED``."""
        n = len(self.depths)
        by_depth = np.argsort(-self.depths, kind="stable")
        first_open, last_open = self._open_depths()
        alive = np.empty(0, np.int64)  # rows that reach the depth, in order
        added = 0
        surviving = (np.empty(0, np.int64), np.empty((0, 5), np.int64))
        children: list[tuple] = []
        for depth in range(int(self.depths.max()), -1, -1):
            k = added
            while k < n and self.depths[by_depth[k]] == depth:
                k += 1
            ending = np.sort(by_depth[added:k])
            added = k
            alive = np.sort(np.concatenate([alive, ending]))
            # Rows that reach the depth share a node with the one before if that is their
            # neighbour and their paths agree so far.
            new = np.ones(len(alive), bool)
            new[1:] = (np.diff(alive) > 1) | (self.common[alive[1:]] < depth)
            row_group = np.zeros(n, np.int64)
            row_group[alive] = np.cumsum(new)
            first = np.concatenate([surviving[0], ending])
            values = np.concatenate([surviving[1], self.values[ending]])
            # Of a node that has survived only its sums go on.
            order = np.argsort(first, kind="stable")
            first, values = first[order], values[order]
            at = _groups(first, row_group)
            node_rows, value = first[at], np.add.reduceat(values, at, axis=0)
            value[:, 0] = np.minimum.reduceat(values[:, 0], at)
            group = row_group[node_rows]
            opened = np.zeros(len(at), bool)
            if depth <= first_open:
                opened |= group == row_group[0]
            if depth <= last_open:
                opened |= group == row_group[n - 1]
            number = {int(g): i for i, g in enumerate(group.tolist())}
            for child in children:
                i = number[int(row_group[child[0]])]
                yield self._done(child, None if opened[i] else int(value[i, 0]))
            children, kept = [], []
            ends = self._ends(ending, row_group)
            for i, (row, is_open) in enumerate(zip(node_rows.tolist(), opened.tolist(), strict=True)):
                low, convs, below, leaves, saved = value[i].tolist()
                ids = ends.get(int(group[i]), [])
                if is_open:
                    path, lengths = self.paths[row][: 2 * depth], self.lengths[row][:depth]
                    yield self._item(path, lengths, low, depth, convs, below, leaves, saved)
                    yield from self._pieces(path, depth, ids)
                    continue
                leaves = leaves if below else 1
                if depth:
                    saved += (convs - 1) * self.lengths[row][depth - 1]
                digest = self._digest(ids) if self.first else None
                children.append((row, depth, low, convs, below, leaves, saved, digest))
                kept.append((row, low, convs, 1, leaves, saved))
            survived = np.array(kept, np.int64).reshape(-1, 6)
            surviving = (survived[:, 0], survived[:, 1:])
        for child in children:
            yield self._done(child, None)

    def _ends(self, ending: np.ndarray, row_group: np.ndarray) -> dict[int, list[int]]:
        """The ids of conversations that end in each group."""
        found: dict[int, list[int]] = {}
        if self.first:
            for row in ending.tolist():
                found.setdefault(int(row_group[row]), []).append(int(self.values[row, 0]))
        return found

    def _digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    def _pieces(self, path: np.ndarray, depth: int, ids: list[int]) -> Iterator[tuple]:
        for i in range(0, len(ids), IDS_A_CHUNK):
            some = ids[i : i + IDS_A_CHUNK]
            node = _node_id(path, depth)
            yield ("ends", None, None, node, None, some[0], *[None] * 6, ",".join(map(str, some)))

    def _item(self, path, lengths, low, depth, convs, below, leaves, saved) -> tuple:
        return (
            "item", path.tolist(), list(lengths), None, None, low, depth, None,
            convs, below, leaves, saved, None,
        )

    def _done(self, child: tuple, parent_conv: int | None) -> tuple:
        row, depth, low, convs, below, leaves, saved, digest = child
        path = self.paths[row]
        parent = _node_id(path, depth - 1) if depth and parent_conv is None else None
        node = None if self.first else _node_id(path, depth)
        return (
            "node", None, None, node, parent, low, depth, parent_conv,
            convs, below, leaves, saved, digest,
        )


def _peel(items: DataFrame, ranges: int, first: bool, whole: bool) -> DataFrame:
    """One round: ranges of items, or all of them in one."""

    def peeled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in slices(batches, 1024):
            columns = [batch.column(c) for c in batch.schema.names]
            paths = [np.array(p.values) for p in columns[0]]
            rest = [c.to_pylist() for c in columns[1:]]
            rows += zip(paths, *rest, strict=True)
        if rows:
            yield from batches_of(_PEELED, Peeling(rows, first, whole).peel(), 2000)

    chosen = items.select(_ITEM)
    if whole:
        dealt = chosen.coalesce(1)
    else:
        dealt = chosen.repartitionByRange(ranges, "path", "conv_id")
    return dealt.sortWithinPartitions("path", "conv_id").mapInArrow(peeled, _PEELED_SPARK)


def _digests(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of lists in pieces, each list read as a stream."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            node, state = None, None
            for batch in batches:
                for key, text in zip(
                    batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True
                ):
                    if key != node:
                        if node is not None:
                            yield node, state.hexdigest()
                        node, state = key, hashlib.sha256(text.encode())
                    else:
                        state.update(("," + text).encode())
            if node is not None:
                yield node, state.hexdigest()

        yield from batches_of(schema, rows(), 2000)

    chosen = pieces.select("node", "conv_id", "ends")
    dealt = chosen.repartition("node").sortWithinPartitions("node", "conv_id")
    return dealt.mapInArrow(streamed, "node binary, ends_sha256 string")


def prefix_trie(
    lists: DataFrame, *, range_items: int = RANGE_ITEMS, range_turns: int = RANGE_TURNS
) -> DataFrame:
    """The nodes of the trie of ``conv_id, turns``, as ``turn_lists`` gives them; columns ``NODE``.

    One row per distinct sequence of first turns, the root (no turn) included: the smallest
    member, depth, the parent's smallest member (root: null), members, children, childless
    nodes at or below, tokens saved at or below (a node's members but one, times the length
    of its last text), and the digest of the sorted ids of the members that end there. No
    conversation, no row. Two turns are equal if 128 bits of their role and text are. A
    conversation's digests and lengths (20 bytes a turn) are held in one row.
    """
    items = stage(items_of(lists), "conversations")
    empty = hashlib.sha256(b"").hexdigest()
    found, ends, left = None, None, None
    while True:
        n, turns = items.agg(F.count("*"), F.sum(F.size("lengths"))).head()
        # Every round leaves at most two paths of open nodes a range.
        ranges = max(parts(n, range_items), parts(turns or 0, range_turns))
        first = left is None
        whole = not first and (ranges == 1 or n >= left)
        left = n
        peeled = stage(_peel(items, ranges, first, whole), "peeled")
        nodes = peeled.filter("kind = 'node'").drop("kind")
        found = nodes if found is None else found.unionByName(nodes)
        pieces = peeled.filter("kind = 'ends'")
        ends = pieces if ends is None else ends.unionByName(pieces)
        if whole:
            break
        items = peeled.filter("kind = 'item'")
    digests = stage(_digests(ends), "digests")
    # Nodes that were open know neither their list's digest nor, some, their parent.
    opened = found.filter("node is not null").select("node", "conv_id")
    known = stage(opened.join(digests, "node", "left"), "open-nodes")
    small = table_bytes(known) <= BROADCAST_BYTES
    parents = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    of_node = known.select("node", "ends_sha256")
    salt_on = ["conv_id", "depth"]
    kept = [*NODE[:2], "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def parent(rows: DataFrame) -> DataFrame:
        waiting = rows.filter("parent is not null")
        filled = lookup_join(waiting, parents, "parent", salt_on, small)
        done = rows.filter("parent is null").withColumn("of_parent", F.col("parent_conv_id"))
        return filled.unionByName(done.select(filled.columns)).select(
            *kept, F.col("of_parent").alias("parent_conv_id"), "node", "ends"
        )

    rows = parent(found)
    at_once = rows.filter("node is null").withColumn("ends_sha256", F.col("ends"))
    later = rows.filter("node is not null").join(of_node, "node", "left")
    later = later.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return at_once.select(NODE).unionByName(later.select(NODE))


@query()
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations with shared beginnings."""
    lists = turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie(with_shared_beginnings(stage(lists, "turns")))
