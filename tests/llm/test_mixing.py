import heapq
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pytest

from filecorpus.llm import mixing as M
from tests.llm.conftest import EDGES


def period_slots(weights: Mapping[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source in one period, earliest deadline first; ties by name.

    The plain form for whole weights, which ``block_slots`` has to agree with.
    """
    q = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting, ready = [(0, s, 0) for s in sorted(weights)], []  # by release, by deadline
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * q // weights[source]), source, k))
        _, source, k = heapq.heappop(ready)
        slots[source].append(slot)
        if k + 1 < weights[source]:
            heapq.heappush(waiting, ((k + 1) * q // weights[source], source, k + 1))
    return {s: np.array(x) for s, x in slots.items()}


@dataclass(frozen=True)
class Run:
    """Blocks of a source that follow one period: block ``first + m`` has the ``m``-th slot."""

    first: int
    base: int  # slots before
    weight: int
    period: int
    slots: np.ndarray


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> dict[str, list[Run]]:
    """The runs of each source, phase by phase, for so many blocks of each."""
    left = {s: n for s, n in blocks.items() if n}
    runs: dict[str, list[Run]] = {s: [] for s in blocks}
    base = 0
    while left:
        active = {s: weights[s] for s in left}
        q, slots = sum(active.values()), period_slots(active)
        last = {s: (n - 1) // active[s] * q + slots[s][(n - 1) % active[s]] for s, n in left.items()}
        length = int(min(last.values())) + 1
        for s in list(left):
            runs[s].append(Run(blocks[s] - left[s], base, active[s], q, slots[s]))
            left[s] -= length // q * active[s] + int(np.searchsorted(slots[s], length % q))
            if not left[s]:
                del left[s]
        base += length
    return runs


def slots_of(runs: list[Run], block: np.ndarray) -> np.ndarray:
    """The slot of each block of a source."""
    of = np.searchsorted([r.first for r in runs], block, side="right") - 1
    out = np.empty(len(block), np.int64)
    for i, r in enumerate(runs):
        m = block[of == i] - r.first
        out[of == i] = r.base + m // r.weight * r.period + r.slots[m % r.weight]
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 97, "b": 89, "c": 13, "d": 1, "e": 1}])
def test_one_period_deviates_by_less_than_a_block(weights):
    q, slots = sum(weights.values()), period_slots(weights)
    order = sorted((s, name) for name, x in slots.items() for s in x)
    assert [s for s, _ in order] == list(range(q))
    served = Counter()
    for t, (_, name) in enumerate(order, 1):
        served[name] += 1
        for other, w in weights.items():
            assert abs(served[other] - Fraction(w * t, q)) < 1


def test_phases_use_every_block_once_and_keep_the_shares():
    blocks, weights = {"a": 50, "b": 7, "c": 200, "d": 0, "e": 1}, {"a": 5, "b": 3, "c": 2, "d": 9, "e": 1}
    runs = schedule(blocks, weights)
    at = {s: slots_of(runs[s], M.np.arange(n)).tolist() for s, n in blocks.items() if n}
    order = sorted((t, s) for s, ts in at.items() for t in ts)
    assert [t for t, _ in order] == list(range(sum(blocks.values())))
    left, served, start = dict(blocks), Counter(), 0
    for t, (_, name) in enumerate(order):
        active = {s: weights[s] for s in left if left[s] + served[s] and s != "d"}
        for s, w in active.items():
            assert abs(served[s] - Fraction(w * (t - start), sum(active.values()))) < 1
        served[name] += 1
        left[name] -= 1
        if not left[name]:  # a phase ends
            served, start = Counter(), t + 1


@pytest.mark.parametrize("weights", [{"a": 7, "b": 2, "c": 1}, {"a": 97, "b": 89, "c": 13, "d": 1, "e": 1}])
def test_slots_of_whole_weights_repeat_the_period(weights):
    period, q = period_slots(weights), sum(weights.values())
    slots = M.block_slots([3 * w for w in weights.values()], list(weights.values()))
    assert slots.tolist() == [t + r * q for s in weights for r in range(3) for t in period[s].tolist()]


def fluid(blocks, weights, t):
    """What each source has had after ``t`` slots, if all were served at once."""
    had, left = dict.fromkeys(blocks, Fraction(0)), Fraction(t)
    while left:
        active = {s: Fraction(weights[s]) for s, n in blocks.items() if had[s] < n}
        total = sum(active.values())
        step = min(left, *((blocks[s] - had[s]) * total / w for s, w in active.items()))
        had |= {s: had[s] + step * w / total for s, w in active.items()}
        left -= step
    return had


@pytest.mark.parametrize(
    "blocks, weights",
    [
        ({"a": 12_000, "b": 40, "c": 7000}, {"a": 2**0.5, "b": 1e-6, "c": 0.7123}),
        ({f"s{i:02}": 400 + 37 * i * i for i in range(20)}, None),
    ],
)
def test_real_weights_over_many_periods(spark, blocks, weights):
    rows = [(0, s, i, 1) for s, n in blocks.items() for i in range(n)]
    rows = [(j, s, i, n) for j, (_, s, i, n) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "number long, source string, doc_id long, size long")
    found = {r["number"]: r["slot"] for r in M.assign_slots(docs, weights, block_chars=1).collect()}
    order = [s for _, s in sorted((found[number], s) for number, s, _, _ in rows)]
    assert sorted(found.values()) == list(range(len(rows)))
    shares = weights or {s: n**0.5 for s, n in blocks.items()}
    served = Counter()
    for t, s in enumerate(order, 1):
        served[s] += 1
        if t % 97 == 0 or t > len(order) - 50 or t < 50:
            assert all(abs(served[x] - had) < 1 for x, had in fluid(blocks, shares, t).items())


def test_more_sources_than_a_thousand(spark):
    rows = [(i, f"site{i % 2500}" if i % 3 else "hot", i, 1) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "number long, source string, doc_id long, size long")
    found = {r["number"]: r["slot"] for r in M.assign_slots(docs, block_chars=1).collect()}
    assert sorted(found.values()) == list(range(len(rows)))
    blocks = Counter(s for _, s, _, _ in rows)
    shares = {s: n**0.5 for s, n in blocks.items()}
    order = [s for _, s in sorted((found[number], s) for number, s, _, _ in rows)]
    for t in (500, 3000, 9000):
        served = Counter(order[:t])
        assert all(abs(served[s] - had) < 1 for s, had in fluid(blocks, shares, t).items())


def mixed(docs, **options):
    return M.mix(docs, **options).rdd.mapPartitions(list).collect()


def test_all_rows_in_the_order_of_the_mix(spark, edges, tmp_path):
    rows = mixed(edges)
    assert sorted(map(str, rows)) == sorted(map(str, edges.collect()))
    assert M.mix(edges).columns == edges.columns
    assert M.mix(edges.filter("doc_id = 99")).count() == 0


def test_blocks_of_a_source_follow_its_ids(spark):
    rows = [(i, "x" * (i % 50), f"s{i % 3}" if i % 7 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 3, "s1": 1, None: 2}  # s2 has none: it comes last
    out = mixed(docs, weights=weights, block_chars=200)
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    for s in ("s0", "s1", "s2", None):
        ids = [r["doc_id"] for r in out if r["source"] == s]
        assert ids == sorted(ids)
    last = [r["source"] for r in out]
    assert "s2" not in last[: last.index("s2")] and set(last[last.index("s2") :]) == {"s2"}
    # As long as all last, characters are in proportion to within two blocks' worth.
    size, total = Counter(), 0
    limits = {s: sum(len(t) for _, t, x in rows if x == s) for s in weights}
    for r in out:
        size[r["source"]] += len(r["text"])
        total += len(r["text"])
        if any(size[s] > 0.95 * n for s, n in limits.items()):
            break
        for s, w in weights.items():
            assert abs(size[s] - total * w / 6) <= 200 * 4


def test_offsets_do_not_depend_on_the_ranges(spark, monkeypatch):
    rows = [(i, i * 37 % 11, "hot" if i % 3 else f"s{i % 5}", i % 97) for i in range(2000)]
    docs = spark.createDataFrame(rows, "number long, doc_id long, source string, size long")
    once = sorted(map(tuple, M.assign_slots(docs, block_chars=500).collect()))
    monkeypatch.setattr(M, "PART_ROWS", 150)
    assert sorted(map(tuple, M.assign_slots(docs, block_chars=500).collect())) == once
    before = Counter()
    by_number = {n: (b, s) for n, b, s, _ in once}
    ends = {n: e for n, _, _, e in once}
    for number, _, source, size in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        assert ends[number] == before[source] and by_number[number][0] == before[source] // 500
        before[source] += size


def test_query(spark):
    rows = M.op8_source_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 1000
    by_slot = {}
    for r in rows:
        assert by_slot.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])


def test_edges_have_sources(edges):
    assert edges.count() == len(EDGES)


def test_other_columns_keep_names_and_values(spark):
    rows = [(i, f"text {i}", "s", i, -i, i + 0.5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __number long, __SLOT int, __before double")
    assert sorted(map(tuple, M.mix(docs).collect())) == rows
