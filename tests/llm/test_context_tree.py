import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from filecorpus.llm import context_tree as C
from tests.llm.conftest import EDGES


def words(text):
    return (text or "").encode().lower().split()


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """Context-tree weighting written as its definition, one dictionary of nodes."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, node, bit in self.steps(text):
                for d in range(depth + 1):
                    self.counts[context[:d], node][bit] += 1
                    if d:
                        self.children[context[: d - 1], node].add(context[:d])
        self.memo = {}

    def steps(self, text):
        data = b" ".join(words(text)) + b"\n"
        padded = b"\n" * self.depth + data
        for i, symbol in enumerate(data):
            context, node = padded[i : i + self.depth][::-1], 1
            for j in range(7, -1, -1):
                bit = symbol >> j & 1
                yield context, node, bit
                node = node * 2 + bit

    def logs(self, context, node):
        """log of the estimate and of the weighted probability."""
        key = context, node
        if key not in self.memo:
            own = kt(*self.counts.get(key, (0, 0)))
            if len(context) == self.depth:
                self.memo[key] = own, own
            else:
                below = sum(self.logs(c, node)[1] for c in self.children.get(key, ()))
                self.memo[key] = own, np.logaddexp(own, below) - math.log(2)
        return self.memo[key]

    def chance(self, context, node, bit, d=0):
        key = context[:d], node
        n = self.counts.get(key, (0, 0))
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == self.depth:
            return own
        e, w = self.logs(*key)
        share = math.exp(e - math.log(2) - w)
        return share * own + (1 - share) * self.chance(context, node, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.chance(*step)) for step in self.steps(text))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def expected(rows, depth):
    train = [t for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    tree = Tree(train, depth)
    out = []
    for doc_id, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        known = sum(counts[w] > 0 for w in tokens)
        out.append((doc_id, held(doc_id), len(tokens), known, total, base, tree.score(text)))
    return out


def compare(found, wanted):
    key = lambda r: (r[0] is not None, r[0] or 0, round(r[5], 6), round(r[6], 2))
    found = sorted((tuple(r) for r in found), key=key)
    for got, want in zip(found, sorted(wanted, key=key), strict=True):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:], rel=1e-5, abs=1e-6)


def texts(seed, n):
    r = random.Random(seed)
    some = ["the", "cat", "sat", "on", "The", "é", "mat.", "zzz", "日本"]
    return [(i, r.choice(["\n", " ", "\t "]).join(r.choices(some, k=r.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize("depth, run_bytes, bucket_bytes", [(5, 1 << 20, 1 << 20), (2, 300, 200), (4, 50, 100), (6, 40, 10**9)])
def test_against_the_definition(corpus, depth, run_bytes, bucket_bytes):
    rows = texts(depth, 60)
    got = C.context_tree_scores(corpus(rows), depth=depth, run_bytes=run_bytes, bucket_bytes=bucket_bytes)
    compare(got.collect(), expected(rows, depth))


def test_groups_of_groups(corpus, monkeypatch):
    monkeypatch.setattr(C, "FAN_IN", 2)
    rows = texts(8, 80)
    got = C.context_tree_scores(corpus(rows), depth=3, run_bytes=60, bucket_bytes=10**9)
    compare(got.collect(), expected(rows, 3))


def test_edges(corpus):
    rows = [(i, t[:3000] if t else t) for i, t in EDGES]
    compare(C.context_tree_scores(corpus(rows), run_bytes=500).collect(), expected(rows, C.DEPTH))


def test_long_texts_in_pieces_and_no_rows(corpus):
    rows = [(1, "word and more " * 500), (2, "x" * 5000), (3, "a b")]
    compare(C.context_tree_scores(corpus(rows), run_bytes=700).collect(), expected(rows, C.DEPTH))
    assert C.context_tree_scores(corpus(rows).filter("doc_id = 99")).count() == 0


def test_nothing_to_learn_from(corpus):
    rows = [(i, "some text") for i in range(200) if held(i)]
    compare(C.context_tree_scores(corpus(rows)).collect(), expected(rows, C.DEPTH))


def test_probabilities_of_all_bytes_add_up_to_one():
    rng = np.random.default_rng(1)
    keys, _ = C.distinct(rng.integers(0, 1 << 48, 500, dtype=np.uint64) & np.uint64(0x0103_0103_01FF))
    every = np.array([0x0001_0203_0100 | s for s in range(256)], np.uint64)
    both, _ = C.distinct(np.concatenate([keys, every]))
    counts = np.where(np.isin(both, keys), rng.integers(0, 50, len(both)), 0)
    levels, place, bit = C.build_levels(both, counts, 5)
    zeros, ones = rng.integers(0, 90, (2, 256, 256))
    top = C.Top.of(zeros, ones, -rng.random((256, 256)) * 40)
    logs = C.log10_chances(both, levels, place, bit, top, 5)
    assert (10 ** logs[np.isin(both, every)]).sum() == pytest.approx(1)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 1 << 56, 1000, dtype=np.uint64))
    assert (C.unpack_sorted(C.pack_sorted(keys), 1000) == keys).all()
    assert C.unpack_sorted(C.pack_sorted(keys[:0]), 0).tolist() == []


def test_query_beats_single_words_on_held_out_text(spark):
    found = C.op4_context_tree(spark, "/root/testdata/sf0.1")
    rows = [r for r in found.collect() if r["held_out"]]
    assert found.count() == 10_000
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)
