import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from filecorpus.llm import shingle_join as J
from filecorpus.staging import Folders
from tests.llm.conftest import EDGES


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def expected(rows):
    """Id, set size and component of each row, all pairs that share a shingle compared."""
    sets = [shingle_set(t) for _, t in rows]
    having, parent = defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in having[s])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(own) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for s in own:
            having[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(
        (doc_id or -1, len(own), (least.get(root(i)) if own else doc_id) or -1)
        for i, ((doc_id, _), own) in enumerate(zip(rows, sets, strict=True))
    )


def found(docs, **bound):
    rows = J.shingle_join(docs, **bound).collect()
    return sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows)


def edited(random_, words, share):
    return [f"e{random_.random()}" if random_.random() < share else w for w in words]


def test_pairs_of_the_similarity_always_meet():
    """Any order, any boundary, sets of every size: a linked pair shares a key."""
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, 1 << J.COUNTER_BITS).astype(np.uint32)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(6, 90))
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        left = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)]))
        right = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)]))
        if len(left) == len(right) == n or not J.linked(left, right):
            continue
        met += 1
        assert J.can_differ(len(left)) and J.can_differ(len(right))
        bits = [np.frombuffer(J.parity(s), np.uint64) for s in (left, right)]
        assert J.may_link(np.array(len(left)), np.array(len(right)), *bits)
        firsts = [s[J.in_order(s, counts)[: J.first_shingles(len(s), J.SUBSET)]] for s in (left, right)]
        for bound in (1, 20, 40, 100):
            keys = [J.keys_of(f, len(s), bound) for f, s in zip(firsts, (left, right), strict=True)]
            assert np.intersect1d(*keys).size
    assert met > 500


def test_sets_without_similar_ones():
    assert [n for n in range(1, 12) if not J.can_differ(n)] == [1, 2, 3, 4, 5]
    assert J.linked(np.arange(6), np.arange(7)) and not J.linked(np.arange(5), np.arange(6))


def test_boundary_follows_cost():
    assert J.boundary([(100, 1000, 0)]) <= 100  # 136 subsets or 16 entries
    # Long lists make subsets worth their number.
    assert J.boundary([(20, 1000, 5_000_000)]) > 20


def test_edges(edges):
    for bound in (None, 1, 1000):
        assert found(edges, bound=bound) == expected(EDGES)
    assert J.shingle_join(edges.filter("doc_id = 99")).count() == 0
    assert found(edges.filter("text is null")) == expected([r for r in EDGES if r[1] is None])


@pytest.mark.parametrize("seed, dense, bound", [(0, 256, None), (1, -1, 1), (2, 3, 60), (3, -1, 1000)])
def test_against_all_pairs(corpus, monkeypatch, seed, dense, bound):
    """Chains of edits, a hot group of near copies, a passage that many texts share."""
    monkeypatch.setattr(J, "DENSE", dense)
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    base = [f"h{i}" for i in range(150)]
    rows = []
    for _ in range(60):
        words = [f"w{r.random()}" for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 6)):
            rows.append(words)
            words = edited(r, words, r.choice([0, 0.01, 0.03]))
    for _ in range(150):
        rows.append(edited(r, base, r.choice([0, 0.005, 0.01, 0.02])))
        rows.append([f"o{r.random()}" for _ in range(r.randint(5, 40))] + passage)
    r.shuffle(rows)
    texts = [(i + 1, " ".join(words)) for i, words in enumerate(rows)]
    want = expected(texts)
    assert len({c for _, _, c in want}) < len(want) - 100
    assert found(corpus(texts), bound=bound) == want


@pytest.mark.parametrize("dense, counter_bits", [(-1, 20), (256, 4)])
def test_near_copies_that_are_hardly_links(corpus, monkeypatch, dense, counter_bits):
    """Texts whose similarity is about the least one, in small blocks; and a useless order."""
    for name, value in (("DENSE", dense), ("BLOCK", 3), ("MEMBERS", 7), ("COUNTER_BITS", counter_bits)):
        monkeypatch.setattr(J, name, value)
    r = random.Random(5)
    base = [f"h{i}" for i in range(200)]
    texts = [(i + 1, " ".join(edited(r, base, 0.011))) for i in range(120)]
    want = expected(texts)
    assert 3 < len({c for _, _, c in want}) < 110
    assert found(corpus(texts)) == want


def test_a_dense_block_gives_a_forest():
    nodes = np.arange(50)
    sets = [np.arange(100)] * 50
    pairs = [np.triu_indices(50, 1)]
    links = J._forest(pairs, nodes, sets)
    assert len(links) == 49


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = J.op11_shingle_join(spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got.collect())
    assert rows == expected([tuple(d) for d in docs])


@pytest.mark.parametrize("share, broadcast", [(2, 0), (3, 1000), (512, 16 << 20)])
def test_pairs_are_confirmed_in_shares_and_what_is_used_up_goes(spark, corpus, monkeypatch, share, broadcast):
    """Near copies of a text with null ids, ids of two texts and repeated rows among them."""
    monkeypatch.setattr(J, "SHARE", share, raising=False)
    monkeypatch.setattr(J, "BROADCAST_BYTES", broadcast)
    r = random.Random(7)
    texts = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(100 + 20 * g)]
        copies = [" ".join(edited(r, base, r.choice([0.003, 0.01, 0.02]))) for _ in range(9)]
        texts += [(None if i % 4 == 3 else 100 * (i // 2) + g, t) for i, t in enumerate(copies)]
    texts += [row for row in texts if r.random() < 0.3]
    r.shuffle(texts)
    with Folders(spark) as made:
        assert found(corpus(texts)) == expected(texts)
    left = {Path(f).name.rsplit("-", 1)[0] for f in made.made if Path(f).exists()}
    made.remove()
    assert left == {"sets", "classes", "edges"}
