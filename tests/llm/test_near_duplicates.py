import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from filecorpus.llm import near_duplicates as N
from tests.llm.conftest import EDGES


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows):
    """n_shingles and component of each row, all pairs that share a shingle compared."""
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
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
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


def found(docs):
    rows = N.near_duplicates(docs).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows)


def edited(random_, words, share):
    return [f"e{random_.random()}" if random_.random() < share else w for w in words]


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (3000, N.POSITIONS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(N.POSITIONS, N.RADIUS, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, N.RADIUS, dtype=np.uint16)
    x, y = N.bucket_keys(a), N.bucket_keys(b)
    assert (x == y).any(axis=1).all()
    assert not (N.bucket_keys(a[:-1]) == N.bucket_keys(a[1:])).any()


def test_first_shared_bucket():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (2000, N.POSITIONS), dtype=np.uint16)
    b = np.where(rng.random(a.shape) < 0.4, a + np.uint16(1), a)
    shared = N.bucket_keys(a) == N.bucket_keys(b)
    some = shared.any(axis=1)
    assert some.sum() > 1000
    assert (N.first_slots(a[some], b[some]) == shared[some].argmax(axis=1)).all()


def test_shingles_tell_sets_apart():
    for text in ("a", "a b", "A B", "b a", "a b c d e", "a b c d e f", "a a a a a a", "é ü"):
        assert len(N.shingles(text)) == len(shingle_set(text))
    assert N.set_id(N.shingles("a b")) == N.set_id(N.shingles(" A  b\n"))
    assert N.set_id(N.shingles("a b")) != N.set_id(N.shingles("b a"))


def test_edges(edges):
    assert found(edges) == expected(EDGES)
    assert N.near_duplicates(edges.filter("doc_id = 99")).count() == 0
    assert found(edges.filter("text is null")) == expected([r for r in EDGES if r[1] is None])


@pytest.mark.parametrize("seed, dense", [(0, 256), (1, 0), (2, 3)])
def test_against_all_pairs(corpus, monkeypatch, seed, dense):
    """Chains of edits, a hot group of near copies, a passage that many texts share."""
    monkeypatch.setattr(N, "DENSE", dense)
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
        rows.append(edited(r, base, r.choice([0, 0.005, 0.02, 0.03])))
        rows.append([f"o{r.random()}" for _ in range(r.randint(5, 40))] + passage)
    r.shuffle(rows)
    texts = [(i + 1, " ".join(words)) for i, words in enumerate(rows)]
    assert found(corpus(texts)) == expected(texts)


@pytest.mark.parametrize("dense", [0, 256])
def test_blocks_and_shares_find_what_hubs_miss(corpus, monkeypatch, dense):
    """Small blocks, so that a bucket is split; the smallest and largest are linked with nothing."""
    monkeypatch.setattr(N, "DENSE", dense)
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "MEMBERS", 7)
    r = random.Random(9)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for _ in range(12):
        own = [f"o{r.random()}" for _ in range(20)]
        rows += [edited(r, own + passage, 0.004) for _ in range(4)]
    texts = [(i + 1, " ".join(words)) for i, words in enumerate(rows)]
    assert found(corpus(texts)) == expected(texts)


@pytest.mark.parametrize("dense", [0, 256])
def test_near_copies_that_are_hardly_links(corpus, monkeypatch, dense):
    """Texts whose similarity is about the least one: some links, most pairs none."""
    monkeypatch.setattr(N, "DENSE", dense)
    r = random.Random(5)
    base = [f"h{i}" for i in range(200)]
    texts = [(i + 1, " ".join(edited(r, base, 0.016))) for i in range(120)]
    want = expected(texts)
    assert 3 < len({c for _, _, c in want}) < 110
    assert found(corpus(texts)) == want


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    chain = list(range(100, 160))
    r.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(7, 200 + i) for i in range(50)] + [(3, 3), (9, 8), (9, 8)]
    rows = {x["node"]: x["component"] for x in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert rows == {**{i: 100 for i in chain}, **{200 + i: 7 for i in range(50)}, 7: 7, 8: 8, 9: 8}


def test_one_of_each_group_stays_with_all_its_columns(edges, corpus):
    kept = N.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # Equal rows leave one; an id with two texts keeps both, which are not linked.
    assert Counter(ids) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, None: 2, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1})
    text = " ".join(f"w{i}" for i in range(100))
    copies = corpus([(i, text + (" x" if i % 2 else "")) for i in range(1, 30)])
    assert [r["doc_id"] for r in N.keep_one(copies).collect()] == [1]


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = N.op9_near_duplicates(spark, "/root/testdata/sf0.01").collect()
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows)
    assert got == expected([tuple(d) for d in docs])


def test_keep_one_keeps_other_columns(spark):
    rows = [(1, "a b c d e f", 7, 0), (2, "a b c d e f", 8, 0), (3, "", 9, 1), (3, "", 9, 1), (None, "x y", 5, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash long, hash int")
    kept = sorted(map(tuple, N.keep_one(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[4]], key=str)
    assert N.keep_one(docs.filter("doc_id = 99")).count() == 0
