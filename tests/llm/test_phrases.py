import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from filecorpus.llm import phrases as P
from tests.llm.conftest import EDGES


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def expected(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(
                100 * b >= 50 * a for other, b in f.items()
                if len(other) == 3 and b >= least and phrase in (other[:2], other[1:])
            ):
                continue
            cuts = [(f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase))]
            score, _, left, right = min(
                (1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts)
            )
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(frame):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def some_texts(n, seed=3):
    random_ = random.Random(seed)
    words = ["a", "b", "C", "d", "é", "日本", "token", "x=1"]
    marks = [" ", " ", " ", " ", "\t", ". ", ",", "\n", " ?", "\r\n", "\xa0"]
    return [
        (
            random_.choice(["en", "en", "de", None]),
            "".join(random_.choice(words) + random_.choice(marks) for _ in range(random_.randint(0, 60))),
        )
        for _ in range(n)
    ]


@pytest.fixture
def docs(spark):
    def make(rows):
        full = [(i, t, lang, "s", 1, "x", 2) for i, (lang, t) in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, phrase string, f int"
        return spark.createDataFrame(full, schema)

    return make


@pytest.mark.parametrize("depth", [3, 5])
def test_index_both_ways(depth):
    rng = np.random.default_rng(depth)
    tokens = rng.integers(0, 5, 400).astype(np.int32)
    tokens[0] = tokens[-1] = 0
    for add, step in ((P.PhraseIndex.left, "left"), (P.PhraseIndex.right, "right")):
        index = P.PhraseIndex(tokens, depth)
        of = index.single()
        phrases = [(w,) for w in of.word.tolist()]
        for k in range(2, depth + 1):
            of = add(index, of)
            phrases = [
                (w, *phrases[p]) if step == "left" else (*phrases[p], w)
                for w, p in zip(of.word.tolist(), of.parent.tolist(), strict=True)
            ]
            plain = Counter(tuple(tokens[i : i + k].tolist()) for i in range(len(tokens) - k + 1))
            plain = {p: c for p, c in plain.items() if 0 not in p}
            assert dict(zip(phrases, of.size.tolist(), strict=True)) == plain
            assert len(set(phrases)) == len(phrases)
            if k == depth:
                continue
            for start, back, size, phrase in zip(of.start, of.back, of.size, phrases, strict=True):
                ahead = index._forward[start : start + size]
                behind = index._backward[back : back + size]
                assert {tuple(tokens[i : i + k]) for i in ahead} == {phrase}
                assert {tuple(tokens[i - k + 1 : i + 1]) for i in behind} == {phrase}


def test_left_then_right():
    tokens = np.array([0, 1, 1, 1, 2, 0, 1, 1, 2, 70_000, 0], np.int32)
    pairs, triples = P.phrases_of(tokens)
    assert sorted(zip(*map(list, pairs), strict=True)) == [(1, 1, 3), (1, 2, 2), (2, 70_000, 1)]
    assert sorted(zip(*map(list, triples), strict=True)) == [(1, 1, 1, 1), (1, 1, 2, 2), (1, 2, 70_000, 1)]


def test_order_by_columns():
    rng = np.random.default_rng(1)
    for most, n in ((3, 500), (70_000, 500), (2**31 - 1, 300), (5, 1), (5, 0)):
        columns = [rng.integers(0, most, n).astype(np.int32) for _ in range(4)]
        columns[1][: n // 2] = columns[1][: n // 2] % 2
        for k in (1, 2, 4):
            want = np.lexsort(columns[:k][::-1])
            assert P.stable_order(*columns[:k]).tolist() == want.tolist()


def test_last_words_are_counted_as_extended():
    tokens = np.random.default_rng(2).integers(0, 6, 500).astype(np.int32)
    tokens[0] = tokens[-1] = 0
    index = P.PhraseIndex(tokens, 3)
    pairs = index.left(index.single())
    triples = index.right(pairs)
    found = zip(*(x.tolist() for x in index.right_counts(pairs)), strict=True)
    columns = (triples.word, triples.parent, triples.size)
    assert sorted(found) == sorted(zip(*(x.tolist() for x in columns), strict=True))


def batch_of(rows):
    langs, texts = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, pa.string()) for c in (langs, texts)], names=["lang", "text"])


def pieces_of(shard):
    """(lang, words) of each piece that has words."""
    assert shard.tokens[0] == shard.tokens[-1] == 0
    words, pieces = [w.decode() for w in shard.words.to_pylist()], [[]]
    assert len({(w, k) for w, k in zip(words[1:], shard.lang_of[1:], strict=True)}) == len(words) - 1
    for t in shard.tokens.tolist():
        pieces[-1].append(t) if t else pieces.append([])
    return [(shard.langs[shard.lang_of[p[0]]], tuple(words[t] for t in p)) for p in pieces if p]


@pytest.mark.parametrize("size", [1, 40, 10**6])
def test_words_and_pieces_of_shards(size):
    rows = [(lang or "und", t) for lang, t in some_texts(400)]
    rows += [("en", t) for _, t in EDGES[:-3]] + [("de", "y" * 5_000), ("x", None), ("x", ".. a,,b\tC \x1c")]
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            want.update([(lang, words)] if words else [])
    made = list(P.shards([batch_of(rows)], size))
    assert Counter(p for shard in made for p in pieces_of(shard)) == want
    assert (len(made) == 1) == (size == 10**6)


def test_words_cost_no_python_call_each():
    """A call for every new word of a shard made three scans slower than their indexes."""

    def calls(n):
        batch, count = batch_of([("en", " ".join(f"w{i}" for i in range(n)))]), 0

        def counted(_frame, event, _arg):
            nonlocal count
            count += event == "call"

        before = sys.getprofile()
        sys.setprofile(counted)
        try:
            shard = next(P.shards([batch], 10**6))
        finally:
            sys.setprofile(before)
        assert len(shard.words) == n + 1
        return count

    assert calls(20_000) == calls(20)


def test_positions_without_phrases_are_not_indexed(monkeypatch):
    made = []

    class Index(P.PhraseIndex):
        def __init__(self, tokens, depth):
            made.append(tokens.tolist())
            super().__init__(tokens, depth)

    monkeypatch.setattr(P, "PhraseIndex", Index)
    for tokens, least in (
        ([0, 0, 0, 1, 2, 0, 3, 0, 0, 4, 0, 5, 5, 5, 0, 0], [0, 1, 2, 0, 5, 5, 5, 0]),
        ([0, 7, 0], [0]), ([0, 0, 0], [0]), ([0], [0]), ([0, 1, 2, 0], [0, 1, 2, 0]),
    ):
        pairs, triples = P.phrases_of(np.array(tokens, np.int32))
        assert made.pop() == least
        for found, k in ((pairs, 2), (triples, 3)):
            plain = Counter(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
            plain = sorted((*p, c) for p, c in plain.items() if 0 not in p)
            assert sorted(zip(*(x.tolist() for x in found), strict=True)) == plain


def test_collocations_against_plain_counting(docs):
    rows = some_texts(300)
    want = expected(rows, least=3, top=40)
    assert len({r[0] for r in want}) == 3 and {len(r[2].split()) for r in want} == {2, 3}
    assert rows_of(P.collocations(docs(rows).repartition(5), least=3, top=40)) == want


def test_shards_bucket_levels_and_a_full_bitmap(docs, monkeypatch):
    rows = some_texts(300)
    for name, value in (
        ("SHARD_TOKENS", 200), ("BUCKET_TOKENS", 50), ("FAN_BITS", 2), ("ROW_KEYS", 8),
        ("LEAST_BITS", 3), ("MOST_BITS", 3),
    ):
        monkeypatch.setattr(P, name, value)
    monkeypatch.setattr(P.frequent_keys, "__kwdefaults__", {"fan": 2})
    assert rows_of(P.collocations(docs(rows).repartition(5), least=3)) == expected(rows, least=3)


def test_edges(docs, edges, spark):
    assert rows_of(P.collocations(docs([]))) == []
    assert rows_of(P.collocations(docs([(None, None), ("en", ""), (None, ".!?\n\t ")]))) == []
    # Overlapping occurrences, ties, repeated rows.
    rows = [("en", "go go go go"), (None, "b a. b a, b a\x0bb a"), ("en", "z z")] * 6
    assert rows_of(P.collocations(docs(rows))) == expected(rows)
    rows = [("en", t) for _, t in EDGES] * 2
    found = P.collocations(edges.unionByName(edges), least=2)
    assert rows_of(found) == expected(rows, least=2)


def test_counts_whose_products_pass_64_bits(spark):
    numbers = [(10**15, 10**15, 3 * 10**15), (10, 4_000_000_000, 5_000_000_000), (7, 7, 7)]
    frame = spark.createDataFrame(numbers, "a long, l long, r long")
    got = [r[0] for r in frame.select(P._score(frame.a, frame.l, frame.r)).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in numbers]
