import random
import zlib
from collections import defaultdict
from itertools import combinations as subsets

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from filecorpus.llm import mixing
from filecorpus.llm import packing as P
from filecorpus.staging import stage
from tests.llm.conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 5, 9, 10, 11, 20, 25, 30])
def test_only_the_first_piece_is_shorter(n):
    pieces = P.cut(n, 10)
    assert [s for s, _ in pieces] == np.cumsum([0] + [k for _, k in pieces[:-1]]).tolist()
    assert sum(k for _, k in pieces) == n and all(k == 10 for _, k in pieces[1:]) and 0 < pieces[0][1] <= 10


def test_fullest_combination_against_all_subsets():
    random.seed(1)
    for _ in range(300):
        lengths = random.choices(range(1, 20), k=random.randint(0, 9))
        room = random.randint(0, 40)
        counts = np.bincount(lengths, minlength=50)
        best = max(s for k in range(len(lengths) + 1) for c in subsets(lengths, k) if (s := sum(c)) <= room)
        chosen = P.fullest(counts, room)
        assert sum(n * k for n, k in chosen) == best
        assert all(k <= counts[n] for n, k in chosen)


@pytest.mark.parametrize("capacity, n", [(10, 0), (10, 1), (64, 500), (1024, 5000)])
def test_sequences_are_gapless_and_few(capacity, n):
    lengths = np.random.default_rng(n).integers(1, capacity, n)
    sequence, place = P.pack_lengths(lengths, capacity)
    by = defaultdict(list)
    for s, o, k in zip(sequence, place, lengths, strict=True):
        by[s].append((o, k))
    for parts in by.values():
        end = 0
        for o, k in sorted(parts):
            assert o == end
            end += k
        assert end <= capacity
    if n >= 500:
        assert len(by) <= 1.02 * lengths.sum() / capacity + 1


def check(rows, texts, capacity=1024):
    library = Tokenizer.from_file(PATH)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        ends = np.cumsum([0] + [k for _, k in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= capacity
    wanted = defaultdict(list)
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for piece, (start, n) in enumerate(P.cut(len(ids), capacity)):
            wanted[doc_id].append((piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in wanted.items()}
    return by_sequence


def test_edges(edges):
    packed = P.pack_documents(edges, PATH).withColumn("ids_crc32", F.crc32("ids"))
    check(packed.collect(), EDGES)


def test_no_documents(edges):
    assert P.pack_documents(edges.filter("doc_id = 99"), PATH).count() == 0


def test_sequences_follow_the_order_from_shard_to_shard(corpus):
    docs = corpus([(i, "word " * (i % 90)) for i in range(2000)])
    pieces = P.token_pieces(docs, PATH, place=-F.col("doc_id"))
    packed = P.pack(pieces, shard_pieces=500).collect()
    of = defaultdict(set)
    for r in packed:
        of[r["sequence_id"] >> 32].add(r["doc_id"])
    shards = [of[k] for k in sorted(of)]
    assert len(shards) > 2 and all(min(a) > max(b) for a, b in zip(shards, shards[1:], strict=False))


@pytest.mark.parametrize("n, window", [(0, 8), (5, 8), (400, 16), (6000, 2048)])
def test_prefixes_of_sequences_are_prefixes_of_the_order(n, window):
    lengths = np.random.default_rng(n).integers(1, 1300, n).clip(max=1024)
    sequence, place = P.pack_in_order(lengths, 1024, window)
    by = defaultdict(list)
    for i, s in enumerate(sequence.tolist()):
        by[s].append(i)
    assert sorted(by) == list(range(len(by)))
    left, short = set(range(n)), np.cumsum(lengths < 1024)
    for s in sorted(by):
        ends = np.cumsum([0, *(k for _, k in sorted((place[i], lengths[i]) for i in by[s]))])
        assert sorted(place[by[s]]) == ends[:-1].tolist() and ends[-1] <= 1024
        assert min(left) == by[s][0]  # the earliest piece left is in the next sequence
        assert short[by[s][-1]] - short[by[s][0]] < window
        left -= set(by[s])
    if window == 2048:
        assert len(by) <= 1.01 * lengths.sum() / 1024 + 1


def test_sequences_keep_the_shares_of_the_mix(spark):
    rows = [(i, "word " * (20 + i * 37 % 1500), "abc"[i % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    for weights in ({"a": 8, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 8}):
        mixed = stage(mixing.mix(docs, weights, block_chars=1 << 14), "mixed")
        packed = P.pack_documents(mixed, PATH, place=corpus_pipeline._place(mixed))
        found = packed.select("sequence_id", "doc_id", "length", "place").collect()
        tokens, last = defaultdict(int), -1
        hot = max(weights, key=weights.get)
        total = sum(r["length"] for r in found if source[r["doc_id"]] == hot)
        for r in sorted(found, key=lambda r: r["sequence_id"]):
            if r["sequence_id"] != last and sum(tokens.values()) > 400_000:
                shares = {s: tokens[s] / sum(tokens.values()) for s in weights}
                assert all(abs(shares[s] - w / 10) < 0.1 for s, w in weights.items())
            last = r["sequence_id"]
            tokens[source[r["doc_id"]]] += r["length"]
            if tokens[hot] > 0.8 * total:
                break
        assert sum(tokens.values()) > 500_000
        firsts = [min((r["place"] for r in found if r["sequence_id"] == s)) for s in range(300)]
        assert firsts == sorted(firsts)


def test_query_packs_whole_texts_tightly(spark):
    found = P.op10_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sequences = check(found, [tuple(r) for r in docs])
    total = sum(r["length"] for r in found)
    assert len(sequences) <= 1.006 * total / 1024 + 1
