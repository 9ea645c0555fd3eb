import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filecorpus.llm import token_files as T
from filecorpus.llm.tokens import Encoder
from tests.llm.conftest import EDGES

FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ODD = [
    "", "a\tb c", "a \t\n b", "!\x1c ! a", "x\x01 y", " lead", "trail ", "trail \n\n", "\n\n a  b\n",
    "it's we'll  I'm", "(a) (b)", "é̀ ö Ä", "<|endoftext|> x", "ab<|EndOfText|>. <|startoftext|>", "a  b", "😀 😀😀", "  ", "x  (y", "end!!,'s",
    "\nWord", "\n word..", "Word_x ...", "µ ª ß ÿ Ÿ", "x" * 300 + " y", "don't'", "''s a's",
]


def plain(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, spaces", FILES)
@pytest.mark.parametrize("kept", [3, 1000])
def test_encoder_equals_the_library(name, spaces, kept):
    random.seed(3)
    parts = [*ODD, "Straße", "naïve,", "###", " ", "\n", "12", "ab", "THEN!!", "ding***", "’s", " ", "é"]
    texts = ODD + ["".join(random.choices(parts, k=30)) for _ in range(300)]
    texts += [" ".join(random.choices(parts, k=30)) for _ in range(300)]
    encoder, library = Encoder(public_tokenizers.path(name), spaces_in_tokens=spaces, kept=kept), plain(name)
    for i in range(0, len(texts), 50):
        for text, ids in zip(texts[i : i + 50], encoder.ids(texts[i : i + 50]), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == library(text), repr(text)


def written(spark, docs, tmp_path, **options):
    folder = f"file://{tmp_path}/files"
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = T.write_token_files(docs, path, folder, **options)
    return T.read_documents(spark, folder, shards), tmp_path / "files"


@pytest.mark.parametrize("shard_bytes", [40_000, 10**9])
def test_documents_come_back_in_order(spark, edges, tmp_path, shard_bytes):
    found, folder = written(spark, edges, tmp_path, shard_bytes=shard_bytes, length=16)
    library = plain("word_bpe_49k.json")
    rows = sorted(found.collect(), key=lambda r: r["start"])
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(rows, order, strict=True):
        ids = np.array([*library(text), T.END_ID], "<u4").tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(ids) // 4)
        assert zlib.crc32(row["ids"]) == zlib.crc32(ids)
        start += len(ids) // 4
    assert len(list(folder.glob("*.arrow"))) == (1 if shard_bytes > 10**6 else len(list(folder.glob("*"))))


def test_rows_are_views_of_equal_length(spark, corpus, tmp_path):
    _, folder = written(spark, corpus([(i, "some words here " * i) for i in range(400)]), tmp_path, length=64)
    with pa.memory_map(str(next(folder.glob("*.arrow")))) as mapped:
        shard = T.Shard(mapped)
        before = pa.total_allocated_bytes()
        n_ids = 0
        for i in range(len(shard)):
            ids, mask = shard.row(i)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            n_ids += mask.true_count
            assert i == len(shard) - 1 or mask.true_count == 64
        assert pa.total_allocated_bytes() - before < 10_000
        assert n_ids == sum(len(ids) for _, _, ids in shard.documents())
        assert shard.batches[0].num_rows == min(len(shard), T.ROWS_PER_BATCH)


def test_no_documents(spark, corpus, tmp_path):
    found, folder = written(spark, corpus([(1, "a")]).filter("doc_id = 2"), tmp_path)
    assert found.collect() == [] and list(folder.glob("*.arrow")) == []


def test_query_reads_whole_texts(spark):
    found = T.op1_token_files(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    library, start = plain("word_bpe_49k.json"), 0
    rows = {r["doc_id"]: r for r in found.collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library(r["text"]), 2], "<u4").tobytes()
        assert tuple(rows[r["doc_id"]]) == (r["doc_id"], start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert found.agg(F.count("*")).head()[0] == len(rows)
