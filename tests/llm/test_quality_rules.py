import random
import re
from collections import Counter

import pytest

from filecorpus.llm import quality_rules as Q
from tests.llm.conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = len(covered)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        repeats, len(words) < 50 or 100 * repeats > 50 * len(words),
    )


def counts(v):
    return v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed


def test_counts_against_plain_code():
    random.seed(5)
    texts = [t for _, t in EDGES if not t or len(t) < 50_000]
    for _ in range(300):
        parts = random.choices(["a", "b", "c", "é#", " ", "\n", "\r", "\x0b", " ", "|", " "], k=random.randint(0, 400))
        texts.append("".join(parts) if random.random() < 0.5 else " ".join(parts))
    for text in texts:
        assert counts(Q.judge(text)) == naive(text), repr(text)


GOOD = "The words of this line are plain and it ends as a sentence does, one would say. " * 2


@pytest.mark.parametrize(
    "line",
    [
        "home | news | sport | about | contact us",
        "BUY!! NOW!! ALL!! OF!! IT!!",
        "and$$$ of### the*** rest%%% is&&& this***",
        "Please enable JavaScript to see the page",
        "word " * 60,
    ],
)
def test_bad_lines_go_and_good_ones_stay(line):
    text = "\n".join([GOOD, line, "", GOOD * 3 + "more."])
    verdict = Q.judge(text)
    assert verdict.n_bad_lines == 1
    assert verdict.cleaned == "\n".join([GOOD, "", GOOD * 3 + "more."])
    much = Q.judge("\n".join([GOOD, *(f"{line} {i} " + line for i in range(40))]))
    assert not much.kept


def test_report_and_clean_agree_on_edges(edges):
    rows = Q.quality_report(edges).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == sorted((i or 0, naive(t)[0]) for i, t in EDGES)
    kept = Q.clean(edges)
    assert kept.columns == edges.columns
    assert kept.count() == sum(r["kept"] for r in rows)


def test_clean_counts_characters_anew(corpus):
    text = "\n".join([*(f"{i} {GOOD}" for i in "abcdef"), "a | b | c | d"])
    (row,) = Q.clean(corpus([(1, " ".join(f"w{i}" for i in range(80)) + ".\na | b | c | d"), (2, None)])).collect()
    assert row["text"].endswith(".") and row["n_chars"] == len(row["text"]) and row["score"] == "x"
    assert Q.clean(corpus([(1, text)]).filter("doc_id = 2")).count() == 0


def test_clean_documents_are_kept(spark):
    """Of documents labelled good, no more are rejected than the base rules reject."""
    report = Q.op5_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = report.join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert len(good) > 200 and all(r["kept"] for r in good)
    assert sum(not r["kept"] for r in bad) >= 0.95 * len(bad)
    assert report.count() == 1000
