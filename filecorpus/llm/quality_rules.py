"""Line-first cleaning: judge each line, drop the failing ones, then judge what is left.

Rules of a line, each on the line alone:

navigation   separators (``|`` and the like) for every second word or more: menus, tables
punctuation  a long line without any sentence mark, or one where every second word ends in ``!!``
symbols      more symbols than one to four words
boilerplate  a phrase of notices and page furniture in a short line

A document is rejected when the lines dropped hold more than ``MAX_LOST`` of its word
characters, or when the base rules reject it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm.common import batches_of, query, slices, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST = 0.5
LONG_LINE_WORDS = 40
BOILERPLATE_WORDS = 20

# Symbols counted, separators of menus, sentence marks, phrases of page furniture.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = (b"|", b">", "»".encode(), "•".encode(), "·".encode(), b"::")
SENTENCE_MARKS = re.compile(r"[.!?:;…。！？]")
BOILERPLATE = re.compile(
    r"accept (?:all )?cookies|all rights reserved|click here|cookie policy|enable javascript"
    r"|log ?in to continue|privacy policy|sign up (?:for|to)|skip to content|subscribe (?:now|to)"
    r"|terms of (?:service|use)",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    n_bad_lines: int
    lost_chars: int
    kept: bool
    cleaned: str


def chars(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) if raw.isascii() else len(raw.decode())


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    codes, names = pd.factorize(np.array(words, object))
    pairs = codes[:-1] * len(names) + codes[1:]
    if len(names) > 1_000_000:  # else the product below fits 63 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    _, which, times = np.unique(
        pairs[:-1] * len(names) + codes[2:], return_inverse=True, return_counts=True
    )
    twice = times[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def bad_line(raw: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a rule."""
    n = len(words)
    if n >= 4 and 2 * sum(map(raw.count, SEPARATORS)) >= n:
        return True
    if n >= 4 and 4 * (len(raw) - len(raw.translate(None, SYMBOLS))) > n:
        return True
    if n >= 4 and 2 * raw.count(b"!!") >= n:
        return True
    if n <= BOILERPLATE_WORDS:
        return bool(BOILERPLATE.search(raw.decode()))
    return n >= LONG_LINE_WORDS and not SENTENCE_MARKS.search(raw.decode())


def judge(text: str | None, max_lost: float = MAX_LOST) -> Verdict:
    raw = (text or "").encode()
    words = raw.split()  # the same white space as in the definition of a word
    in_words = sum(map(len, words))
    word_chars = len(text or "") - (len(raw) - in_words)
    lines = raw.split(b"\n")
    by_line = [line.split() for line in lines]
    full = [line for line, found in zip(lines, by_line, strict=True) if found]
    repeats = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    bad = [bool(w) and bad_line(line, w) for line, w in zip(lines, by_line, strict=True)]
    lost = sum(chars(b"".join(w)) for w, b in zip(by_line, bad, strict=True) if b)
    cleaned = b"\n".join(line for line, b in zip(lines, bad, strict=True) if not b)
    return Verdict(
        len(words),
        word_chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(full) - len(set(full)),
        repeats,
        base_failed,
        sum(bad),
        lost,
        not base_failed and lost <= max_lost * word_chars,
        cleaned.decode(),
    )


_REPORT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("n_bad_lines", pa.int64()),
        ("lost_chars", pa.int64()),
        ("kept", pa.bool_()),
    ]
)
_REPORT_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, n_bad_lines long, lost_chars long, kept boolean"
)


def quality_report(docs: DataFrame, *, max_lost: float = MAX_LOST) -> DataFrame:
    """One row per row of ``doc_id, text``: counts, the base verdict and the final one.

    A null text counts as empty and is rejected. Other columns are ignored.
    """

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for doc_id, text in zip(ids, texts, strict=True):
                    v = judge(text, max_lost)
                    yield (
                        doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines,
                        v.n_repeat_words, v.base_failed, v.n_bad_lines, v.lost_chars, v.kept,
                    )

        yield from batches_of(_REPORT, rows(), 2000)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(report, _REPORT_DDL)


def clean(docs: DataFrame, *, max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that stay, without their failing lines; the same columns.

    ``n_chars``, if there is such a column, is counted anew.
    """
    counted = "n_chars" in docs.columns

    def filtered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            verdicts = [judge(t, max_lost) for t in batch.column("text").to_pylist()]
            kept = pa.array([v.kept for v in verdicts])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array([v.cleaned for v in verdicts], batch.schema.field("text").type)
            if counted:
                kind = batch.schema.field("n_chars").type
                columns["n_chars"] = pa.array([len(v.cleaned) for v in verdicts]).cast(kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema).filter(kept)

    return docs.mapInArrow(filtered, docs.schema)


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_report(table(spark, sf_dir, "documents"))
