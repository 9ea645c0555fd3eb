"""Language identification by cross-parsing entropy.

A suffix automaton of a language's sample knows every substring of it. A text is parsed
greedily into phrases, each the longest that the sample holds; a text in the sample's own
language needs few. With ``c`` phrases for ``m`` characters against a sample of ``n``, the
cross entropy is about ``c * log2(n) / m`` bits a character, and the least wins.

The automata of all languages are one table of transitions, and all segments of many texts
take a step in it at once. Only transitions that exist have a cell: a state's cells are those
at its number plus a character's code, and numbers are chosen so that no two meet. Parsing
starts anew every ``SEGMENT`` characters of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filecorpus.llm.common import query, remainder, slices, table

SAMPLE_TEXTS, SAMPLE_TEXT_CHARS = 64, 500  # passages, and characters of each
SEGMENT = 1024
FOLDS, HELD_OUT = 3, 1
CELLS = 3  # in the table, for each transition
ROUNDS = 64
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> str:
    """Lower-cased letters, with one blank for anything between them."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of each state, the first state being the root (Blumer et al.)."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def spread(states: np.ndarray, codes: np.ndarray, n: int, width: int) -> tuple[np.ndarray, int]:
    """A number for each of ``n`` states, and the cells needed, for transitions by state.

    All numbers differ, and so do all ``number + code`` of transitions. States with most
    transitions choose first; all with equally many choose at random until each has its cells.
    """
    random = np.random.default_rng(0)
    degree = np.bincount(states, minlength=n)
    first = np.concatenate([[0], np.cumsum(degree)])
    size = CELLS * max(len(states), n) + 1
    number = np.full(n, -1, np.int64)
    free, unused = np.ones(size + width, bool), np.ones(size, bool)
    for d in np.unique(degree)[::-1].tolist():
        left = np.flatnonzero(degree == d)
        rounds = 0
        while len(left):
            if rounds == ROUNDS:  # too crowded
                size, rounds = 2 * size, 0
                free = np.concatenate([free, np.ones(size + width - len(free), bool)])
                unused = np.concatenate([unused, np.ones(size - len(unused), bool)])
            rounds += 1
            tried = random.integers(0, size, len(left))
            cells = tried[:, None] + codes[first[left][:, None] + np.arange(d)]
            fits = unused[tried] & free[cells].all(axis=1)
            # Of those that fit, only such go in as are the first at all their cells.
            at = np.flatnonzero(fits)
            _, earliest = np.unique(tried[at], return_index=True)
            at = at[np.sort(earliest)]
            flat = cells[at].ravel()
            _, earliest = np.unique(flat, return_index=True)
            alone = np.zeros(len(flat), bool)
            alone[earliest] = True
            at = at[alone.reshape(len(at), d).all(axis=1)]
            number[left[at]] = tried[at]
            unused[tried[at]] = False
            free[cells[at].ravel()] = False
            left = np.delete(left, at)
    return number, size + width


@dataclass(frozen=True)
class Parser:
    """A cell has the state it is of and the next state times 4 plus the phrases that end there.

    A cell of another state says that there is no transition; then ``anew[language, code]``
    has what follows. Code 0 ends a text, code 1 is any character that no sample has.
    """

    languages: list[str]
    alphabet: str
    owner: np.ndarray
    following: np.ndarray
    anew: np.ndarray
    roots: np.ndarray
    bits: np.ndarray  # of a phrase, by language

    def encode(self, text: str) -> np.ndarray:
        known = np.array([ord(c) for c in self.alphabet], np.uint32)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(known, points).clip(max=len(known) - 1)
        return np.where(known[at] == points, at + 2, 1).astype(np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text [text, language]."""
        segments, owner = [], []
        for i, text in enumerate(texts):
            codes = self.encode(text)
            for a in range(0, len(codes), SEGMENT):
                segments.append(codes[a : a + SEGMENT])
                owner.append(i)
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        if not segments:
            return found
        sizes = np.array([len(s) for s in segments])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        codes = np.zeros((sizes[0] + 1, len(segments)), np.int32)
        for k, i in enumerate(order):
            codes[: sizes[k], k] = segments[i]
        # Longest first, so the segments that still have a step to take are the first ones.
        active = np.searchsorted(-sizes, -np.arange(len(codes)), side="right")
        state = np.repeat(self.roots[:, None], len(segments), axis=1)
        count = np.zeros(state.shape, np.int32)
        for i, n in enumerate(active):
            at = state[:, :n] + codes[i, :n]
            moved = np.where(
                self.owner[at] == state[:, :n], self.following[at], self.anew[:, codes[i, :n]]
            )
            count[:, :n] += moved & 3
            state[:, :n] = moved >> 2
        np.add.at(found, np.array(owner)[order], count.T)
        return found


def build_parser(samples: dict[str, str]) -> Parser:
    """Automata of all samples in one table."""
    languages = sorted(samples)
    alphabet = "".join(sorted(set("".join(samples.values()))))
    code = {c: i + 2 for i, c in enumerate(alphabet)}
    width, roots, first = len(alphabet) + 2, [], 0
    states, codes, to = [], [], []
    for language in languages:
        step = suffix_automaton(samples[language])
        roots.append(first)
        for state, moves in enumerate(step):
            # A root has all characters, as no phrase is open in it that could end.
            moves = {code[c]: (first + x, 0) for c, x in moves.items()}
            if not state:
                moves = {c: moves.get(c, (first, int(c > 0))) for c in range(width)}
            for c, (x, phrases) in moves.items():
                states.append(first + state)
                codes.append(c)
                to.append(4 * x + phrases)
        first += len(step)
    states, codes, to = (np.array(x, np.int64) for x in (states, codes, to))
    number, size = spread(states, codes, first, width)
    kind = np.int32 if 4 * size < 1 << 31 else np.int64
    owner, following = np.full(size, -1, kind), np.zeros(size, kind)
    cells = number[states] + codes
    owner[cells], following[cells] = number[states], 4 * number[to >> 2] + (to & 3)
    # Without a transition a phrase ends, and the character begins the next one, or, if the
    # sample does not have it at all, is a phrase by itself.
    roots = number[np.array(roots, np.int64)].astype(kind)
    at_root = following[roots[:, None] + np.arange(width)]
    anew = (at_root + 1).astype(kind)
    bits = np.array([np.log2(max(2, len(samples[name]))) for name in languages])
    return Parser(languages, alphabet, owner, following, anew, roots, bits)


def learn(
    docs: DataFrame,
    *,
    sample_texts: int = SAMPLE_TEXTS,
    sample_text_chars: int = SAMPLE_TEXT_CHARS,
) -> Parser:
    """Automata from ``text`` and ``lang`` of the rows outside the held-out fold.

    Rows with a null text or language are ignored. Whole texts are cut into passages of
    ``sample_text_chars`` characters, and of each language the ``sample_texts`` distinct
    passages with the smallest hashes are taken, from wherever they are in a text: the
    driver gets no more than that for each language.
    """
    usable = docs.filter("text is not null and lang is not null").filter(
        remainder("doc_id", FOLDS) != HELD_OUT
    )
    passages = F.regexp_extract_all(
        F.col("text").cast("string"), F.lit(f"(?s).{{1,{sample_text_chars}}}"), F.lit(0)
    )
    hashed = (
        usable.select(F.col("lang").cast("string").alias("lang"), F.explode(passages).alias("text"))
        .filter(F.col("text").rlike(r"\p{L}"))
        .select("lang", F.xxhash64("text").alias("h"), "text")
    )
    by_hash = Window.partitionBy("lang").orderBy("h")
    chosen = (
        hashed.select("lang", "h")
        .distinct()
        .withColumn("place", F.row_number().over(by_hash))
        .filter(F.col("place") <= sample_texts)
    )
    rows = (
        hashed.join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "place")
        .agg(F.min("text").alias("text"))
        .orderBy("lang", "place")
        .collect()
    )
    samples: dict[str, str] = {}
    for row in rows:
        samples[row["lang"]] = samples.get(row["lang"], "") + letters_of(row["text"]) + " "
    return build_parser({name: text for name, text in samples.items() if text.strip()})


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``doc_id, text``.

    The score is the part by which the winner's entropy lies under the second's. A text that
    is null or has no letter, or a parser without a language, gives ``und`` and 0; equal
    entropies go to the first language by name.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )
    held = docs.sparkSession.sparkContext.broadcast(parser)

    def identified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held.value
        for batch in slices(batches, 512):
            texts = [letters_of(t) for t in batch.column("text").to_pylist()]
            texts = [t if any(map(str.isalpha, t)) else "" for t in texts]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if parser.languages:
                entropy = parser.phrases(texts) * parser.bits
                best = entropy.argmin(axis=1)
                for i, text in enumerate(texts):
                    if text:
                        names[i] = parser.languages[best[i]]
                if len(parser.languages) > 1:
                    first, second = np.partition(entropy, 1, axis=1)[:, :2].T
                    scores = np.where(second > 0, 1 - first / np.where(second > 0, second, 1), 0)
                else:
                    scores = np.array([float(bool(t)) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64())],
                schema=schema,
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(identified, "doc_id long, lang_pred string, score double")


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
    )
