"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text become bins (quantiles of the sample), and every tree is a complete
binary tree whose nodes are chosen by gain over histograms of gradients. A fitted model is
three arrays (feature and threshold of each inner node, value of each leaf), walked for many
rows and all trees at once, one level a step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.llm.common import query, remainder, slices, table
from filecorpus.llm.quality_rules import SYMBOLS, repeated_words

SAMPLE_ROWS = 20_000
KEEP_FROM = 0.7
FOLDS, HELD_OUT = 4, 2

N_TREES, DEPTH, N_BINS = 60, 4, 64
LEARNING_RATE, L2, MIN_WEIGHT = 0.2, 1.0, 2.0

STATISTICS = (
    "log_chars", "log_words", "chars_per_word", "upper_share", "digit_share", "wide_share",
    "marks_per_word", "bangs_per_word", "bars_per_word", "symbols_per_word", "lines_per_word",
    "distinct_share", "commonest_share", "doubled_share", "repeated_share", "same_line_share",
    "longest_line_share", "ended_share",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; a null text counts as empty, whose shares are all zero."""
    raw = (text or "").encode()
    words = raw.split()
    n, counts = max(1, len(words)), Counter(words)
    size = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, size[65:91].sum() + size[97:123].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        np.log1p(len(text or "")),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        size[65:91].sum() / letters,
        size[48:58].sum() / max(1, len(raw)),
        size[128:].sum() / max(1, len(raw)),
        size[[46, 63, 59, 58, 44]].sum() / n,
        size[33] / n,
        size[124] / n,
        size[list(SYMBOLS)].sum() / n,
        len(lines) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        repeated_words(words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max((len(line) for line in lines), default=0) / max(1, len(raw)),
        sum(w[-1] in b".,;:!?" for w in words) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees side by side: ``feature, threshold`` [tree, inner node], ``value`` [tree, leaf]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        n_trees, n_inner = self.feature.shape
        trees, rows = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), n_trees), np.int64)
        for _ in range((n_inner + 1).bit_length() - 1):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.base + self.value[trees, node - n_inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0 and 1; without both labels, their share with one of each added."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    n_inner = (1 << DEPTH) - 1
    if not 0 < y.sum() < len(y):
        empty = np.zeros((0, n_inner), np.int64)
        return Forest(base, empty, empty.astype(float), np.zeros((0, n_inner + 1)))
    steps = np.linspace(0, 1, N_BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(column, steps)) for column in x.T]
    bins = np.stack(
        [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1
    )
    features, thresholds, values = [], [], []
    raw = np.full(len(y), base)
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-raw))
        feature, threshold, leaf, value = _tree(bins, edges, y - p, p * (1 - p))
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.stack(features), np.stack(thresholds), np.stack(values))


def _tree(
    bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n_inner = (1 << DEPTH) - 1
    feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
    place = np.zeros(len(bins), np.int64)  # within its level
    for level in range(DEPTH):
        n_nodes, first = 1 << level, (1 << level) - 1
        best = np.zeros(n_nodes)
        split = np.full(n_nodes, N_BINS)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            cell = place * N_BINS + bins[:, f]
            g, h = (
                np.bincount(cell, v, n_nodes * N_BINS).reshape(n_nodes, N_BINS).cumsum(axis=1)
                for v in (gradient, weight)
            )
            g_all, h_all = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all**2 / (h_all + L2)
            gain[(h < MIN_WEIGHT) | (h_all - h < MIN_WEIGHT)] = 0
            at = gain[:, : len(cuts)].argmax(axis=1)
            found = gain[np.arange(n_nodes), at]
            better = found > best + 1e-9
            best[better], split[better] = found[better], at[better]
            feature[first : first + n_nodes][better] = f
            threshold[first : first + n_nodes][better] = cuts[at[better]]
        # A node without a split sends all its rows to the left.
        chosen = feature[first + place]
        place = 2 * place + (bins[np.arange(len(bins)), chosen] > split[place])
    g, h = (np.bincount(place, v, n_inner + 1) for v in (gradient, weight))
    return feature, threshold, place, LEARNING_RATE * g / (h + L2)


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A model from at most ``sample_rows`` labelled documents outside the held-out fold.

    ``labels`` has ``doc_id, quality``; null ids and qualities are ignored, and an id with
    several labels counts as 1 if most are. The sample is the first rows by a hash of the id,
    and is what the driver gets: ``sample_rows`` times a few numbers.
    """
    marked = labels.filter("doc_id is not null and quality is not null")
    marked = marked.filter(remainder("doc_id", FOLDS) != HELD_OUT)
    chosen = (
        marked.groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select("doc_id", F.col("text").cast("string")).join(
        F.broadcast(chosen), "doc_id"
    )
    names = [f"s{i}" for i in range(len(STATISTICS))]
    schema = pa.schema([("label", pa.int32()), *((n, pa.float64()) for n in names)])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            columns = [batch.column("label"), *map(pa.array, x.T)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = ", ".join(["label int", *(f"{n} double" for n in names)])
    sample = texts.select("label", "text").mapInArrow(measure, ddl).limit(sample_rows).toPandas()
    # Sums of floats depend on the order of rows, which Spark does not promise.
    sample = sample.sort_values(list(sample.columns)).to_numpy()
    return fit(sample[:, 1:], sample[:, 0])


def score(docs: DataFrame, model: Forest) -> DataFrame:
    """``doc_id, score`` for every row of ``doc_id, text``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_scores(model, batch))], schema=schema
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(scored, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Forest, *, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``keep_from``."""

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(model, batch) >= keep_from))

    return docs.mapInArrow(kept, docs.schema)


def _scores(model: Forest, batch: pa.RecordBatch) -> np.ndarray:
    return model.scores(np.array([statistics(t) for t in batch.column("text").to_pylist()]))


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )
