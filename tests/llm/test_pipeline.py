import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from filecorpus.llm import near_duplicates, quality_classifier, quality_rules
from filecorpus.staging import Folders, stage
from tests.llm.test_near_duplicates import expected

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage made of them."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, function in P.STAGES:
        out.append(stage(function(spark, out[-1], FOLDER), name.replace(" ", "-")))
    return out


def test_columns(steps):
    assert len(P.STAGES) == 5
    assert all(s.schema.names == steps[0].schema.names for s in steps[1:5])


def test_rules_clean_and_reject(steps):
    kept = {r["doc_id"]: r for r in steps[1].collect()}
    for r in steps[0].collect():
        verdict = quality_rules.judge(r["text"])
        assert (r["doc_id"] in kept) == verdict.kept
        if verdict.kept:
            assert kept[r["doc_id"]]["text"] == verdict.cleaned
            assert kept[r["doc_id"]]["n_chars"] == len(verdict.cleaned)


def test_classifier_rejects_low_scores_only(spark, steps):
    model = quality_classifier.learn(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    before = steps[1].collect()
    scores = model.scores(np.array([quality_classifier.statistics(r["text"]) for r in before]))
    wanted = {r["doc_id"] for r, s in zip(before, scores, strict=True) if s >= 0.7}
    assert {r["doc_id"] for r in steps[2].collect()} == wanted
    assert len(wanted) >= 0.97 * len(before)


def test_one_document_of_each_group_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    wanted = {component for _, _, component in expected(rows)}
    assert {r["doc_id"] or -1 for r in steps[3].collect()} == wanted


def test_mix_keeps_all_rows(steps):
    assert sorted(map(str, steps[4].collect())) == sorted(map(str, steps[3].collect()))


def test_packed_sequences_hold_every_document(steps):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in steps[5].collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], len(r["ids"]) // 4))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {r["doc_id"] for r in steps[4].collect()}
    for parts in pieces.values():
        ends = np.cumsum([0] + [n for _, _, n, _ in sorted(parts)])
        assert [s for _, s, _, _ in sorted(parts)] == ends[:-1].tolist()
        assert all(n == m for _, _, n, m in parts)
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 1024


def test_run_is_its_stages_and_leaves_one_table(spark, steps):
    with Folders(spark) as made:
        found = P.run(spark, FOLDER)
    assert found.count() == steps[5].count() and found.columns == steps[5].columns
    left = [f for f in made.made if os.path.exists(f.removeprefix("file:"))]
    assert len(made.made) > 10 and len(left) == 1 and "packing" in left[0]


def test_nulls_repeated_rows_other_columns_and_empty_tables(spark, steps, edges, tmp_path):
    good = [r["text"] for r in steps[3].orderBy("doc_id").limit(3).collect()]
    extra = [(100, good[0]), (100, good[0]), (101, good[0]), (None, good[1]), (102, good[2]), (102, good[2] + " again")]
    more = spark.createDataFrame([(i, t, None, None, None, "x", "y", 1) for i, t in extra], edges.schema)
    table = edges.unionByName(more).withColumn("__hash", F.lit(1)).withColumn("__slot", F.lit("x"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, rows in (("edges", table), ("empty", table.filter("doc_id = -5"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    # The labels of this table are of other texts, so the stage is given a model that knows.
    model = quality_classifier.learn(steps[0], labels)
    rows = edges.sparkSession.read.parquet(f"{tmp_path}/edges/documents.parquet")
    rows = stage(P.rules(spark, rows, FOLDER), "rules")
    rows = stage(quality_classifier.keep_good(rows, model), "classifier")
    rows = stage(P.duplicates(spark, rows, FOLDER), "duplicates")
    rows = stage(P.mixed(spark, rows, FOLDER), "mixed")
    assert rows.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in rows.collect() if r["doc_id"] is None or r["doc_id"] >= 100) == ["100", "102", "None"]
    pieces = P.packed(spark, rows, FOLDER)
    assert {r["doc_id"] for r in pieces.collect()} >= {100, 102, None}
    assert P.run(spark, f"{tmp_path}/empty").count() == 0
    P.run(spark, f"{tmp_path}/edges").count()


def test_documents_that_are_not_read_from_files(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.packed(spark, docs, FOLDER).count() == 1
    assert near_duplicates.keep_one(docs).count() == 1
