import numpy as np

from filecorpus.llm import quality_classifier as C


def test_flat_trees_equal_walking_each_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 6)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0) | (rng.random(800) < 0.05)).astype(float)
    model = C.fit(x, y)
    slow = []
    for row in x:
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.scores(x), slow)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_splits_are_at_the_best_gain():
    x = np.arange(50.0)[:, None]
    model = C.fit(np.repeat(x, 2, axis=1), (x[:, 0] >= 37).astype(float))
    assert (model.scores(np.array([[36.0, 0], [37.0, 0]])) > 0.5).tolist() == [False, True]


def test_statistics_of_any_text():
    for text in (None, "", " \n", "x" * 100_000, "é 日本 \U0001f600", "\n\n"):
        found = C.statistics(text)
        assert len(found) == len(C.STATISTICS) and np.isfinite(found).all()


def test_without_labels_or_with_one_kind(spark, edges):
    for rows, low, high in (([], 0.5, 0.5), ([(5, 1), (6, 1), (4, 1), (None, 0), (7, None)], 0.5, 1.0)):
        model = C.learn(edges, spark.createDataFrame(rows, "doc_id long, quality int"))
        scores = [r["score"] for r in C.score(edges, model).collect()]
        assert len(scores) == edges.count() and all(low <= s <= high for s in scores)


def test_keep_good_passes_rows_through(spark, edges):
    model = C.fit(np.zeros((0, len(C.STATISTICS))), np.zeros(0))
    assert sorted(map(str, C.keep_good(edges, model, keep_from=0.5).collect())) == sorted(map(str, edges.collect()))
    assert C.keep_good(edges, model).count() == 0
    assert C.score(edges.filter("doc_id = 99"), model).count() == 0


def test_sample_is_bounded_and_held_out_rows_are_not_learnt(spark, corpus):
    docs = corpus([(i, "good text." if i % 2 else "bad | text") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert C.learn(docs, labels, sample_rows=40).value.shape[0] == C.N_TREES
    held = docs.filter(C.remainder("doc_id", C.FOLDS) == C.HELD_OUT)
    model = C.learn(held, labels)
    assert model.value.shape[0] == 0


def test_held_out_accuracy(spark):
    found = C.op2_quality_classifier(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert found.count() == 10_000
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
