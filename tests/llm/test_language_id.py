import random

import pytest

from filecorpus.llm import language_id as L

TEXT = {
    "en": "the quick brown fox jumps over the lazy dog and then the dog sleeps in the warm sun ",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund in der sonne ",
}


def naive(sample, text):
    count = 0
    for a in range(0, len(text), L.SEGMENT):
        segment, i = text[a : a + L.SEGMENT], 0
        while i < len(segment):
            n = 1
            while i + n < len(segment) and segment[i : i + n + 1] in sample:
                n += 1
            i += n if segment[i] in sample else 1
            count += 1
    return count


def test_automaton_knows_just_the_substrings():
    random.seed(4)
    text = "".join(random.choices("abc", k=60))
    step = L.suffix_automaton(text)

    def has(word):
        state = 0
        for c in word:
            if c not in step[state]:
                return False
            state = step[state][c]
        return True

    for _ in range(2000):
        word = "".join(random.choices("abcd", k=random.randint(0, 6)))
        assert has(word) == (word in text)
    assert len(step) <= 2 * len(text)


def test_phrases_against_plain_parsing():
    random.seed(6)
    samples = {name: (text * 3)[:200] for name, text in TEXT.items()}
    parser = L.build_parser(samples)
    texts = ["", "z", "the dog", "über", "ñ", *("".join(random.choices("theundr ßñ", k=random.choice([3, 40, 1024, 1025, 3000]))) for _ in range(40))]
    found = parser.phrases(texts)
    for text, row in zip(texts, found, strict=True):
        assert row.tolist() == [naive(samples[name], text) for name in parser.languages]


def test_tables_are_linear_in_the_samples():
    random.seed(9)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    samples = {f"l{k}": "".join(random.choices(letters, k=6000)) for k in range(20)}
    parser = L.build_parser(samples)
    transitions = sum(sum(map(len, L.suffix_automaton(s))) for s in samples.values())
    cells = transitions + len(samples) * len(parser.alphabet)
    assert len(parser.owner) <= 4 * cells
    texts = [samples["l3"][100:400] + samples["l9"][50:90], "".join(random.choices(letters, k=200)) + "x"]
    for text, row in zip(texts, parser.phrases(texts), strict=True):
        assert row.tolist() == [naive(samples[name], text) for name in parser.languages]


def test_edges(spark, edges):
    parser = L.build_parser(TEXT)
    rows = L.identify(edges, parser).collect()
    assert len(rows) == edges.count()
    by = {(r["doc_id"]): r for r in rows if r["doc_id"] in (1, 2, 3, 4)}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in rows)
    assert {r["lang_pred"] for r in L.identify(edges, L.build_parser({})).collect()} == {"und"}
    assert L.identify(edges.filter("doc_id = 99"), parser).count() == 0


def test_one_language_and_null_labels(spark):
    rows = [(i, TEXT["en"] if i % 2 else None, "en" if i % 3 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = L.learn(docs)
    assert parser.languages == ["en"]
    found = {r["doc_id"]: r for r in L.identify(docs, parser).collect()}
    assert found[1]["lang_pred"] == "en" and found[1]["score"] == 1 and found[2]["lang_pred"] == "und"


def test_copies_count_once_in_a_sample(spark):
    rows = [(i, TEXT["en"], "en") for i in range(300)] + [(i, f"{TEXT['de']}{i}", "de") for i in range(300, 400)]
    parser = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_texts=3)
    assert parser.languages == ["de", "en"]


def test_samples_are_of_whole_texts(spark):
    notice = "this notice is the same in all languages and says nothing about them. " * 10
    random.seed(8)
    words = {name: text.split() for name, text in TEXT.items()}
    rows = [
        (i, notice + " ".join(random.choices(words[name], k=300)), name)
        for i, name in enumerate(["en", "de"] * 60)
    ]
    parser = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = [(i, " ".join(random.choices(words[name], k=30)), name) for i, name in enumerate(["en", "de"] * 20)]
    found = L.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), parser)
    assert {r["doc_id"]: r["lang_pred"] for r in found.collect()} == {i: name for i, _, name in docs}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, folder):
    found = L.op6_language_id(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out").collect()
    assert found.count() == 10_000
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
