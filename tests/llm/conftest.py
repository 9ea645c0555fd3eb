import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, node int"

# Nulls, empty and blank texts, one word, equal rows, one id with two texts, other white space,
# letters of several kinds, a long text and a long word.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "same text here"), (5, "same text here"),
    (6, "one text"), (6, "another text"), (None, "no id"), (None, None),
    (7, "tab\tand\x1c!\x01 and nbsp x İ ΣΑΣ é̀"), (8, "日本語 テキスト 😀 12 ½"),
    (9, "a long text, with words. " * 20_000), (10, "x" * 100_000), (11, "<|endoftext|> it's"),
]


@pytest.fixture
def corpus(spark):
    """Documents from (id, text) rows, with more columns whose names operators use too."""

    def make(rows):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", "y", 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def edges(corpus):
    return corpus(EDGES)
