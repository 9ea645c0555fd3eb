import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filecorpus.functions.globs import (
    extended_glob_text,
    is_glob,
    plain_glob_regex,
    plain_glob_regex_column,
)
from filecorpus.operators.filters import exclude_globs
from filecorpus.operators.rules import match_patterns, match_rules, rule_candidates
from filecorpus.sources.listing import WalkOptions


def plain_match(pattern, path):
    regex = plain_glob_regex(pattern)
    return regex is not None and re.fullmatch(regex, path) is not None


@pytest.mark.parametrize(
    "pattern, path, expected",
    [
        ("*", "abc", True),
        ("*c", "abc", True),
        ("a*", "ab/c", False),
        ("a?c", "a/c", False),
        ("a[b-d]e", "ace", True),
        ("[^a-c]x", "dx", True),
        ("[^a-c]x", "/x", True),
        ("[z-a]", "b", False),
        ("[^z-a]", "b", True),
        ("a\\*b", "a*b", True),
        ("a\\*b", "axb", False),
        ("[\\]a]", "]", True),
        ("[]a]", "]", False),
        ("[-]", "-", False),
        ("[x-]", "x", False),
        ("[", "[", False),
        ("[a", "a", False),
        ("a\\", "a", False),
        ("[^]", "x", False),
        ("{a}", "{a}", True),
        ("ü*", "über", True),
        ("a.c", "abc", False),
    ],
)
def test_plain_dialect(pattern, path, expected):
    assert plain_match(pattern, path) is expected


ALPHABET = "ab-]/[^\\*?{.é"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(ALPHABET, max_size=8), st.text("ab-]/[^.é", max_size=5)), min_size=200, max_size=400))
def test_driver_and_column_compile_alike(spark, cases):
    rows = spark.createDataFrame(cases, "pattern string, path string")
    regex = plain_glob_regex_column(F.col("pattern"))
    got = rows.select(
        "pattern", "path", F.coalesce(F.rlike("path", F.concat(F.lit(r"\A(?:"), regex, F.lit(r")\z"))), F.lit(False)).alias("m")
    )
    for pattern, path, matched in got.collect():
        assert matched == plain_match(pattern, path), (pattern, path)


def test_is_glob(column_of):
    cases = {"q*": True, "q?r": True, "v[0]": True, "{": True, "plain-name": False, "x]": False, "}y": False, "": False}
    assert column_of(list(cases), is_glob) == list(cases.values())


EXTENDED = [
    ("*.parquet", "part.parquet", True),
    ("part-??.parquet", "part-07.parquet", True),
    ("*.parquet", "part.orc", False),
    ("part.orc", "part0.orc", False),
    ("part.orc", "part.orc", True),
    ("**/part.orc", "y=1/m=2/part.orc", True),
    ("**/part.orc", "part.orc", False),
    ("*.orc", "y=1/part.orc", False),
    ("m=[4-6]", "m=5", True),
    ("m=[4-6]", "m=[4-6]", True),
    ("m={4,5}", "m=4", False),
    ("m={4,5}", "m={4,5}", True),
    ("[bad*", "[bad/x", False),
    ("[bad*", "[badx", True),
    ("[bad", "[bad", True),
    ("a\\", "a", False),
    ("a\\", "a\\", False),
    ("a\\b", "ab", True),
    ("a\\/b.c", "a/b.c", True),
    ("a\\*.c", "a\\x.c", True),
    ("a**b", "a/\nb", False),
    ("a**b", "a/xb", True),
    ("a***b", "a/xb", True),
    ("a*b", "a\nb", True),
    ("^$.(+)|*", "^$.(+)|z", True),
    ("/x/**", "/x/y/z.q", True),
    ("/x/*/z.q", "/x/y/z.q", True),
    ("?", "é", True),
    ("\U0001f600*", "\U0001f600x", True),
]


@pytest.mark.parametrize("broadcast", [None, True, False])
def test_extended_dialect(spark, broadcast):
    patterns = sorted({p for p, _, _ in EXTENDED})
    paths = sorted({s for _, s, _ in EXTENDED})
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    if broadcast is None:
        matched = match_patterns(files, patterns)
    else:
        rules = spark.createDataFrame(list(enumerate(patterns)), "rule_id bigint, pattern string")
        matched = match_rules(files, rules, broadcast=broadcast)
    rows = [tuple(r) for r in matched.collect()]
    assert len(rows) == len(set(rows))
    assert all(patterns[rule_id] == pattern for _, rule_id, pattern in rows)
    found = {(pattern, path) for path, _, pattern in rows}
    for pattern, path, expected in EXTENDED:
        assert ((pattern, path) in found) is expected, (pattern, path)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text("ab./*?[]\\", min_size=1, max_size=8), min_size=5, max_size=20, unique=True),
    st.lists(st.text("ab./[]\\", min_size=1, max_size=8), min_size=20, max_size=60, unique=True),
)
def test_rule_table_and_configured_patterns_match_alike(spark, patterns, paths):
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rules = spark.createDataFrame(list(enumerate(patterns)), "rule_id bigint, pattern string")
    direct = sorted(map(tuple, match_patterns(files, patterns).collect()))
    assert direct == sorted(map(tuple, match_rules(files, rules).collect()))


# path, patterns, excluded; the root is the first element of the path.
KEPT = "/lake/raw/year=1/part-0.orc"
EXCLUDES = [
    (KEPT, [], False),
    (KEPT, ["*.orc"], True),
    (KEPT, ["part-?.*"], True),
    (KEPT, ["/lake/raw/year=1/*"], True),
    (KEPT, ["*.crc", "_SUCCESS", "*.orc"], True),
    (KEPT, ["[never-closed"], False),
    (KEPT, ["[never-closed", "*.orc"], True),
    (KEPT, ["raw"], True),
    (KEPT, ["/lake/raw"], True),
    (KEPT, ["/lake"], True),
    (KEPT, ["/lake/*"], True),
    (KEPT, ["raw/*"], False),
    (KEPT, ["RAW"], False),
    (KEPT, ["[^x]aw"], True),
    (KEPT, ["/lake[^x]raw"], True),
    (KEPT, ["e[^x]raw"], False),
    (KEPT, ["w/y*"], False),
    (KEPT, ["par"], False),
    (KEPT, [""], False),
    (KEPT, ["*"], True),
    (KEPT, ["lake"], True),
]


def test_excludes(spark):
    for path, patterns, excluded in EXCLUDES:
        root = "/" + path.split("/")[1]
        listing = spark.createDataFrame([(root, path)], "root string, path string")
        assert (exclude_globs(listing, patterns).count() == 0) is excluded, (path, patterns)


def test_excludes_below_other_roots(spark):
    rows = [("/", "/"), ("/", "/a"), ("/", "/a/b"), (".", "x/y"), ("r", "r"), ("r", "r/s")]
    listing = spark.createDataFrame(rows, "root string, path string")
    for patterns, kept in (
        ([""], 6),
        (["a"], 4),
        (["/a/*"], 5),
        (["x/*"], 5),
        (["r"], 4),
        (["r/*"], 5),
        (["*"], 1),
        (["/"], 3),
        (["[/]"], 3),
    ):
        assert exclude_globs(listing, patterns).count() == kept, patterns


def test_walk_excludes_like_the_filter():
    for path, patterns, excluded in EXCLUDES:
        options = WalkOptions(exclude=tuple(patterns))
        parts = path.split("/")
        chain = ["/".join(parts[: n + 1]) for n in range(1, len(parts))]
        assert any(options.excludes(p) for p in chain) is excluded, (path, patterns)


def test_directories_above_the_root_are_not_tested(spark):
    listing = spark.createDataFrame([("/a/b", "/a/b/c")], "root string, path string")
    assert exclude_globs(listing, ["a", "/a"]).count() == 1
    assert exclude_globs(listing, ["b"]).count() == 0


def test_rules_with_inner_text_meet_few_paths(spark):
    """Rules by their inner text: candidates are close to matches, also where nothing is broadcast."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.choice([2, 3, 4, 9]))) for _ in range(400)]
    paths = ["/".join(["", *rng.choices(words, k=4)]) + rng.choice([".log", ".txt", ""]) for _ in range(600)]
    patterns = [f"**{w}**" for w in words] + [f"/*/*{w}?*/**" for w in words[:50]]
    patterns += [f"**[xyz]{w}**.log" for w in words[:20]] + ["**", "/**/[a-c]*", "**{x}**", "*\\\\a*"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rules_ = spark.createDataFrame(list(enumerate(patterns)), "rule_id bigint, pattern string")
    want = set()
    for number, pattern in enumerate(patterns):
        readings = [r for r in (plain_glob_regex(pattern), extended_glob_text(pattern)) if r is not None]
        regex = re.compile("|".join(readings))
        want |= {(p, number) for p in paths if regex.fullmatch(p)}
    for broadcast in (True, False):
        got = match_rules(files, rules_, broadcast).collect()
        assert sorted((r.path, r.rule_id) for r in got) == sorted((p, n) for p in paths for q, n in want if q == p)
    inner = rules_.filter("rule_id < 400")
    tried, matched = rule_candidates(files, inner).count(), match_rules(files, inner).count()
    assert matched <= tried < 1.5 * matched < 0.1 * len(paths) * 400
