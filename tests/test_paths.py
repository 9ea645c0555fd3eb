import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filecorpus.functions import paths as P
from filecorpus.operators.tree import empty_directories, files_under, paths_exist


def check(column_of, expression, cases):
    assert column_of(list(cases), expression) == list(cases.values())


def test_base_name(column_of):
    check(column_of, P.base_name, {"/a/b.txt": "b.txt", "": ".", "/": "/", "//": "/", "a/b/": "b", "x": "x"})


def test_parent_path(column_of):
    check(column_of, P.parent_path, {"/a/b.txt": "/a", "/a": "", "a": "", "a/b/c": "a/b", "": ""})


def test_normalize_path(column_of):
    cases = {
        "/data/2024/": "/data/2024",
        "D:\\lake\\raw\\": "D:/lake/raw",
        "\\\\host\\share": "//host/share",
        "/": "",
        "\\": "",
        "": "",
        "//": "/",
        "z": "z",
    }
    check(column_of, P.normalize_path, cases)


def test_path_components(column_of):
    cases = {
        "/data/2024/01": ["data", "2024", "01"],
        "D:\\lake\\raw": ["D:", "lake", "raw"],
        "x///y/": ["x", "y"],
        "": [],
        "/": [],
    }
    check(column_of, P.path_components, cases)


def test_file_extension(column_of):
    cases = {
        ".profile.bak": "bak",
        "part.snappy.parquet": "parquet",
        "README": "",
        "ends.": "",
        ".": "",
        "..": "",
        ".bashrc": "bashrc",
        "/v1.2/data": "",
        "/v1.2/Data.ORC": "ORC",
    }
    check(column_of, P.file_extension, cases)


def test_is_hidden(column_of):
    cases = {
        "/path/to/.hidden": True,
        "/path/to/.hidden/file.txt": False,
        ".": False,
        "..": False,
        "/": False,
        "": False,
        "/a/..b": True,
    }
    check(column_of, P.is_hidden, cases)


@pytest.mark.parametrize(
    "base, target, expected",
    [
        ("/a/b", "/a/b", "."),
        ("/a/b", "/a/b/c/d", "c/d"),
        ("/a/b/c", "/a/b", ".."),
        ("/a/b/c", "/a/d", "../../d"),
        ("/a", "/", ".."),
        ("/", "/a/b", "a/b"),
        ("a/b/./c", "a/b/d/../e", "../e"),
        (".", "a/b", "a/b"),
        (".", "..", ".."),
        ("../../a/b", "../../a/b/c/d", "c/d"),
        ("..", ".", None),
        ("..", "a", None),
        ("../..", "..", None),
        ("a", "/a", None),
        ("/a", "a", None),
        ("/../a", "/a/b", "b"),
    ],
)
def test_relative_path(column_of, base, target, expected):
    assert column_of([target], lambda v: P.relative_path(F.lit(base), v)) == [expected]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(*[st.lists(st.sampled_from(["a", "b", "..", ".", ""]), max_size=6).map("/".join)] * 2),
        min_size=1,
        max_size=40,
    )
)
def test_relative_path_of_rooted_paths(spark, pairs):
    rooted = [("/" + a, "/" + b) for a, b in pairs]
    rows = spark.createDataFrame(rooted, "a string, b string").select(
        "a", "b", P.relative_path("a", "b").alias("r")
    )
    for a, b, r in rows.collect():
        clean = [posixpath.normpath("/" + p.lstrip("/")) for p in (a, b)]
        assert r == posixpath.relpath(clean[1], clean[0])


def test_paths_from_root(spark):
    rows = [("/r", "/r/a/b"), ("/r", "/r"), ("/", "/a"), (".", "a/b"), ("", "a")]
    got = spark.createDataFrame(rows, "root string, path string").select(P.paths_from_root("path", "root"))
    assert [r[0] for r in got.collect()] == [
        ["/r", "/r/a", "/r/a/b"],
        ["/r"],
        ["/", "/a"],
        [".", "a", "a/b"],
        ["", "a"],
    ]


# A plain statement of what containment means, to hold the join against.
def contains(parent, child):
    def normal(path):
        path = path.replace("\\", "/")
        path = "" if path == "/" else path
        return path[:-1] if len(path) > 1 and path.endswith("/") else path

    parent, child = normal(parent), normal(child)
    if parent == "":
        return True
    if parent == child or not child.startswith(parent):
        return False
    return parent.endswith("/") or child[len(parent)] == "/"


DIRS = ["/usr", "/usr/local", "/usr/local/", "C:\\Windows", "", "/", "//", "a", "a/", "a//", "a///", "/nowhere"]
PATHS = [
    "/usr/local/bin", "/usr", "/usr/", "/usr/local2", "C:\\Windows\\System32", "a/b", "a//b", "a//", "a///b",
    "a", "", "/", "//", "//x", "x", "/x", "ab/c",
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_files_under(spark, limit):
    files = spark.createDataFrame([(p,) for p in PATHS], "path string")
    dirs = spark.createDataFrame([(d,) for d in DIRS], "dir string")
    got = sorted(map(tuple, files_under(files, dirs, broadcast_bytes=limit).collect()))
    assert got == sorted((d, p) for d in DIRS for p in PATHS if contains(d, p))


def test_paths_exist_counts_each_path_once(spark):
    wanted = spark.createDataFrame([("/a",), ("/a",), ("/b",), ("/e",)], "path string")
    listing = spark.createDataFrame([("/a", "file"), ("/a", "file"), ("/c", "dir"), ("/e", "error")], "path string, kind string")
    assert sorted(map(tuple, paths_exist(wanted, listing).collect())) == [("/a", True), ("/b", False), ("/e", False)]


def test_empty_directories(spark):
    rows = [
        ("/r", "", "dir"),
        ("/r/empty", "/r", "dir"),
        ("/r/full", "/r", "dir"),
        ("/r/full/.hidden", "/r/full", "file"),
        ("/r/linked", "/r", "dir"),
        ("/r/linked/x", "/r/linked", "symlink"),
    ]
    listing = spark.createDataFrame(rows, "path string, parent string, kind string")
    assert [r.path for r in empty_directories(listing).collect()] == ["/r/empty"]
