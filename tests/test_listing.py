import os
import random
import time

import pytest
from pyspark.sql import functions as F

from filecorpus.operators import filters
from filecorpus.operators.fingerprint import fingerprint
from filecorpus.operators.tree import empty_directories, paths_exist
from filecorpus.sources.binary import binary_files
from filecorpus.sources.listing import WalkOptions, list_tree, read_changes, read_listing, split_paths
from filecorpus.streaming.dedup import write_unique

ALL = WalkOptions(skip_hidden=False)


@pytest.fixture(params=["data source", "levels"])
def listing(request, spark):
    return lambda *roots, **options: (read_listing if request.param == "data source" else list_tree)(
        spark, [str(r) for r in roots], WalkOptions(**options)
    )


def files(df):
    return sorted(os.path.basename(r.path) for r in filters.regular_files(df).collect())


def make(root, *names, content=b"text"):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_hidden_depth_and_excludes(listing, tmp_path):
    make(tmp_path, "alpha.csv", "beta.orc", "in/gamma.csv", ".env", ".git/config", "_SUCCESS", "in/none", content=b"")
    shown = ["_SUCCESS", "alpha.csv", "beta.orc", "gamma.csv", "none"]
    assert files(listing(tmp_path)) == shown
    assert files(listing(tmp_path, skip_hidden=False)) == sorted([*shown, ".env", "config"])
    assert files(listing(tmp_path, max_depth=0)) == ["_SUCCESS", "alpha.csv", "beta.orc"]
    assert files(listing(tmp_path, exclude=("*.orc", "_*"))) == ["alpha.csv", "gamma.csv", "none"]
    assert files(listing(tmp_path, exclude=("i?",))) == ["_SUCCESS", "alpha.csv", "beta.orc"]
    assert files(listing(tmp_path, exclude=(f"{tmp_path}/in",))) == ["_SUCCESS", "alpha.csv", "beta.orc"]
    skipped = {(os.path.basename(r.parent), r.size) for r in listing(tmp_path).filter("kind = 'skipped'").collect()}
    assert skipped == {(tmp_path.name, 2)}


def test_depths(listing, tmp_path):
    make(tmp_path, "a", "b", "y/c", "y/z/d", "y/z/e", "y/z/w/f")
    for depth, count in ((0, 2), (1, 3), (2, 5), (3, 6), (-1, 6)):
        assert len(files(listing(tmp_path, max_depth=depth))) == count
    rows = {(r.name, r.kind, r.depth) for r in listing(tmp_path).collect()}
    assert rows == {
        (tmp_path.name, "dir", 0), ("a", "file", 0), ("b", "file", 0), ("y", "dir", 1), ("c", "file", 1),
        ("z", "dir", 2), ("d", "file", 2), ("e", "file", 2), ("w", "dir", 3), ("f", "file", 3),
    }


def test_sizes(listing, tmp_path):
    for size in (0, 7, 300, 301):
        make(tmp_path, f"n{size}", content=b"x" * size)
    for limit, count in ((-1, 4), (0, 4), (6, 1), (7, 2), (300, 3), (301, 4)):
        assert len(files(listing(tmp_path, max_file_size=limit))) == count


def test_empty_directories_of_a_walk(spark, listing, tmp_path):
    make(tmp_path, "hidden/.only", "excluded/x.tmp", "large/big", "full/a", content=b"12345")
    (tmp_path / "empty").mkdir()
    found = listing(tmp_path, exclude=("*.tmp",), max_file_size=3)
    assert [os.path.basename(r.path) for r in empty_directories(found).collect()] == ["empty"]
    # A directory that could not be read may hold anything.
    error = spark.createDataFrame([("r", f"{tmp_path}/empty", str(tmp_path), "empty", 1, "error", None, None, None, "read_dir", "permission denied")], found.schema)
    assert empty_directories(found.unionByName(error)).count() == 0


def test_existence_that_cannot_be_told(spark, listing, tmp_path):
    make(tmp_path, "a/b", "dark/c")
    (tmp_path / "good").symlink_to(tmp_path / "a")
    (tmp_path / "bad").symlink_to(tmp_path / "nowhere")
    found = listing(tmp_path, tmp_path / "gone").filter(~F.col("path").endswith("dark/c") | F.col("path").isNull())
    error = spark.createDataFrame([("r", f"{tmp_path}/dark", str(tmp_path), "dark", 1, "error", None, None, None, "read_dir", "permission denied")], found.schema)
    names = ["a", "a/b", "a/x", "dark", "dark/c", "dark/d/e", "darker", "good", "bad", "gone", "gone/x"]
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "path string")
    got = {os.path.relpath(r.path, tmp_path): r.exists for r in paths_exist(wanted, found.unionByName(error)).collect()}
    assert got == {
        "a": True, "a/b": True, "a/x": False, "dark": True, "dark/c": None, "dark/d/e": None, "darker": False,
        "good": True, "bad": False, "gone": False, "gone/x": False,
    }


def test_partitions_are_bounded_and_share_one_directory(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i:03d}" / "e").mkdir(parents=True)
    read = spark.read.format("file_listing").option("paths", str(tmp_path)).option("numPartitions", 16)
    rows = read.load()
    assert rows.count() == 601 and rows.rdd.getNumPartitions() <= 2 * 16 + 1


def test_names_of_one_directory_are_looked_up_by_many_tasks(spark, tmp_path):
    make(tmp_path, *(f"f{i}" for i in range(500)))
    found = list_tree(spark, [str(tmp_path)]).filter("kind = 'file'")
    assert found.count() == 500
    assert found.select(F.input_file_name()).distinct().count() > 4


def test_missing_root_is_an_error_row(listing, tmp_path):
    make(tmp_path, "a")
    found = listing(tmp_path / "missing", tmp_path)
    assert files(found) == ["a"]
    (error,) = filters.scan_errors(found).collect()
    assert (error.op, error.message) == ("access", "no such file or directory")
    assert error.path == str(tmp_path / "missing")


def test_links(listing, tmp_path):
    make(tmp_path, "tree/subdir/target.txt")
    (tmp_path / "tree/link.txt").symlink_to(tmp_path / "tree/subdir/target.txt")
    (tmp_path / "tree/loop").symlink_to(tmp_path / "tree")
    (tmp_path / "tree/broken").symlink_to(tmp_path / "nowhere")
    root, broken = tmp_path / "root", tmp_path / "brokenroot"
    root.symlink_to(tmp_path / "tree")
    broken.symlink_to(tmp_path / "nowhere")
    for skip in (True, False):
        found = listing(tmp_path / "tree", skip_symlinks=skip)
        assert files(found) == ["target.txt"]
        assert found.filter("kind = 'symlink'").count() == 3
    assert listing(root, broken).count() == 0
    followed = listing(root, broken, skip_symlinks=False)
    assert [r.path for r in filters.regular_files(followed).collect()] == [str(tmp_path / "tree/subdir/target.txt")]
    assert [e.op for e in filters.scan_errors(followed).collect()] == ["resolve"]


def test_overlapping_roots_are_listed_twice(listing, tmp_path):
    make(tmp_path, "a/b/c.txt", "a/d.txt")
    found = filters.regular_files(listing(tmp_path, tmp_path / "a/b"))
    counts = {os.path.basename(r.path): r["count"] for r in found.groupBy("path").count().collect()}
    assert counts == {"c.txt": 2, "d.txt": 1}


def test_a_file_as_root(listing, tmp_path):
    make(tmp_path, "only.txt", ".dot")
    assert files(listing(tmp_path / "only.txt", tmp_path / ".dot")) == ["only.txt"]


def test_mode_size_and_parent(listing, tmp_path):
    make(tmp_path, "run.sh", content=b"12345")
    (tmp_path / "run.sh").chmod(0o750)
    os.utime(tmp_path / "run.sh", (1_700_000_000, 1_700_000_000))
    row = listing(tmp_path).filter("kind = 'file'").withColumn("t", F.unix_timestamp("mod_time")).first()
    assert (row.mode, row.size, row.parent, row.root, row.t) == (0o750, 5, str(tmp_path), str(tmp_path), 1_700_000_000)


def test_names_that_are_not_utf8_are_reported(listing, tmp_path):
    make(tmp_path, "good")
    with open(os.fsencode(tmp_path) + b"/bad\xff", "wb"):
        pass
    found = listing(tmp_path)
    assert files(found) == ["good"]
    (error,) = filters.scan_errors(found).collect()
    assert error.op == "name" and error.path.endswith("bad\\xff")


def test_filters_agree_with_the_walk(spark, listing, tmp_path):
    make(tmp_path, "a.txt", ".h/b.txt", "x/.c", "x/y/d.log", "x/y/z/e.txt", content=b"12345")
    make(tmp_path, "x/big.txt", content=b"1" * 100)
    everything = filters.regular_files(read_listing(spark, [str(tmp_path)], ALL))
    assert files(filters.skip_hidden(everything)) == files(listing(tmp_path))
    for depth in (0, 1, 2):
        assert files(filters.within_depth(everything, depth)) == files(listing(tmp_path, skip_hidden=False, max_depth=depth))
    assert files(filters.max_file_size(everything, 50)) == files(listing(tmp_path, skip_hidden=False, max_file_size=50))
    for patterns in (("*.txt",), ("x",), ("y", "*.c"), (f"{tmp_path}/x/*",), (f"{tmp_path}/?",)):
        assert files(filters.exclude_globs(everything, patterns)) == files(listing(tmp_path, skip_hidden=False, exclude=patterns))


def test_a_dot_root_is_not_hidden(spark, tmp_path, monkeypatch):
    # The walk runs in the workers' own folder; only the root itself is looked at here.
    from filecorpus.sources.listing import open_root

    assert open_root(".", WalkOptions())[5] == "dir"
    listing = spark.createDataFrame([(".", "a/b"), (".", ".a/b"), ("..", "../a")], "root string, path string")
    assert sorted(r.path for r in filters.skip_hidden(listing).collect()) == ["../a", "a/b"]


@pytest.mark.parametrize("wanted", [1, 2, 3, 5, 100])
def test_every_split_lists_everything_once(spark, tmp_path, wanted):
    names = [f"d{i}/e{j}/f{k}" for i in range(3) for j in range(2) for k in range(2)] + ["top", "d0/mid"]
    make(tmp_path, *names)
    read = spark.read.format("file_listing").option("paths", str(tmp_path)).option("numPartitions", wanted)
    rows = read.load()
    paths = [r.path for r in rows.collect()]
    assert len(paths) == len(set(paths)) == len(names) + 1 + 3 + 6
    assert rows.rdd.getNumPartitions() >= min(wanted, 2)


def test_depth_filter_stops_the_walk(spark, tmp_path):
    make(tmp_path, "a", "d/b", "d/e/c")
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        listing = read_listing(spark, [str(tmp_path)])
        assert files(listing.filter("depth <= 1")) == ["a", "b"]
        assert files(listing.filter("depth < 1")) == ["a"]
        assert files(listing.filter("depth = 1")) == ["b"]
        assert files(listing) == ["a", "b", "c"]
    finally:
        spark.conf.unset(key)


def test_option_lists():
    assert split_paths(" /a, /b ,,") == ["/a", "/b"]
    assert split_paths('["/a,b", "c"]') == ["/a,b", "c"]
    assert split_paths("[ab]*,x") == ["[ab]*", "x"]


def test_no_path_is_refused(spark, tmp_path):
    read_listing(spark, [str(tmp_path)])
    with pytest.raises(Exception, match="at least one path"):
        spark.read.format("file_listing").option("paths", " , ").load().collect()


def test_binary_files(spark, tmp_path):
    make(tmp_path, "a.txt", "d/b.txt", "d/e/c.txt", content=b"12345")
    make(tmp_path, "big", content=b"x" * 100)
    found = binary_files(spark, str(tmp_path))
    rows = {(r.name, r.depth, r.size, bytes(r.content[:2]), r.parent) for r in found.collect()}
    top = str(tmp_path)
    assert rows == {
        ("a.txt", 0, 5, b"12", top),
        ("big", 0, 100, b"xx", top),
        ("b.txt", 1, 5, b"12", f"{top}/d"),
        ("c.txt", 2, 5, b"12", f"{top}/d/e"),
    }
    small = filters.max_file_size(found, 50).select("name")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan
    assert "content" not in plan.split("ReadSchema")[1]
    assert files(filters.within_depth(found, 1)) == ["a.txt", "b.txt", "big"]


def test_new_files_are_streamed_into_the_deduplication(spark, tmp_path):
    tree, output, state = (str(tmp_path / n) for n in ("tree", "out", "state"))
    kept = []
    for names in (["a", "b"], ["c", "d/e"]):
        make(tmp_path / "tree", *names, content=b"same")
        make(tmp_path / "tree", f"own-{names[0]}", content=names[0].encode())
        stream = fingerprint(binary_files(spark, tree, stream=True))
        write_unique(stream, output, state).awaitTermination()
        kept.append(spark.read.parquet(output).count())
    assert kept == [2, 3]


def test_changes_of_a_tree_come_once(spark, tmp_path):
    """New, moved-in and changed files, over restarts of the query."""
    root, old = tmp_path / "tree", tmp_path / "old"
    make(root, "a", "in/deep/b", ".hidden", "skip.tmp")
    make(old, "moved")
    os.utime(old / "moved", (1, 1))
    options = WalkOptions(exclude=("*.tmp",))

    def run():
        time.sleep(0.05)
        stream = read_changes(spark, [str(root)], options, settle=0).select("name")
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.name for r in spark.read.schema("name string").parquet(str(tmp_path / "out")).collect())

    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    make(root, "in/c", "skip2.tmp")
    (old / "moved").rename(root / "moved")
    (root / "a").write_bytes(b"other")
    assert run() == ["a", "a", "b", "c", "moved"]
    assert run() == ["a", "a", "b", "c", "moved"]


def test_an_interval_of_changes_is_the_same_when_read_again(tmp_path):
    from filecorpus.sources.listing import FileChangesReader

    make(tmp_path, "a", "x/b")
    reader = FileChangesReader([str(tmp_path)], WalkOptions(), 3, 0, 0)
    start, end = reader.initialOffset(), reader.latestOffset()

    def names(start, end):
        batches = [b for p in reader.partitions(start, end) for b in reader.read(p)]
        return sorted(n for b in batches for n in b.column("name").to_pylist())

    time.sleep(0.05)
    make(tmp_path, "late")
    assert names(start, end) == names(start, end) == ["a", "b"]
    assert names(end, reader.latestOffset()) == ["late"]
    since = FileChangesReader([str(tmp_path)], WalkOptions(), 3, time.time() + 60, 0)
    assert since.latestOffset() == since.initialOffset()


def expected_files(root, max_depth, skip_hidden, max_size, names):
    """Plain statement of which files a listing has; ``names`` are excluded base names."""
    found, pending = [], [(root, 0)]
    while pending:
        directory, depth = pending.pop()
        for path in directory.iterdir():
            if (skip_hidden and path.name.startswith(".")) or path.name in names or path.is_symlink():
                continue
            if path.is_dir() and (max_depth < 0 or depth + 1 <= max_depth):
                pending.append((path, depth + 1))
            if path.is_file() and (max_size <= 0 or path.stat().st_size <= max_size):
                found.append(str(path))
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, tmp_path, seed):
    chance = random.Random(seed)
    parts = ["a", "b", ".c", "_d", "e.txt", "f g", "ü"]
    for _ in range(60):
        path = tmp_path.joinpath(*chance.choices(parts, k=chance.randint(1, 4)))
        try:
            path.parent.mkdir(parents=True, exist_ok=True)
            if chance.random() < 0.1:
                path.symlink_to(chance.choice([tmp_path, tmp_path / "nowhere"]))
            else:
                path.write_bytes(b"x" * chance.choice([0, 1, 50, 500]))
        except OSError:
            pass  # a file is where a directory is wanted, or the other way round
    for _ in range(2):
        depth, hidden = chance.choice([-1, 0, 1, 2]), chance.random() < 0.5
        size, names = chance.choice([-1, 0, 1, 100]), chance.sample(["a", "_d", "ü", "e.txt"], chance.randint(0, 2))
        options = WalkOptions(depth, size, chance.random() < 0.5, hidden, tuple(names))
        want = expected_files(tmp_path, depth, hidden, size, names)
        for read in (read_listing, list_tree):
            rows = read(spark, [str(tmp_path)], options).collect()
            assert sorted(r.path for r in rows if r.kind == "file") == want
            listed = [r.path for r in rows if r.kind != "skipped"]
            assert len(listed) == len(set(listed))
            assert not [r for r in rows if r.kind == "error"]
