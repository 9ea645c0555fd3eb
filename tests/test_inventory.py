import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from filecorpus.functions.content import HASH_ALGORITHMS
from filecorpus.operators import joins, tree
from filecorpus.plans import inventory
from filecorpus.plans.inventory import FingerprintOptions, fingerprint_files, run_inventory
from filecorpus.sources import content
from filecorpus.sources.listing import WalkOptions
from filecorpus.staging import new_folder, staging_folder


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for name, content in {
        "a.txt": b"first file",
        "b.txt": b"second file",
        "copy1.txt": b"equal content",
        "sub/copy2.txt": b"equal content",
        "sub/nested/c.bin": b"\0\1visible\2",
        "sub/huge.bin": b"x" * 5000,
        ".secret": b"hidden",
        "drop.tmp": b"excluded",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root


def test_whole_job(spark, corpus, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()
    folder = str(sent)

    def send(payload):
        name = hashlib.md5(payload).hexdigest()
        with open(f"{folder}/{name}", "wb") as file:
            file.write(payload)
        return 200, b""

    result = run_inventory(
        spark,
        [str(corpus), str(tmp_path / "missing")],
        WalkOptions(exclude=("*.tmp",)),
        FingerprintOptions("MD5", extract_strings=True, max_size=4000),
        send,
        batch_size=2,
    )
    assert result.summary.first().asDict() == {
        "total": 6, "unique_files": 4, "duplicates": 2, "errors": 1, "scan_errors": 1, "delivery_errors": 0,
    }
    assert "NestedLoop" not in result.summary._jdf.queryExecution().executedPlan().toString()
    delivered = [item for p in sent.iterdir() for item in json.loads(p.read_bytes())]
    assert len(list(sent.iterdir())) == 2
    by_name = {item["name"]: item for item in delivered}
    assert set(by_name) == {"a.txt", "b.txt", "copy1.txt", "c.bin"}
    assert by_name["a.txt"]["hash"] == hashlib.md5(b"first file").hexdigest()
    assert by_name["c.bin"]["strings"] == ["visible"]
    assert all("error" not in item and "isExecutable" not in item for item in delivered)
    refused = result.fingerprints.filter("error IS NOT NULL").first()
    assert (refused.name, refused.error) == ("huge.bin", "file too large (5000 bytes)")


def test_job_without_delivery(spark, corpus):
    result = run_inventory(spark, [str(corpus)])
    row = result.summary.first()
    assert (row.total, row.unique_files, row.delivery_errors) == (7, 6, 0)
    assert result.delivery_log is None


@pytest.mark.parametrize("algorithm", [*HASH_ALGORITHMS, "crc32"])
def test_files_too_large_for_a_cell(spark, corpus, monkeypatch, algorithm):
    """Large files give the same rows as if they had gone through a cell."""
    files = spark.createDataFrame(
        [(str(p), p.stat().st_size, None, None) for p in corpus.rglob("*") if p.is_file()]
        + [(str(corpus / "gone"), 9_000, None, None)],
        "path string, size bigint, mod_time timestamp, mode int",
    )
    for limit, most in ((None, None), (3_000, 1), (9_999, None)):
        options = FingerprintOptions(algorithm, extract_strings=True, max_size=limit, max_strings=most)
        seen = []
        for cell in (1 << 20, 12):
            monkeypatch.setattr(inventory, "CELL_BYTES", cell)
            monkeypatch.setattr(content, "RANGE_BYTES", 5)
            rows = fingerprint_files(files, options).drop("processed_at")
            seen.append(sorted(map(tuple, rows.collect()), key=lambda r: r[0]))
        assert seen[0] == seen[1]
        assert len(seen[0]) == 9


def test_files_of_any_size(spark, tmp_path):
    """No limit is lowered here: a cell, files too large for one, all read by default."""
    sizes = {"strings": 17 << 20, "cell": 63 << 20, "large": 110 << 20}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as file:
            file.write(b"start of " + name.encode())
            file.truncate(size)
            file.seek(size)
            file.write(b"end of " + name.encode())
    listing = spark.createDataFrame(
        [(str(tmp_path / name), size, None, None) for name, size in sizes.items()]
        # Nor need the listing know the sizes.
        + [(str(tmp_path / name), None, None, None) for name in sizes],
        "path string, size bigint, mod_time timestamp, mode int",
    )
    for options in (FingerprintOptions(), FingerprintOptions(extract_strings=True, max_size=200 << 20)):
        rows = sorted(fingerprint_files(listing, options).collect(), key=lambda r: r.name)
        assert [r.name for r in rows] == ["cell"] * 2 + ["large"] * 2 + ["strings"] * 2
        for row in rows:
            with open(row.path, "rb") as file:
                assert row.hash == hashlib.file_digest(file, "sha256").hexdigest()
            both = [f"start of {row.name}", f"end of {row.name}"]
            assert row.strings == (both if options.extract_strings else None)
    refused = fingerprint_files(listing.filter("size > 100000000"), FingerprintOptions(max_size=100 << 20))
    assert refused.first().error.startswith("file too large (")


def test_lines_of_a_file_too_large_for_a_cell(spark, tmp_path):
    with open(tmp_path / "big", "wb") as file:
        file.write(b"first\r\nsecond\n")
        file.truncate(70 << 20)
        file.seek(70 << 20)
        file.write(b"\nlast\n")
    listing = spark.createDataFrame([(str(tmp_path / "big"), (70 << 20) + 6)], "path string, size long")
    rows = content.lines_of_files(listing).select("line_no", F.length("line").alias("n"), F.left("line", F.lit(6)).alias("line"))
    got = sorted(map(tuple, rows.collect()))
    assert [(no, n) for no, n, _ in got] == [(0, 5), (1, 6), (2, (70 << 20) - 14), (3, 4), (4, 0)]
    assert [line for _, n, line in got if n < 10] == ["first", "second", "last", ""]


def test_one_limit_for_the_whole_job(spark, corpus):
    for arguments in ({"max_size": 4000}, {"options": FingerprintOptions(max_size=4000)}, {"max_size": 4000, "walk": WalkOptions(max_depth=9)}):
        row = run_inventory(spark, [str(corpus)], **arguments).summary.first()
        assert (row.total, row.errors) == (7, 1)


def test_nothing_staged_is_left_behind(spark, corpus):
    result = run_inventory(spark, [str(corpus)], send=lambda payload: (200, b""))
    assert result.summary.first().total == 7
    made = list(result.folders.made)
    assert len(made) >= 4 and all(os.path.exists(f.removeprefix("file:")) for f in made)
    result.clean_up()
    assert not any(os.path.exists(f.removeprefix("file:")) for f in made)


def test_staging_uses_the_folder_of_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert staging_folder(spark) == shared.rstrip("/")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_hot_lookup_key_is_spread(spark):
    rows = spark.range(6000).selectExpr("cast(id as string) as path", "if(id % 3 = 0, 'hot', cast(id as string)) as key")
    lookup = spark.createDataFrame([("hot", 1), ("1", 2), ("none", 3)], "key string, v int")
    for small in (True, False):
        joined = joins.lookup_join(rows, lookup, "key", salt_on=["path"], small=small)
        assert joined.groupBy("v").count().orderBy("v").collect() == [(1, 2000), (2, 1)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("_salt" in line for line in shuffles) == 3
    assert sum("_salt" not in line for line in shuffles) == 2


def test_table_bytes(spark):
    small = spark.createDataFrame([("abc", 1), (None, 2)], "s string, i int")
    assert joins.table_bytes(small) == 2 * 16 + 3
    assert joins.table_bytes(small.limit(0)) == 0


def test_directory_rollup_and_extensions(spark):
    rows = [("/r", "/r/a.txt", 1, "x", 0o755), ("/r", "/r/d/b.txt", 2, "x", 0o644), ("/r", "/r/d/e/c", 4, None, 0o644)]
    files = spark.createDataFrame(rows, "root string, path string, size bigint, hash string, mode int")
    rollup = {tuple(r) for r in tree.directory_rollup(files).collect()}
    assert rollup == {("/r", 3, 7, 1), ("/r/d", 2, 6, 1), ("/r/d/e", 1, 4, 0)}
    profile = {tuple(r) for r in tree.extension_profile(files).collect()}
    assert profile == {("txt", 2, 3, 1, 1), ("", 1, 4, 0, 0)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_directory_rollup_against_plain_code(spark, partitions):
    """Deep trees, two roots, a hash that a third of the files have, files without a hash."""
    random_ = random.Random(partitions)
    rows = []
    for i in range(900):
        root = random_.choice(["/r", "/r2", "/"])
        steps = [random_.choice(["a", "b", "a b", "a!"]) for _ in range(random_.choice([0, 1, 2, 3, 12]))]
        hash_ = random_.choice(["hot", None, f"h{random_.randrange(40)}"])
        size = None if hash_ is None else random_.randrange(100)
        rows.append((root, "/".join([root.rstrip("/"), *steps, f"f{i}"]), size, hash_))
    want = {}
    for root, path, size, hash_ in rows:
        relative = path[len(root.rstrip("/")) + 1 :].split("/")[:-1]
        for k in range(len(relative) + 1):
            directory = "/".join([root.rstrip("/"), *relative[:k]]) or "/"
            node = want.setdefault(directory, [0, None, set()])
            node[0] += 1
            node[1] = node[1] if size is None else size + (node[1] or 0)
            node[2] |= {hash_} - {None}
    files = spark.createDataFrame(rows, "root string, path string, size bigint, hash string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rollup = {r[0]: tuple(r[1:]) for r in tree.directory_rollup(files.repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rollup == {d: (n, size, len(hashes)) for d, (n, size, hashes) in want.items()}


def test_directory_rollup_of_nothing(spark):
    files = spark.createDataFrame([], "root string, path string, size bigint, hash string")
    assert tree.directory_rollup(files).collect() == []


def test_strings_of_a_large_file_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "CELL_BYTES", 100)
    monkeypatch.setattr(inventory, "STRINGS_BYTES", 400)
    (tmp_path / "many").write_bytes(b"\0".join(b"string %d" % i for i in range(100)))
    (tmp_path / "few").write_bytes(b"\0".join([b"one string", b"another"] * 50))
    (tmp_path / "none").write_bytes(b"\0" * 500)
    rows = [(str(p), p.stat().st_size, None, 0o644) for p in sorted(tmp_path.iterdir())]
    listing = spark.createDataFrame(rows, "path string, size bigint, mod_time timestamp, mode int")

    def found(**options):
        made = inventory.fingerprint_files(listing, FingerprintOptions(extract_strings=True, **options))
        return {r.name: (r.strings, r.error) for r in made.collect()}

    got = found()
    assert got["few"] == (["one string", "another"], None) and got["none"] == ([], None)
    assert got["many"][0] is None
    assert got["many"][1] == f"strings error: {tmp_path}/many: 1690 bytes of strings for one cell"
    # The first strings alone are within the bound.
    assert found(max_strings=3)["many"] == (["string 0", "string 1", "string 2"], None)
