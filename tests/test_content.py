import hashlib
import io
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from filecorpus.functions import content as C
from filecorpus.operators.fingerprint import file_lines, fingerprint, string_frequency, string_rows
from filecorpus.sources import content as S

PLAIN = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def strings_of(data, min_length=4, block=0):
    """Distinct printable runs in first-seen order, by definition."""
    blocks = [data[i : i + block] for i in range(0, len(data), block)] if block else [data]
    runs = [r.decode() for b in blocks for r in re.findall(rb"[\x20-\x7E]+", b)]
    return list(dict.fromkeys(r for r in runs if len(r) >= min_length))


@pytest.mark.parametrize("algorithm", C.HASH_ALGORITHMS)
def test_hashes(column_of, algorithm):
    values = [b"", b"The quick brown fox", bytes(range(256)), b"x" * 100_000]
    want = [hashlib.new(algorithm, v).hexdigest() for v in values]
    assert column_of(values, lambda v: C.content_hash(v, algorithm), "binary") == want


SOME_BYTES = st.lists(
    st.sampled_from([b"ab", b"WXYZ", b" ", b"~", b"\x7f", b"\t", b"\n", b"\0", b"\xc3\xa9", b"\xe2", b"\x82", b"\xf0\x90", b"\xff", b"\xed\xa0"]),
    max_size=30,
).map(b"".join)


@PLAIN
@given(st.lists(SOME_BYTES, min_size=20, max_size=60), st.integers(1, 6), st.sampled_from([0, 3, 8]))
def test_strings(column_of, values, min_length, block):
    got = column_of(values, lambda v: C.printable_strings(v, min_length, block), "binary")
    assert got == [strings_of(v, min_length, block) for v in values]


def test_strings_of_runs_between_other_bytes(column_of):
    runs = [f"{'run' * (i % 5 + 1)}{i}".encode() for i in range(40)]
    data = b"".join(run + bytes([(7 * i) % 32]) for i, run in enumerate(runs))
    for min_length in (1, 5, 9):
        got = column_of([data], lambda v: C.printable_strings(v, min_length), "binary")[0]
        assert got == [r.decode() for r in runs if len(r) >= min_length]


def test_strings_are_distinct_and_all_there(column_of):
    many = b"\0".join(b"string-%05d" % i for i in range(15_000))
    again, every, none, empty = column_of(
        [b"OVER AND OVER\0" * 1000, many, b"\0\1\2", b""], C.printable_strings, "binary"
    )
    assert again == ["OVER AND OVER"]
    assert every == [f"string-{i:05d}" for i in range(15_000)]
    assert none == empty == []
    first = column_of([many], lambda v: C.printable_strings(v, max_strings=7), "binary")
    assert first == [every[:7]]


@pytest.mark.parametrize("limit, size", [(100, 12), (12, 12), (5, 5), (0, 12), (-1, 12)])
def test_prefix(column_of, limit, size):
    data = "Hällo wörld"[:10].encode()
    assert column_of([data], lambda v: C.content_prefix(v, limit), "binary") == [data[:size]]


def test_lines(spark):
    texts = {"a": b"Line 1\nLine 2\nLine 3\n", "b": b"", "c": b"x\r\ny\rz\r\r\n", "d": b"one"}
    rows = file_lines(spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "path string, content binary"))
    assert sorted(map(tuple, rows.collect())) == [
        ("a", 0, "Line 1"), ("a", 1, "Line 2"), ("a", 2, "Line 3"), ("a", 3, ""),
        ("c", 0, "x"), ("c", 1, "y\rz\r"), ("c", 2, ""),
        ("d", 0, "one"),
    ]


def test_string_tables(spark):
    rows = [("a", bytearray(b"long\0tiny\0long")), ("b", bytearray(b"tiny"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    assert sorted(map(tuple, string_rows(files).collect())) == [("a", 0, "long"), ("a", 1, "tiny"), ("b", 0, "tiny")]
    assert sorted(map(tuple, string_frequency(files).collect())) == [("long", 2, 1), ("tiny", 2, 2)]


FILES = "path string, size bigint, mod_time timestamp, mode int, content binary"


def one(spark, content=b"0123456789abcdefgh", mode=0o644, **options):
    rows = [("/d/f.txt", len(content), None, mode, bytearray(content))]
    return fingerprint(spark.createDataFrame(rows, FILES), **options).first()


def test_fingerprint(spark):
    row = one(spark)
    assert row.hash == hashlib.sha256(b"0123456789abcdefgh").hexdigest()
    assert (row.name, row.size, row.hash_algorithm, row.error) == ("f.txt", 18, "sha256", None)
    assert (row.strings, row.mime_type, row.is_executable) == (None, None, False)
    assert row.processed_at is not None
    assert one(spark, mode=0o010).is_executable and one(spark, mode=0o001).is_executable
    assert one(spark, extract_strings=True).strings == ["0123456789abcdefgh"]
    assert one(spark, b"\0", extract_strings=True).strings == []


def test_fingerprint_errors(spark):
    row = one(spark, algorithm="unsupported")
    assert row.error == "hash error: unsupported hash algorithm: unsupported"
    assert (row.hash, row.size, row.name) == (None, 18, "f.txt")
    row = one(spark, max_size=10, extract_strings=True, mode=0o755)
    assert row.error == "file too large (18 bytes)"
    assert (row.hash, row.strings, row.size, row.is_executable) == (None, None, 18, True)
    assert one(spark).error is None
    assert one(spark, max_size=0).error == "file too large (18 bytes)"
    assert one(spark, b"", max_size=0).error is None
    # The size is looked at before the algorithm.
    assert one(spark, max_size=10, algorithm="x").error == "file too large (18 bytes)"


def test_missing_content_is_an_error(spark):
    row = fingerprint(spark.createDataFrame([("/f", 3, None, 0o644, None)], FILES)).first()
    assert (row.error, row.hash, row.size) == ("open error: no content", None, 3)


def test_algorithm_is_read_in_any_case(spark):
    row = one(spark, algorithm="SHA256")
    assert row.hash == hashlib.sha256(b"0123456789abcdefgh").hexdigest()
    assert row.hash_algorithm == "sha256"


def listing_of(spark, *paths):
    return spark.createDataFrame([(str(p),) for p in paths], "path string")


def test_read_content(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"content")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "a").chmod(0o755)
    missing = tmp_path / "missing"
    files = listing_of(spark, tmp_path / "a", tmp_path / "empty", missing)
    a, empty, gone = S.read_content(files.coalesce(1)).collect()
    assert (bytes(a.content), a.size, a.mode, a.error) == (b"content", 7, 0o755, None)
    assert (bytes(empty.content), empty.size, empty.error) == (b"", 0, None)
    assert (gone.content, gone.size) == (None, None)
    assert gone.error == f"stat error: stat {missing}: no such file or directory"
    assert bytes(S.read_content(files, max_bytes=3).first().content) == b"con"
    limited = S.read_content(files, max_size=3).first()
    assert (limited.content, limited.error, limited.size) == (None, None, 7)
    directory = S.read_content(listing_of(spark, tmp_path)).first()
    assert directory.error.startswith("open error: open ")


def test_content_comes_in_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 1000)
    for i in range(20):
        (tmp_path / f"{i:02d}").write_bytes(bytes([i]) * 400)
    files = listing_of(spark, *sorted(tmp_path.iterdir())).coalesce(1)
    got = S.read_content(files).collect()
    assert [bytes(r.content) for r in got] == [bytes([i]) * 400 for i in range(20)]


def sized(spark, *paths, size=True):
    rows = [(str(p), p.stat().st_size if size and p.exists() else None) for p in paths]
    return spark.createDataFrame(rows, "path string, size long")


@pytest.mark.parametrize("min_length, block, step", [(1, 0, 1), (4, 0, 3), (2, 0, 7), (3, 8, 5), (1, 3, 9)])
def test_strings_of_pieces_are_those_of_the_whole(spark, tmp_path, min_length, block, step):
    chance = random.Random(step)
    parts = [b"ab", b"WXYZ", b" ", b"~", b"\x7f", b"\n", b"\0", b"\xc3\xa9", b"\xff", b"long run of text "]
    paths = [tmp_path / str(i) for i in range(30)]
    for path in paths:
        path.write_bytes(b"".join(chance.choices(parts, k=chance.randint(0, 30))))
    for size in (True, False):
        rows = S.strings_of_files(sized(spark, *paths, size=size), min_length, block, step).collect()
        for path in paths:
            own = sorted((r.at, r.string) for r in rows if r.path == str(path))
            assert [x for _, x in own] == strings_of(path.read_bytes(), min_length, block)


@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_lines_of_pieces_are_those_of_the_whole(spark, tmp_path, step):
    chance = random.Random(step)
    paths = [tmp_path / str(i) for i in range(30)]
    for path in paths:
        path.write_bytes(b"".join(chance.choices([b"a", b"bcd", b"\n", b"\r\n", b"\r", "é".encode()], k=chance.randint(0, 25))))
    gone = tmp_path / "gone"
    rows = S.lines_of_files(sized(spark, *paths, gone), step).collect()
    contents = spark.createDataFrame([(str(p), bytearray(p.read_bytes())) for p in paths], "path string, content binary")
    want = sorted(map(tuple, file_lines(contents).collect()))
    assert sorted((r.path, r.line_no, r.line) for r in rows if r.error is None) == want
    (failed,) = [r for r in rows if r.error]
    assert failed.path == str(gone) and failed.error.startswith("open error: open ")


def test_digests_of_any_size(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    found = {r.path: r for r in S.digest_files(sized(spark, tmp_path / "a", tmp_path / "gone"), "sha1").collect()}
    assert found[str(tmp_path / "a")].hash == hashlib.sha1(b"x" * 3_000_000).hexdigest()
    assert found[str(tmp_path / "gone")].error.startswith("stat error")
    refused = S.digest_files(sized(spark, tmp_path / "a"), "sha1", max_size=10).first()
    assert (refused.hash, refused.error) == (None, "file too large (3000000 bytes)")


def test_files_are_spread_by_bytes(spark):
    sizes = [60] * 12 + [1] * 5000
    files = spark.createDataFrame([(f"/{i}", s << 20) for i, s in enumerate(sizes)], "path string, size long")
    spread = S.spread_by_bytes(files, 256 << 20)
    held = [sum(r.size for r in part) >> 20 for part in spread.rdd.glom().collect()]
    assert sum(held) == sum(sizes) and max(held) < 600
    assert S.spread_by_bytes(files.limit(0)).count() == 0


class Counted(io.FileIO):
    """A file that counts the bytes that were read."""

    n = 0

    def read(self, size=-1):
        block = super().read(size)
        Counted.n += len(block)
        return block


@pytest.mark.parametrize("every", [None, 1, 3, 50, 99, 100, 101, 450, 4000])
def test_no_byte_is_read_more_than_twice(tmp_path, monkeypatch, every):
    content = bytearray(b"x" * 4000)
    if every:
        content[every - 1 :: every] = b"\n" * len(content[every - 1 :: every])
    (tmp_path / "a").write_bytes(content)
    monkeypatch.setattr(S, "_BLOCK", 16)
    monkeypatch.setattr(S, "open", lambda path, mode: Counted(path), raising=False)
    Counted.n = 0
    ends = [*range(100, 4000, 100), None]
    pieces = [S._piece(str(tmp_path / "a"), i * 100, end, re.compile(rb"\n")) for i, end in enumerate(ends)]
    assert b"".join(p[0] for p in pieces) == content and all(p[2] is None for p in pieces)
    assert all(p[0].endswith(b"\n") or p[1] for p in pieces if p[0])
    # A search reads by blocks, so it may read one in part for nothing.
    assert Counted.n <= 2 * len(content) + 16 * len(ends)


def test_pieces_too_long_for_a_value(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 500 + b"\n" + b"ab\n" + b"c")
    monkeypatch.setattr(S, "_BLOCK", 16)
    monkeypatch.setattr(S, "_MOST_BYTES", 200)
    found = [S._piece(str(tmp_path / "a"), i, i + 100 if i < 500 else None, re.compile(rb"\n")) for i in range(0, 600, 100)]
    assert found[0] == (None, False, f"read error: {tmp_path / 'a'}: 501 bytes without a break from byte 0")
    assert [p[0] for p in found[1:]] == [b"", b"", b"", b"", b"ab\nc"]
