import random

import pytest
from pyspark.sql import functions as F

from filecorpus.operators import dedup
from filecorpus.operators.seen import SeenKeys
from filecorpus.schema import FINGERPRINT
from filecorpus.streaming.dedup import write_unique_by_table
from tests.test_dedup import row, rows_of


def files(n, seed=1):
    chance = random.Random(seed)
    return [row(f"/f{i:04d}", hash="hot" if i % 3 == 0 else f"h{chance.randrange(n // 2)}") for i in range(n)]


def plain(batches):
    """Kept (path, key) and suppressed (key, path, kept path, copies) of batches, by plain code."""
    holder, kept, lost = {}, [], {}
    for number, batch in enumerate(batches):
        good = [r for r in batch if r[5] is None]
        kept_here = set()
        for path, _, _, algorithm, digest, _ in sorted(good):
            key = f"{algorithm}:{digest}"
            if key not in holder:
                holder[key] = path
                kept.append((path, key))
                kept_here.add(key)
        once = set()
        for path, _, _, algorithm, digest, _ in good:
            key = f"{algorithm}:{digest}"
            if key in kept_here and path == holder[key] and key not in once:
                once.add(key)
                continue
            at = number, key, path, holder[key]
            lost[at] = lost.get(at, 0) + 1
    return sorted(kept), sorted((*k[1:], n) for k, n in lost.items())


def test_batches_against_plain_code(spark, tmp_path):
    rows = files(240)
    # A path twice in a batch, a path again in a later batch, an error row.
    batches = [[*rows[0::3], rows[0]], [*rows[1::3], rows[3], row("/bad", error="unreadable")], rows[2::3], []]
    seen = SeenKeys(spark, str(tmp_path / "seen"), buckets=4)
    kept, lost = [], []
    for n, batch in enumerate(batches):
        fresh = seen.accept(rows_of(spark, batch), str(n))
        assert fresh.columns == FINGERPRINT.names
        kept += [tuple(r) for r in fresh.select("path", dedup.dedup_key()).collect()]
        lost += [tuple(r) for r in seen.suppressed(rows_of(spark, batch), str(n)).collect()]
    assert (sorted(kept), sorted(lost)) == plain(batches)
    assert sorted((r.path, r.key) for r in seen.keys().collect()) == sorted(kept)


def test_a_batch_accepted_again_gives_the_same_rows(spark, tmp_path):
    rows = files(90)
    seen = SeenKeys(spark, str(tmp_path / "seen"), buckets=4)
    seen.accept(rows_of(spark, rows[:40]), "a")
    first = seen.accept(rows_of(spark, rows[20:]), "b").collect()
    again = seen.accept(rows_of(spark, rows[20:]), "b").collect()
    assert sorted(first, key=lambda r: r.path) == sorted(again, key=lambda r: r.path)
    keys = [r.key for r in seen.keys().collect()]
    assert len(keys) == len(set(keys)) == dedup.deduplicate(rows_of(spark, rows)).count()


def test_reset_and_a_folder_carried_on_with(spark, tmp_path):
    rows = rows_of(spark, files(60))
    folder = str(tmp_path / "it's seen")
    unique = SeenKeys(spark, folder, buckets=4).accept(rows, "a").count()
    other = SeenKeys(spark, folder, buckets=16)
    assert other.buckets == 4 and other.keys().count() == unique
    assert other.accept(rows, "b").count() == 0
    other.reset()
    assert other.keys().count() == 0 and other.accept(rows, "c").count() == unique


@pytest.mark.parametrize("by", ["hash", "path", "name", "unknown"])
def test_every_kind_of_key(spark, tmp_path, by):
    rows = rows_of(spark, files(30))
    seen = SeenKeys(spark, str(tmp_path / "seen"), buckets=2)
    got = [r.path for r in seen.accept(rows, "a", by).collect()]
    assert sorted(got) == sorted(r.path for r in dedup.deduplicate(rows, by).collect())
    assert seen.accept(rows, "b", by).count() == 0


def test_the_table_is_not_moved(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = SeenKeys(spark, str(tmp_path / "seen"), buckets=8)
        seen.accept(rows_of(spark, files(60)), "a")
        new = rows_of(spark, files(60, seed=2))
        for df in (seen.unseen(new), seen.suppressed(new, "a")):
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
            depth = lines[scan].index("FileScan")
            above = []  # the operators between the join and the scan
            for line in reversed(lines[:scan]):
                at = len(line) - len(line.lstrip(" :+-*()0123456789"))
                if at < depth:
                    above.append(line)
                    depth = at
                if "Join" in line:
                    break
            assert any("Join" in line for line in above) and not any("Exchange" in line for line in above), above
            assert "Bucketed: true" in lines[scan]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stream_goes_on_where_batches_and_runs_have_ended(spark, tmp_path):
    rows = files(150)
    seen = SeenKeys(spark, str(tmp_path / "seen"), buckets=4)
    source, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [rows[n::3] for n in range(3)]
    first = seen.accept(rows_of(spark, batches[0]), "by hand").select("path", dedup.dedup_key()).collect()
    for batch in batches[1:]:
        rows_of(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FINGERPRINT).parquet(source)
        write_unique_by_table(stream, output, state, seen).awaitTermination()
    kept = spark.read.parquet(output).select("path", dedup.dedup_key()).collect()
    lost = spark.read.parquet(f"{output}-suppressed").drop("batch").collect()
    want_kept, want_lost = plain(batches)
    assert sorted(map(tuple, first + kept)) == want_kept
    own = {r for r in plain(batches[:1])[1]}
    assert sorted(map(tuple, lost)) == [r for r in want_lost if r not in own]
    assert spark.read.parquet(output).select(F.countDistinct("batch")).first()[0] == 2
