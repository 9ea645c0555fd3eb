import base64
import json

import pytest
from pyspark.sql import functions as F

from filecorpus.operators import batching
from filecorpus.operators.fingerprint import json_records
from filecorpus.schema import FINGERPRINT
from filecorpus.sinks import delivery
from filecorpus.sinks.tables import write_results


def no_wait(seconds):
    return None


def records(spark, n, partitions=5):
    key = F.format_string("%06d", (F.col("id") * 7919) % 1_000_003)
    return spark.range(n).select(key.alias("key")).repartition(partitions)


def assemble(rows, size):
    return batching.assemble_batches(rows, ["key"], size, F.to_json(F.struct("key")))


@pytest.mark.parametrize("n, size, want", [(5, 2, [2, 2, 1]), (0, 2, []), (4, 2, [2, 2]), (3, 1, [1] * 3), (3, 0, [1] * 3), (1, 100, [1])])
def test_batch_sizes(spark, n, size, want):
    got = assemble(records(spark, n), size).orderBy("batch_id").collect()
    assert [r.batch_id for r in got] == list(range(len(want)))
    assert [r.n_items for r in got] == want
    assert [len(json.loads(r.payload)) for r in got] == want


def test_batches_follow_the_order(spark):
    rows = records(spark, 1000, 13)
    keys = sorted(r.key for r in rows.collect())
    got = assemble(rows, 64).orderBy("batch_id").collect()
    assert [item["key"] for r in got for item in json.loads(r.payload)] == keys


def test_index_is_dense_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = batching.with_row_index(records(spark, 500), ["key"]).orderBy("key").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r.idx for r in got] == list(range(500))


def answers(*statuses):
    left = list(statuses)

    def send(payload):
        status = left.pop(0)
        if status is None:
            raise ConnectionError("refused")
        return status, b"body" * 1000

    return send


@pytest.mark.parametrize(
    "statuses, attempts, ok",
    [
        ([200], 1, True),
        ([204], 1, True),
        ([500, 200], 2, True),
        ([500, 502, 503, 500], 4, False),
        ([400], 1, False),
        ([404], 1, False),
        ([429, 429, 200], 3, True),
        ([None, 200], 2, True),
        ([None] * 4, 4, False),
        ([500, 400], 2, False),
        ([302, 200], 2, True),
    ],
)
def test_retries(statuses, attempts, ok):
    got, status, error = delivery.send_with_retries(answers(*statuses), b"[]", sleep=no_wait)
    assert (got, error is None) == (attempts, ok)
    assert status == statuses[-1]
    if not ok and status:
        assert error == f"API error (attempt {attempts}/4): status={status}, body={'body' * 512}"
    if status is None:
        assert error == "request error (attempt 4/4): refused"


def test_no_retries():
    assert delivery.send_with_retries(answers(500), b"", 0, no_wait)[0] == 1


def test_waits_before_retries():
    waits = []
    delivery.send_with_retries(answers(500, 500, 500, 500), b"", sleep=waits.append)
    assert [low <= w <= high for w, (low, high) in zip(waits, [(0.16, 0.24), (0.32, 0.48), (0.64, 0.96)], strict=True)]
    assert all(low <= w <= high for w, (low, high) in zip(waits, [(0.16, 0.24), (0.32, 0.48), (0.64, 0.96)]))
    assert delivery.backoff_seconds(10, 2.0) == 2.0
    assert delivery.backoff_seconds(10) == 5.0
    assert delivery.backoff_seconds(1, jitter=lambda: 0.5) == pytest.approx(0.2)


def test_auth_headers():
    basic = {"Authorization": "Basic " + base64.b64encode(b"user:pass").decode()}
    assert delivery.auth_headers("bearer", "t") == {"Authorization": "Bearer t"}
    assert delivery.auth_headers("api-key", "k") == {"X-API-Key": "k"}
    assert delivery.auth_headers("basic", ("user", "pass")) == basic
    assert delivery.auth_headers("basic", {"username": "user", "password": "pass"}) == basic
    for method, credentials in (("basic", "user:pass"), ("bearer", ("a", "b")), ("basic", {"username": "u"}), ("digest", "x")):
        with pytest.raises(ValueError):
            delivery.auth_headers(method, credentials)


def test_http_sender_builds_a_fresh_request_each_time(monkeypatch):
    seen = []

    class Answer:
        status = 201

        def read(self, n):
            return b"ok"

        def __enter__(self):
            return self

        def __exit__(self, *error):
            return False

    def urlopen(request, timeout):
        seen.append(request)
        return Answer()

    monkeypatch.setattr(delivery.urllib.request, "urlopen", urlopen)
    send = delivery.http_sender("http://api.example/files", "bearer", "token")
    assert send(b"[1]") == send(b"[1]") == (201, b"ok")
    assert seen[0] is not seen[1]
    assert [r.data for r in seen] == [b"[1]"] * 2
    assert seen[0].get_method() == "POST"
    assert seen[0].get_header("Content-type") == "application/json"
    assert seen[0].get_header("Authorization") == "Bearer token"


def test_http_sender_returns_refusals(monkeypatch):
    import io

    def urlopen(request, timeout):
        raise delivery.urllib.error.HTTPError(request.full_url, 503, "busy", {}, io.BytesIO(b"x" * 5000))

    monkeypatch.setattr(delivery.urllib.request, "urlopen", urlopen)
    status, body = delivery.http_sender("http://api.example/files", "api-key", "k")(b"[]")
    assert (status, len(body)) == (503, 2048)


def test_failed_batches_do_not_stop_the_others(spark, tmp_path):
    folder = str(tmp_path)

    def send(payload):
        first = json.loads(payload)[0]["key"]
        with open(f"{folder}/{first}", "ab") as file:
            file.write(b".")
        return (400, b"no") if int(first) % 2 else (200, b"")

    batches = assemble(records(spark, 95), 10)
    log = delivery.deliver_batches(batches, send, max_senders=3, sleep=lambda seconds: None)
    rows = log.orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == list(range(10))
    assert sum(r.n_items for r in rows) == 95
    assert all((r.status, r.error is None) in ((200, True), (400, False)) for r in rows)
    assert delivery.delivery_errors(log).first()[0] == sum(r.status == 400 for r in rows)
    # The log was read several times, but every batch was sent once.
    assert sorted(p.stat().st_size for p in tmp_path.iterdir()) == [1] * 10


def fingerprints(spark, **values):
    defaults = dict(path="/d/f", name="f", size=1, hash="h", hash_algorithm="md5", is_executable=False)
    defaults |= values
    return spark.createDataFrame([tuple(defaults.get(f.name) for f in FINGERPRINT)], FINGERPRINT)


def record(spark, **values):
    return json_records(fingerprints(spark, **values)).first().record


def test_record_leaves_out_what_says_nothing(spark):
    text = record(spark, strings=[], error="", mime_type="")
    assert text == (
        '{"path":"/d/f","name":"f","size":1,"modTime":"0001-01-01T00:00:00Z","hash":"h","hashAlgorithm":"md5"}'
    )


def test_record_in_full(spark):
    import datetime as dt

    moment = dt.datetime(2024, 5, 6, 7, 8, 10, 120_000)
    path = '/a<b>&"c" \u2028\u2029'
    text = record(
        spark, path=path, mod_time=moment, processed_at=moment.replace(microsecond=0),
        strings=["x<y"], error="bad", is_executable=True, mime_type="text/plain",
    )
    assert text == (
        '{"path":"/a\\u003cb\\u003e\\u0026\\"c\\" \\u2028\\u2029","name":"f","size":1,'
        '"modTime":"2024-05-06T07:08:10.12Z","hash":"h","hashAlgorithm":"md5",'
        '"mimeType":"text/plain","strings":["x\\u003cy"],"error":"bad","isExecutable":true,'
        '"processedAt":"2024-05-06T07:08:10Z"}'
    )
    assert json.loads(text)["path"] == path


def test_times_do_not_depend_on_the_session(spark):
    import datetime as dt

    # An hour that does not exist on clocks in Berlin.
    moment = dt.datetime(2024, 3, 31, 2, 30, 0, 5, tzinfo=dt.timezone.utc)
    rows = fingerprints(spark, mod_time=moment)
    for zone in ("Europe/Berlin", "America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert json.loads(json_records(rows).first().record)["modTime"] == "2024-03-31T02:30:00.000005Z"
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_record_of_a_failed_file(spark):
    text = record(spark, size=None, hash=None, error="stat error: x")
    assert json.loads(text) == {
        "path": "/d/f", "name": "f", "size": 0, "modTime": "0001-01-01T00:00:00Z", "hash": "",
        "hashAlgorithm": "md5", "error": "stat error: x",
    }


def test_results_as_a_table(spark, tmp_path):
    path = str(tmp_path / "results")
    for _ in range(2):
        write_results(fingerprints(spark).withColumn("processed_at", F.current_timestamp()), path)
    table = spark.read.parquet(path)
    assert table.count() == 2
    assert table.filter(F.col("scan_date") >= F.date_sub(F.current_date(), 1)).count() == 2
    write_results(fingerprints(spark), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first().path == "/d/f"
