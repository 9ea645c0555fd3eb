"""Delivery of JSON batches to a web API, with retries and a log.

Delivery is at least once: a task that runs again sends its batches again.
"""

from __future__ import annotations

import base64
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecorpus.schema import DELIVERY_LOG
from filecorpus.staging import stage

# Retries after the first attempt, longest wait, kept bytes of an error
# body, request time limit.
MAX_RETRIES = 3
MAX_BACKOFF_SECONDS = 5.0
ERROR_BODY_BYTES = 2048
REQUEST_SECONDS = 30.0
# Fixed value: 429 Too Many Requests, the one client error that is worth another attempt.
TOO_MANY_REQUESTS = 429
USER_AGENT = "filecorpus/1.0"

Send = Callable[[bytes], tuple[int, bytes]]


def backoff_seconds(
    retry: int,
    max_backoff: float = MAX_BACKOFF_SECONDS,
    jitter: Callable[[], float] = random.random,
) -> float:
    """Wait before the n-th retry: 0.1 s doubled n times, ±20 %, never above the limit."""
    return min(0.1 * 2**retry * (0.8 + 0.4 * jitter()), max_backoff)


def auth_headers(method: str, credentials: str | tuple[str, str] | Mapping[str, str]) -> dict[str, str]:
    """Headers for ``bearer`` (token), ``basic`` (user and password) or ``api-key`` (key)."""
    match method, credentials:
        case "bearer", str(token):
            return {"Authorization": f"Bearer {token}"}
        case "api-key", str(key):
            return {"X-API-Key": key}
        case "basic", ((str(user), str(password)) | {"username": str(user), "password": str(password)}):
            pair = base64.b64encode(f"{user}:{password}".encode()).decode("ascii")
            return {"Authorization": f"Basic {pair}"}
        case ("bearer" | "basic" | "api-key"), _:
            raise ValueError(f"{method} authentication cannot use credentials of this form")
    raise ValueError(f"unsupported authentication method: {method}")


def http_sender(
    endpoint: str,
    auth_method: str,
    credentials: str | tuple[str, str] | Mapping[str, str],
    user_agent: str = USER_AGENT,
    timeout: float = REQUEST_SECONDS,
    error_bytes: int | None = ERROR_BODY_BYTES,
) -> Send:
    """A ``send`` that posts a payload; it builds a fresh request for every attempt.

    Of the body of an answer ``error_bytes`` are kept, or all with None.
    """
    headers = {"Content-Type": "application/json", "User-Agent": user_agent}
    headers |= auth_headers(auth_method, credentials)

    def send(payload: bytes) -> tuple[int, bytes]:
        request = urllib.request.Request(endpoint, payload, headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return response.status, response.read(error_bytes)
        except urllib.error.HTTPError as refused:
            with refused:
                return refused.code, refused.read(error_bytes)

    return send


def send_with_retries(
    send: Send,
    payload: bytes,
    max_retries: int = MAX_RETRIES,
    sleep: Callable[[float], None] = time.sleep,
    error_bytes: int | None = ERROR_BODY_BYTES,
) -> tuple[int, int | None, str | None]:
    """(attempts, last status, error); a status of 2xx is success, NULL is no answer.

    Client errors end the attempts at once, except for 429; everything else is tried
    again.
    """
    attempts = max(max_retries, 0) + 1
    status = error = None
    for attempt in range(1, attempts + 1):
        if attempt > 1:
            sleep(backoff_seconds(attempt - 1))
        try:
            status, body = send(payload)
        except Exception as cause:  # any failure to get an answer is a network error
            status, error = None, f"request error (attempt {attempt}/{attempts}): {cause}"
            continue
        if 200 <= status < 300:
            return attempt, status, None
        text = bytes(body[:error_bytes]).decode("utf-8", "replace")
        error = f"API error (attempt {attempt}/{attempts}): status={status}, body={text}"
        if 400 <= status < 500 and status != TOO_MANY_REQUESTS:
            break
    return attempt, status, error


def deliver_batches(
    batches: DataFrame,
    send: Send,
    max_retries: int = MAX_RETRIES,
    max_senders: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    error_bytes: int | None = ERROR_BODY_BYTES,
) -> DataFrame:
    """Send ``batch_id, n_items, payload`` and return the log, one row per batch.

    Sending happens here and once: the log is written before it is returned, so reading
    it again does not send again. A failed batch is a row of the log and the others go
    on. ``max_senders`` limits how many batches are under way at a time.
    """

    def send_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            results = [
                send_with_retries(send, payload.as_py().encode("utf-8"), max_retries, sleep, error_bytes)
                for payload in part.column("payload")
            ]
            attempts, statuses, errors = zip(*results) if results else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("batch_id"),
                    part.column("n_items"),
                    pa.array(attempts, pa.int32()),
                    pa.array(statuses, pa.int32()),
                    pa.array(errors, pa.string()),
                ],
                names=DELIVERY_LOG.names,
            )

    if max_senders:
        batches = batches.repartition(max_senders, "batch_id")
    sent = batches.select("batch_id", "n_items", "payload").mapInArrow(send_all, DELIVERY_LOG)
    return stage(sent, "delivery")


def delivery_errors(log: DataFrame) -> DataFrame:
    """One row: ``delivery_errors``, the number of failed batches."""
    return log.agg(F.count("error").alias("delivery_errors"))
