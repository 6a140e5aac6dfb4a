"""Remote documents by key: fetched in tasks with bounded retries, every outcome a row."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

# Statuses worth another try, and the waits before it, in seconds.
TRANSIENT = frozenset({408, 429, 500, 502, 503, 504})
WAITS = (1.0, 2.0, 4.0)


class Response(NamedTuple):
    status: int
    body: bytes


Get = Callable[[str], Response]


def with_retries(get: Get, url: str, waits: Sequence[float] = WAITS, sleep: Callable[[float], None] = time.sleep) -> Response:
    """The first answer that isn't transient, or the last; connection errors count as transient."""
    for wait in (*waits, None):
        try:
            answer = get(url)
            if answer.status not in TRANSIENT or wait is None:
                return answer
        except (ConnectionError, TimeoutError):
            if wait is None:
                raise
        sleep(wait)
    raise AssertionError("unreachable")


def summary_status(answer: Response) -> tuple[str, str | None]:
    """success, no_publication (by HTTP status or by the body's own code) or failed, and the body's code."""
    try:
        body = json.loads(answer.body) if answer.body else {}
    except ValueError:
        return ("no_publication" if answer.status == 404 else "failed"), None
    code = str(body.get("status", {}).get("code")) if isinstance(body, dict) and isinstance(body.get("status"), dict) and "code" in body["status"] else None
    if answer.status == 404 or code == "404":
        return "no_publication", code
    return ("success" if answer.status == 200 and code in (None, "200") else "failed"), code


def document_status(answer: Response) -> tuple[str, str | None]:
    """downloaded, http_error, empty_response or invalid_response (not XML)."""
    if answer.status != 200:
        return "http_error", None
    body = answer.body.strip()
    return ("empty_response" if not body else "downloaded" if body.startswith(b"<") else "invalid_response"), None


def fetch(keys: DataFrame, key: str, url: Callable[[str], str | None], get: Get, judge: Callable[[Response], tuple[str, str | None]], waits: Sequence[float] = WAITS) -> DataFrame:
    """key, url, status, http_status, code, sha256, n_bytes, body (of successes) and error of each key.

    Write the result before use: a second action would fetch again.
    """

    def one(value: str) -> tuple:
        address = url(value)
        if not address:
            return value, None, "missing_url", None, None, None, 0, None, None
        try:
            answer = with_retries(get, address, waits)
        except Exception as error:  # noqa: BLE001  the outcome of a fetch is data
            return value, address, "request_error", None, None, None, 0, None, f"{type(error).__name__}: {error}"
        status, code = judge(answer)
        good = status in ("success", "downloaded")
        return value, address, status, answer.status, code, hashlib.sha256(answer.body).hexdigest() if good else None, len(answer.body), answer.body if good else None, None

    names = [key, "url", "status", "http_status", "code", "sha256", "n_bytes", "body", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(v) for v in pdf[key]], columns=names).astype({"http_status": "Int64"})

    return keys.select(key).mapInPandas(run, f"`{key}` string, url string, status string, http_status int, code string, sha256 string, n_bytes long, body binary, error string")
