"""Retrieval of earlier publications, and fetching with retries."""

from __future__ import annotations

import json

import pytest

from lumbrera.plans import history
from lumbrera.sources import remote


def test_history(spark):
    mentions = spark.createDataFrame([("p1", "Planta Solar Alcarria Norte", "Cuenca", "fotovoltaica"), ("p2", "Valdemoro", "Soria", "eolica"), ("p3", "Parque", "X", "eolica")], "project_id string, name string, location string, technology string")
    docs = spark.createDataFrame([
        (1, "2020-01-01", "Sobre la planta solar Alcarria Norte."), (2, "2020-01-01", "Norte de la Alcarria: huerto fotovoltaico"), (3, "2020-01-01", "Norte de la Alcarria, caza"),
        (4, "2020-01-01", "VALDEMORO: parque eólico"), (5, "2025-01-01", "Valdemoro eólico"), (6, "2025-01-01", "Valdemoro, Soria"), (7, "2020-01-01", "Valdemoro eólico"), (8, "2020-01-01", "Alcarria en Cuenca, norte"),
    ], "doc_id long, day string, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    links, scope = history.build(mentions, docs, ids(6), ids(7), "2019-01-01", "2025-12-31", "2024-01-01")
    assert sorted((r["project_id"], r["doc_id"], r["tier"]) for r in links.collect()) == [("p1", 1, 1), ("p1", 2, 2), ("p1", 8, 2), ("p2", 4, 1), ("p2", 6, 1)]
    assert scope.count() == 5


def test_retries():
    answers, waits = [remote.Response(503, b""), ConnectionError(), remote.Response(200, b"x")], []

    def get(_):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert remote.with_retries(get, "u", sleep=waits.append).body == b"x" and waits == [1.0, 2.0]
    with pytest.raises(ConnectionError):
        remote.with_retries(lambda _: (_ for _ in ()).throw(ConnectionError()), "u", waits=(0,), sleep=waits.append)
    assert remote.with_retries(lambda _: remote.Response(429, b""), "u", waits=(0,), sleep=waits.append).status == 429


@pytest.mark.parametrize(("status", "body", "want"), [(200, {"status": {"code": "200"}}, "success"), (200, {"status": {"code": 404}}, "no_publication"), (404, None, "no_publication"), (500, {}, "failed"), (200, {}, "success")])
def test_summary_status(status, body, want):
    assert remote.summary_status(remote.Response(status, b"" if body is None else json.dumps(body).encode()))[0] == want


def test_fetch(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "k string")
    bodies = {"http://a": (200, b"<x/>"), "http://b": (200, b" "), "http://c": (404, b"no"), "http://d": (200, b"plain")}

    def get(url):
        return remote.Response(*bodies[url])

    rows = {r["k"]: r for r in remote.fetch(keys, "k", lambda k: None if k == "e" else f"http://{k}", get, remote.document_status, waits=()).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a": "downloaded", "b": "empty_response", "c": "http_error", "d": "invalid_response", "e": "missing_url"}
    assert rows["a"]["n_bytes"] == 4 and rows["a"]["sha256"] and rows["c"]["body"] is None
