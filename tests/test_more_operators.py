"""Spans, geometry, evaluation and corrections."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbrera.operators import corrections, geometry, spans
from lumbrera.plans import evaluation


def test_shortest_unit(spark):
    df = spark.createDataFrame([("Title of SOL", "First line, long enough about SOL and LUNA.\nSOL. Only LUNA; SOL with LUNA.", ["sol", "Luna"]), (None, None, ["x"])], "t string, b string, a array<string>")
    units = spans.source_units(F.col("t"), F.col("b"))
    rows = df.select(units.alias("u"), spans.shortest_unit(units, F.col("a")).alias("s")).collect()
    assert rows[0]["u"][0] == "Title of SOL" and rows[0]["s"] == "SOL with LUNA." and rows[1]["u"] == [] and rows[1]["s"] is None


def test_units_keep_their_digits(spark):
    lines = [f"version {n}" for n in range(40)] + ["0 of 0", "11 of 11", "1. 22; 22"]
    text = "\n".join(f"  {line} " for line in [*lines, "", *lines[:3]])
    df = spark.createDataFrame([(" 10 years ", text)], "t string, b string")
    assert df.select(spans.source_units(F.col("t"), F.col("b"))).first()[0] == ["10 years", *lines, "1.", "22;", "22"]


def test_sections(spark):
    text = "intro HECHOS aaa GROUNDS bbb RESUELVE ccc"
    df = spark.createDataFrame([(text,)], "t string")
    at = lambda p: spans.places(F.col("t"), p)
    for word, want in (("intro", "pre_operative"), ("aaa", "facts"), ("bbb", "grounds"), ("ccc", "operative")):
        got = df.select(spans.section_at(F.lit(text.index(word)), at("HECHOS"), at("GROUNDS"), at("RESUELVE"))).first()[0]
        assert got == want
    assert df.select(spans.section_at(F.lit(0), at("x"), at("x"), at("x"))).first()[0] == "body"
    assert df.select(at("[A-Z]{5,}")).first()[0] == [text.index("HECHOS"), text.index("GROUNDS"), text.index("RESUELVE")]


def test_geometry(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 2.001), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in square],)], f"r {geometry.POINTS}")
    row = df.select(geometry.signed_area(F.col("r")).alias("a"), geometry.bounds(F.col("r")).alias("b"), geometry.inside(F.lit(1.0), F.lit(1.0), F.col("r")).alias("i"), geometry.inside(F.lit(3.0), F.lit(1.0), F.col("r")).alias("o")).first()
    assert row["a"] == pytest.approx(4.001) and tuple(row["b"]) == (0.0, 0.0, 2.0, 2.001) and row["i"] and not row["o"]
    assert len(geometry.simplify(df, "r", 0.01).first()["r"]) == 5
    assert len(geometry.simplify_points(np.array(square), 1e-9)) == 6


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"CODE".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4sIHH20s", b"\x03\0\0\0", 2, 32 + 32 + 1, 6, b"") + field + b"\r" + b" 28001" + b"*gone ")
    row = geometry.read_shapes(spark, f"{tmp_path}/a.shp", f"{tmp_path}/a.dbf").first()
    assert row["number"] == 1 and row["attributes"] == {"CODE": "28001"} and [(p["x"], p["y"]) for p in row["rings"][0]] == ring


def test_evaluation_cascade(spark):
    make = spark.createDataFrame
    truth = {
        "assets": make([("d", "a1", ["Sol"]), ("d", "a2", ["Luna", "Moon"]), ("d", "a3", ["Mar"])], "doc string, id string, names array<string>"),
        "events": make([("d", "e1", ["a1", "a2"]), ("d", "e2", ["a3"])], "doc string, id string, assets array<string>"),
        "actions": make([("d", "x1", "e1", "aap", ["se otorga"]), ("d", "x2", "e2", "dia", ["nada"])], "doc string, id string, event string, type string, fragments array<string>"),
    }
    predicted = {
        "assets": make([("d", "p1", ["SOL"]), ("d", "p2", ["moon"])], "doc string, id string, names array<string>"),
        "events": make([("d", "q1", ["p1", "p2"])], "doc string, id string, assets array<string>"),
        "actions": make([("d", "y1", "q1", "aap", ["Hoy SE  OTORGA aquí"]), ("d", "y2", "q1", "dia", ["otra"])], "doc string, id string, event string, type string, passages array<string>"),
    }
    rows = {r["entity"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.evaluate(truth, predicted).collect()}
    assert rows == {"assets": (2, 0, 1), "events": (1, 0, 1), "actions": (1, 1, 1)}
    outcome = evaluation.warning_outcomes(make([(True, True), (False, True), (False, False)], "e boolean, w boolean"), "e", "w").first()
    assert tuple(outcome) == (1, 1, 0, 1, 0.5)


def test_corrections_fail_closed(spark):
    targets = spark.createDataFrame([("a", "x", None), ("b", "y", "s")], "k string, kind string, sha string")
    good = spark.createDataFrame([("a", "x", None)], "k string, kind string, sha string")
    assert corrections.verified(good, targets, "k", ["kind", "sha"]).count() == 1
    for bad in ([("a", "z", None)], [("c", "x", None)]):
        with pytest.raises(corrections.CorrectionError):
            corrections.verified(spark.createDataFrame(bad, "k string, kind string, sha string"), targets, "k", ["kind", "sha"])
    rows, shared = corrections.scope(targets, "k", good.select("k"), targets.select("k"))
    assert rows.count() == 2 and shared == 1
    with pytest.raises(corrections.CorrectionError):
        corrections.scope(good, "k", targets.select("k"))
    assert corrections.one_row(targets, "k", "b")["kind"] == "y"
    with pytest.raises(corrections.CorrectionError):
        corrections.one_row(targets, "k", "z")
