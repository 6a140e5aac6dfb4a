"""Values, audit operators, journals, verified snapshots and documents: edge cases and errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumbrera.functions import values as W
from lumbrera.operators import audit as A
from lumbrera.operators import joins as J
from lumbrera.plans import evaluation, truth
from lumbrera.sources import documents, journal, snapshots


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("title", "action", "expected"),
    [
        ("Resolución por la que se otorga la modificación de la autorización administrativa previa del parque", "autorizacion_administrativa_previa", True),
        ("Resolución por la que se otorga autorización administrativa previa. Se modifica otra cosa", "autorizacion_administrativa_previa", False),
        ("Autorización administrativa previa de las modificaciones del parque y autorización administrativa de construcción de la planta", "autorizacion_administrativa_previa", True),
        ("Autorización administrativa previa de las modificaciones del parque y autorización administrativa de construcción de la planta", "autorizacion_administrativa_construccion", False),
        ("Autorización administrativa previa de las modificaciones del parque y autorización administrativa de construcción modificada", "autorizacion_administrativa_construccion", True),
        ("Anuncio de otra cosa", "autorizacion_explotacion", None), ("Prórroga modificada", "prorroga", False), (None, "autorizacion_explotacion", None),
    ],
)
def test_modifications(spark, title, action, expected):
    assert one(spark, title, lambda t: W.modification_expected(t, F.lit(action))) is expected


@pytest.mark.parametrize(("evidence", "expected"), [("Mediante resolución de 2020 se otorgó", True), ("Con fecha 3 de mayo", True), ("la sociedad había obtenido", True), ("se otorga la autorización", False), (None, False)])
def test_historical_wording(spark, evidence, expected):
    assert one(spark, evidence, W.is_historical) is expected


def test_ids_and_dates(spark):
    assert one(spark, "BOE-A-2024-1", lambda x: W.document_url(x, "u?")) == "u?BOE-A-2024-1"
    assert one(spark, "BOE-A-2024-1", lambda x: W.document_stem(x, F.lit("2024-05-06").cast("date"))) == "20240506_BOE-A-2024-1"
    for bad in ("BOE-2024", None):
        with pytest.raises(Exception, match="not a document id"):
            one(spark, bad, lambda x: W.document_url(x, "u?"))
    assert [one(spark, x, W.date_or_null) for x in ("nope", None)] == [None, None] and str(one(spark, "2024-02-29", W.date_or_null)) == "2024-02-29"
    assert [one(spark, x, lambda c: W.exact_code(c, 2)) for x in ("07", "7", "007", "0a", "07\n", None)] == [True, False, False, False, False, False]
    assert one(spark, " \t ", W.clean_or_null) is None and one(spark, None, W.text_or_empty) == ""


def test_names_lists_and_tables(spark):
    assert [one(spark, x, W.identity_name) for x in ("Straße-Ñandú, S.L.", "", None)] == ["strasse nandu s l", "", None]
    assert one(spark, "ﬁn\n  Año.", W.evidence_text) == "fin año."
    lists = one(spark, "las plantas (Sol A, B; C) y otra (una)", lambda x: W.bounded_lists(x, "plantas|otra"))
    assert lists == [["Sol A", "B", "C"]]
    assert one(spark, "planta Sol", lambda x: W.shared_prefix_names(x, F.array(F.lit("Luna")), "planta")) == ["planta Sol", "planta Luna"]
    table = "Plantas de generación\nDenominación\nExpediente\nSol A\nPE-1\nSol B\nPE-2\nFin\nsin\n"
    assert one(spark, table, lambda x: W.table_names(x, "denominación", "expediente", "generación", r"^pe-\d+$")) == ["sol a", "sol b"]
    assert one(spark, None, lambda x: W.table_names(x, "a", "b", "c", "d")) == []


def test_ratios_and_publications(spark):
    rows = spark.createDataFrame([(1, 2), (0, 0)], "n int, d int").select(*A.ratio(F.col("n"), F.col("d"), "r")).collect()
    assert [(r["r"], r["undefined_reason"]) for r in rows] == [(0.5, None), (None, "zero_denominator")]
    with pytest.raises(Exception, match="numerator"):
        spark.createDataFrame([(3, 2)], "n int, d int").select(*A.ratio(F.col("n"), F.col("d"), "r")).collect()
    days = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02")], "p string, day string")
    with pytest.raises(Exception, match="more than one date"):
        A.publication_summary(days.withColumn("act", F.lit("x")), days, "p", "day", "act").collect()


def test_what_must_be_unique(spark):
    facts = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = facts.unionByName(facts)
    for call in (
        lambda: A.current_sources(facts, twice, ["k"]), lambda: A.corrections_within(twice, facts, "k"), lambda: A.territorial_trace(facts, twice, facts, "k", "k"),
        lambda: J.one_registry(facts, facts, ["k"], facts, ["k"]), lambda: A.all_valid(facts, "v", "v"),
    ):
        with pytest.raises(J.CardinalityError):
            call()
    assert J.one_registry(facts, facts, ["k"], facts.filter("k > 1"), ["k"]).first()["registry"] == "first"
    assert A.misnumbered(spark.createDataFrame([(1, "1_x_1"), (1, "1_x_3"), (2, "2_x_1"), (3, None)], "g int, id string"), "g", "id", "x").orderBy("g").collect() == [(1, 2), (3, 1)]


def test_journals(spark, tmp_path):
    entries = spark.createDataFrame([("s", i, f"b{i}") for i in range(5)], "s string, at int, body string")
    chain = journal.chained(entries, ["s"], ["at"], "body")
    journal.write(chain, f"{tmp_path}/j")
    again = journal.read(spark, f"{tmp_path}/j", chain.schema)
    assert journal.problems(again, ["s"]).count() == 0 and journal.heads(again, ["s"]).first()["seq"] == 5
    cut = {r["seq"]: r["problems"] for r in journal.problems(again.filter("seq <> 3"), ["s"]).collect()}
    assert cut == {4: ["link", "sequence"]}
    assert journal.problems(again.withColumn("at", F.when(F.col("seq") == 4, 0).otherwise(F.col("at"))), ["s"]).first()["problems"] == ["time"]
    assert journal.chained(entries.filter("false"), ["s"], ["at"], "body").count() == 0


def test_snapshots_are_computed_again(spark, tmp_path):
    rows = spark.range(5).toDF("k")
    snapshots.publish({"all": rows, "large": rows.filter("k > 2")}, f"{tmp_path}/s")
    assert snapshots.read_recomputed(spark, f"{tmp_path}/s", {"large": lambda t: t["all"].filter("k > 2")})["large"].count() == 2
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read_recomputed(spark, f"{tmp_path}/s", {"large": lambda t: t["all"].filter("k > 3")})


def test_candidates_meet_their_documents(spark):
    candidate = spark.sql("SELECT 'D-1' AS id, DATE '2024-01-02' AS day, '20240102_D-1' AS stem, 'p1' AS policy")
    told = lambda id_: spark.sql(f"SELECT 'file:/x/20240102_D-1.xml' AS file, '{id_}' AS id, DATE '2024-01-02' AS day, 'text' AS text, 'h' AS sha256")
    row = documents.with_documents(candidate, told("D-1"), "p1", r"^D-\d+$").first()
    assert (row["text"], row["text_length"]) == ("text", 4)
    for args in ((candidate, told("D-2"), "p1"), (candidate, told("D-1").filter("false"), "p1"), (candidate, told("D-1"), "p2"), (candidate.withColumn("stem", F.lit("x")), told("D-1"), "p1"), (candidate, told("D-1").unionByName(told("D-1")), "p1")):
        with pytest.raises(J.CardinalityError):
            documents.with_documents(*args, r"^D-\d+$")


def test_affected_assets(spark):
    actions = spark.createDataFrame([("d", "e", "a1", True), ("d", "e", "a2", True), ("d", "e", "a3", True), ("d", "e", "a4", False), ("d", "e", "a5", True), ("d", "e", "a6", True)], "doc string, event string, action string, scored boolean")
    targets = spark.createDataFrame([("d", "a1", "event", "e", True), ("d", "a2", "associated_component", "c", True), ("d", "a3", "generation_asset", "x", False), ("d", "a5", "generation_asset", "nobody", True)], "doc string, action string, kind string, target string, scored boolean")
    assets = spark.createDataFrame([("d", "e", "x", True), ("d", "e", "y", True)], "doc string, event string, asset string, scored boolean")
    components = spark.createDataFrame([("d", "c", ["y"], True)], "doc string, component string, related array<string>, scored boolean")
    rows = {r["action"]: (r["affected"], r["complete"]) for r in truth.affected_assets(actions, targets, assets, components).collect()}
    assert rows == {"a1": (["x", "y"], True), "a2": (["y"], True), "a3": ([], False), "a4": ([], True), "a5": ([], False), "a6": ([], False)}


def test_assets_match_within_their_document(spark):
    truth_ = spark.createDataFrame([("d/1", "t", ["A b"]), ("d/2", "t", ["A b"])], "doc string, id string, names array<string>")
    told = spark.createDataFrame([("d/1", "p", ["a B."]), ("d/3", "p", ["a b"])], "doc string, id string, names array<string>")
    assert [tuple(r) for r in evaluation.match_assets(truth_, told).collect()] == [("d/1", "t", "p")]
