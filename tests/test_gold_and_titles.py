"""Titles, and the way from mentions to projects."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lumbrera.functions import titles
from lumbrera.operators import joins
from lumbrera.plans import gold


@pytest.mark.parametrize(
    ("title", "actions"),
    [
        ("Resolución por la que se otorga autorización administrativa previa a la planta fotovoltaica SOL", ["autorizacion_administrativa_previa"]),
        ("Corrección de errores de la Declaración de Impacto Ambiental", ["correccion_errores"]),
        ("Anuncio por el que se somete a información pública la solicitud de declaración de impacto ambiental", ["evaluacion_impacto_ambiental"]),
        ("Anuncio por el que se somete a información pública el proyecto", ["informacion_publica"]),
        ("Se acuerda el archivo del expediente de autorización administrativa previa", ["terminacion_procedimiento"]),
        ("Desistimiento de la solicitud de autorización administrativa previa y se otorga la concesión", ["concesion_aguas", "terminacion_procedimiento"]),
        ("Otra cosa", []), (None, []),
    ],
)
def test_title_actions(spark, title, actions):
    assert spark.createDataFrame([(title,)], "t string").select(titles.title_actions(F.col("t"))).first()[0] == actions


@pytest.mark.parametrize(
    ("title", "action", "decision"),
    [
        ("Se deniega la autorización administrativa previa", "autorizacion_administrativa_previa", "denegado"),
        ("Se desestima la solicitud de autorización administrativa previa", "autorizacion_administrativa_previa", "desestimado"),
        ("Solicitud de autorización de explotación", "autorizacion_explotacion", "solicitado"),
        ("Declaración de impacto ambiental desfavorable", "declaracion_impacto_ambiental", "desfavorable"),
        ("Inadmisión de la solicitud", "terminacion_procedimiento", "inadmitido"), ("x", "nada", "otro"),
    ],
)
def test_title_decision(spark, title, action, decision):
    assert spark.createDataFrame([(title, action)], "t string, a string").select(titles.title_decision(F.col("t"), F.col("a"))).first()[0] == decision


@pytest.mark.parametrize(
    ("title", "decision", "rule"),
    [
        ("Anuncio de licitación del parque eólico", "force_not_relevant", "procurement"), ("Gasoducto de enlace", "force_not_relevant", "gas_infrastructure"),
        ("Sistema de almacenamiento de energía LUNA", "force_not_relevant", "standalone_storage"), ("Sistema de almacenamiento hibridado con planta solar", "no_deterministic_decision", None),
        ("Confederación Hidrográfica del Ebro: concesión para riego", "force_not_relevant", "water_authority"), ("Planta solar SOL: autorización administrativa previa", "require_project_review", "generation_and_action"),
    ],
)
def test_scope_guard(spark, title, decision, rule):
    got = spark.createDataFrame([(title,)], "t string").select(titles.scope_guard(F.col("t")).alias("g")).first()["g"]
    assert (got["decision"], got["rule"]) == (decision, rule)


def test_types_and_dates(spark):
    df = spark.createDataFrame([("PLANTA EÓLICA", "el 5 de Marzo de 2024, 31/2/2020 y 1-1-2019"), ("eólica y fotovoltaica", ""), (None, None)], "t string, d string")
    rows = df.select(titles.generation_type(F.col("t")), titles.dates(F.col("d")), titles.has_earlier_date(F.col("d"), F.lit("2020-01-01").cast("date"))).collect()
    assert tuple(rows[0]) == ("eolica", [datetime.date(2019, 1, 1), datetime.date(2024, 3, 5)], True)
    assert rows[1][0] is None and rows[2][1] == [] and rows[2][2] is False


@pytest.fixture(scope="module")
def silver(spark):
    make = spark.createDataFrame
    return {
        "events": make([("e1", "b1", "2024-01-01", 1), ("e2", "b2", "2024-02-01", 1)], "event_id string, publication_id string, publication_date string, event_index int"),
        "assets": make([("a1", "e1", "fv"), ("a2", "e1", "fv"), ("a3", "e2", "fv")], "asset_id string, event_id string, technology string"),
        "grouping": make([("a1", "p1"), ("a2", "p2"), ("a3", "p1")], "asset_id string, project_id string"),
        "names": make([("a1", "Sol"), ("a3", "Planta Sol"), ("a2", "Luna")], "asset_id string, name string"),
        "actions": make([("x1", "e1", 1, "aap", "ok"), ("x2", "e1", 2, "dia", "ok"), ("x3", "e1", 3, "aac", "no"), ("x4", "e2", 1, "aap", "ok")], "action_id string, event_id string, action_index int, action_type string, decision string"),
        "targets": make([("e1", "x1", "event", "e1"), ("e1", "x2", "generation_asset", "a2"), ("e1", "x3", "associated_component", "c1"), ("e2", "x4", "generation_asset", "a3"), ("e1", "x2", "event", "other")], "event_id string, action_id string, target_kind string, target_id string"),
        "links": make([("e1", "c1", "a1")], "event_id string, component_id string, asset_id string"),
        "places": make([("m1", "e1", "resolved", "resolved", "resolved", "M1", "Uno", "P1", "Prov", "C1"), ("m2", "e1", "ambiguous", "resolved", "resolved", None, None, "P1", "Prov", "C1"), ("m3", "e2", "not_found", "not_found", "not_provided", None, None, None, None, None)],
                       "mention_id string, event_id string, municipality_status string, province_status string, community_status string, municipality_code string, municipality string, province_code string, province string, community_code string"),
    }


def test_gold(silver):
    t = silver
    owned = gold.asset_projects(t["assets"], t["grouping"])
    facts = gold.project_events(t["events"], t["actions"], t["targets"], t["links"], owned)
    assert sorted((r["project_id"], r["action_id"]) for r in facts.collect()) == [("p1", "x1"), ("p1", "x3"), ("p1", "x4"), ("p2", "x1"), ("p2", "x2")]
    rows = {r["project_id"]: r for r in gold.projects(t["events"], t["names"], t["places"], owned, facts).collect()}
    assert rows["p1"]["project_name"] == "Planta Sol" and rows["p1"]["n_publications"] == 2 and rows["p1"]["n_administrative_actions"] == 3
    assert rows["p2"]["municipality_codes"] == "M1" and rows["p2"]["provinces"] == "Prov"
    places, sources = gold.project_places(t["events"], t["places"], owned)
    assert sorted((r["project_id"], r["level"], r["code"], r["n_mentions"]) for r in places.collect()) == [("p1", "municipality", "M1", 1), ("p1", "province", "P1", 1), ("p2", "municipality", "M1", 1), ("p2", "province", "P1", 1)]
    assert sources.count() == 4


def test_gold_fails_closed(silver):
    with pytest.raises(joins.CardinalityError):
        gold.asset_projects(silver["assets"], silver["grouping"].filter("asset_id <> 'a3'"))
    owned = gold.asset_projects(silver["assets"].withColumn("technology", F.when(F.col("asset_id") == "a3", "w").otherwise("fv")), silver["grouping"])
    with pytest.raises(ValueError, match="several technologies"):
        gold.projects(silver["events"], silver["names"], silver["places"], owned, owned)
