"""Flattening of nested extractions."""

from __future__ import annotations

import json

import pytest

from lumbrera.plans import silver

DOCUMENT = {
    "boe_id": "BOE-A-2024-1", "publication_date": "2024-01-02",
    "publication_events": [
        {
            "event_summary": "s", "generation_assets": [
                {"local_generation_asset_ref": "generation_asset_1", "names_raw": ["Sol", "Sol I"], "generation_type": "fotovoltaica", "technical_mentions": [{"attribute_type": "potencia_pico", "value_raw": "5 MW", "evidence": "e"}], "evidence": "e"},
                {"local_generation_asset_ref": "generation_asset_2", "names_raw": ["Luna"], "generation_type": "eolica", "evidence": "e"},
            ],
            "associated_components": [{"local_component_ref": "component_1", "component_type": "almacenamiento", "names_raw": [], "related_generation_asset_refs": ["generation_asset_2"], "technical_mentions": [{"attribute_type": "potencia_almacenamiento", "value_raw": "1", "evidence": "e"}], "evidence": "e"}],
            "administrative_actions": [{"action_type": "a", "decision": "d", "targets": ["event", "generation_asset_1", "component_1"], "evidence": "e"}],
            "participants": [{"participant_name_raw": "P", "participant_role": "promotor", "evidence": "e"}],
            "administrative_locations": [{"location_name_raw": "L", "location_level": "municipio", "evidence": "e"}],
            "generation_relations": [{"source_generation_asset_ref": "generation_asset_1", "target_generation_asset_ref": "generation_asset_2", "relation_type": "r", "evidence": "e"}],
            "case_file_references": ["X/1"],
        },
        {"event_summary": "t", "generation_assets": [{"local_generation_asset_ref": "generation_asset_1", "names_raw": ["Mar"], "generation_type": "eolica", "evidence": "e"}], "administrative_actions": []},
    ],
}


@pytest.fixture(scope="module")
def tables(spark):
    empty = {"boe_id": "BOE-A-2024-2", "publication_date": "2024-01-03", "publication_events": []}
    df = spark.createDataFrame([(json.dumps(d),) for d in (DOCUMENT, empty)], "j string")
    return silver.flatten(silver.parse(df, "j"))


def test_tables(tables):
    assert len(tables) == 13
    counts = {name: df.count() for name, df in tables.items()}
    assert counts == {"publication_events": 2, "generation_asset_mentions": 3, "generation_asset_names": 4, "associated_components": 1, "associated_component_names": 0, "associated_component_generation_links": 1, "administrative_actions": 1, "administrative_action_targets": 3, "participant_mentions": 1, "location_mentions": 1, "generation_asset_relations": 1, "technical_mentions": 2, "case_file_references": 1}
    targets = sorted((r["target_kind"], r["target_entity_id"]) for r in tables["administrative_action_targets"].collect())
    e = "BOE-A-2024-1_event_1"
    assert targets == [("associated_component", f"{e}_component_1"), ("event", e), ("generation_asset", f"{e}_generation_asset_1")]
    assert sorted(r["technical_mention_id"] for r in tables["technical_mentions"].collect()) == [f"{e}_component_1_technical_1", f"{e}_generation_asset_1_technical_1"]
    assert tables["publication_events"].filter("event_index = 2").first()["n_administrative_actions"] == 0


def test_contracts(tables):
    assert silver.validate(tables).count() == 0
    broken = tables | {"generation_asset_mentions": tables["generation_asset_mentions"].filter("generation_type <> 'fotovoltaica'")}
    found = {(r["table_name"], r["check_name"]) for r in silver.validate(broken).collect()}
    assert ("generation_asset_names", "reference:generation_asset_mention_id->generation_asset_mentions") in found
    assert ("administrative_action_targets", "reference:target_entity_id->generation_asset_mentions:generation_asset") in found


def test_a_broken_document_is_an_error(spark):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        silver.parse(spark.createDataFrame([("{not json",)], "j string"), "j").collect()
