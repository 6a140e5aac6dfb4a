"""Nested extractions (JSON) flattened to thirteen tables with positional ids, and their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import positional
from ..operators.contracts import ForeignKey, TableSpec, violations

# The fields of an extraction, as DDL.
_TECHNICAL = "technical_mentions: array<struct<attribute_type: string, value_raw: string, evidence: string>>"
EXTRACTION = (
    "boe_id string, publication_date date, classification_status string, document_scope string, classification_reason string, publication_events array<struct<"
    f"generation_assets: array<struct<local_generation_asset_ref: string, names_raw: array<string>, generation_type: string, {_TECHNICAL}, evidence: string>>, "
    f"associated_components: array<struct<local_component_ref: string, component_type: string, names_raw: array<string>, description_raw: string, related_generation_asset_refs: array<string>, {_TECHNICAL}, evidence: string>>, "
    "administrative_actions: array<struct<action_type: string, decision: string, is_modification: boolean, targets: array<string>, evidence: string>>, "
    "participants: array<struct<participant_name_raw: string, participant_role: string, evidence: string>>, "
    "administrative_locations: array<struct<location_name_raw: string, location_level: string, province_hint_raw: string, autonomous_community_hint_raw: string, evidence: string>>, "
    "generation_relations: array<struct<source_generation_asset_ref: string, target_generation_asset_ref: string, relation_type: string, evidence: string>>, "
    "case_file_references: array<string>, event_summary: string>>, extraction_notes string"
)
BASE = ("event_id", "identificador_boe", "fecha_publicacion")


def parse(df: DataFrame, column: str) -> DataFrame:
    """A row per publication event of the JSON documents; a document that isn't one is an error."""
    document = F.from_json(column, EXTRACTION, {"mode": "FAILFAST"}).alias("d")
    events = df.select(document).select("d.boe_id", "d.publication_date", F.posexplode("d.publication_events").alias("at", "e"))
    index = F.col("at") + 1
    return events.select(positional(F.col("boe_id"), "event", index).alias("event_id"), F.col("boe_id").alias("identificador_boe"), F.col("publication_date").alias("fecha_publicacion"), index.alias("event_index"), "e")


def _elements(events: DataFrame, array: str, kind: str) -> DataFrame:
    """Base columns, the element's id, its place from 1 and the element as x."""
    rows = events.select(*BASE, F.posexplode(f"e.{array}").alias("at", "x"))
    return rows.select(*BASE, positional(F.col("event_id"), kind, F.col("at") + 1).alias("id"), (F.col("at") + 1).alias("place"), "x")


def _inner(rows: DataFrame, array: str, *carry: Column) -> DataFrame:
    """Base columns, id, further columns, and each value of an inner array with its place from 1."""
    exploded = rows.select(*BASE, "id", *carry, F.posexplode(f"x.{array}").alias("at", "v"))
    return exploded.withColumn("place", F.col("at") + 1).drop("at")


def _in_event(ref: Column) -> Column:
    return F.concat_ws("_", F.col("event_id"), ref)


def _technical(rows: DataFrame, kind: str, ref: str) -> DataFrame:
    own = _inner(rows, "technical_mentions", F.col(f"x.{ref}").alias("owner_ref"))
    asset = F.col("id") if kind == "generation_asset" else F.lit(None).cast("string")
    component = F.col("id") if kind == "associated_component" else F.lit(None).cast("string")
    return own.select(*BASE, positional(F.col("id"), "technical", F.col("place")).alias("technical_mention_id"), F.lit(kind).alias("owner_kind"), "owner_ref", asset.alias("generation_asset_mention_id"), component.alias("associated_component_id"), "v.attribute_type", "v.value_raw", "v.evidence")


def flatten(events: DataFrame) -> dict[str, DataFrame]:
    """The thirteen tables of parsed events; one lazy plan each over the same rows."""
    assets, components = _elements(events, "generation_assets", "generation_asset"), _elements(events, "associated_components", "component")
    actions, relations = _elements(events, "administrative_actions", "action"), _elements(events, "generation_relations", "relation")
    people, places, files = (_elements(events, a, k) for a, k in (("participants", "participant"), ("administrative_locations", "location"), ("case_file_references", "case_file")))
    asset_id, component_id, action_id = (F.col("id").alias(n) for n in ("generation_asset_mention_id", "associated_component_id", "administrative_action_id"))
    size = lambda a: F.coalesce(F.size(f"e.{a}"), F.lit(0)).alias(f"n_{a}")
    names = lambda rows, key: _inner(rows, "names_raw").select(*BASE, key, F.col("place").alias("name_index"), F.col("v").alias("name_raw"))
    kind = F.when(F.col("v") == "event", "event").when(F.col("v").startswith("generation_asset_"), "generation_asset").otherwise("associated_component")
    return {
        "publication_events": events.select(*BASE, "event_index", "e.event_summary", size("generation_assets"), size("associated_components"), size("administrative_actions")),
        "generation_asset_mentions": assets.select(*BASE, asset_id, "x.local_generation_asset_ref", "x.generation_type", "x.evidence"),
        "generation_asset_names": names(assets, asset_id),
        "associated_components": components.select(*BASE, component_id, "x.local_component_ref", "x.component_type", "x.description_raw", "x.evidence"),
        "associated_component_names": names(components, component_id),
        "associated_component_generation_links": _inner(components, "related_generation_asset_refs").select(*BASE, component_id, F.col("place").alias("link_index"), F.col("v").alias("local_generation_asset_ref"), _in_event(F.col("v")).alias("generation_asset_mention_id")),
        "administrative_actions": actions.select(*BASE, action_id, F.col("place").alias("action_index"), "x.action_type", "x.decision", F.coalesce("x.is_modification", F.lit(False)).alias("is_modification"), "x.evidence"),
        "administrative_action_targets": _inner(actions, "targets").select(*BASE, action_id, F.col("place").alias("target_index"), F.col("v").alias("target_ref"), F.when(F.col("v") == "event", F.col("event_id")).otherwise(_in_event(F.col("v"))).alias("target_entity_id"), kind.alias("target_kind")),
        "participant_mentions": people.select(*BASE, F.col("id").alias("participant_mention_id"), "x.participant_name_raw", "x.participant_role", "x.evidence"),
        "location_mentions": places.select(*BASE, F.col("id").alias("location_mention_id"), "x.location_name_raw", "x.location_level", "x.province_hint_raw", "x.autonomous_community_hint_raw", "x.evidence"),
        "generation_asset_relations": relations.select(*BASE, F.col("id").alias("generation_asset_relation_id"), "x.source_generation_asset_ref", _in_event(F.col("x.source_generation_asset_ref")).alias("source_generation_asset_mention_id"), "x.target_generation_asset_ref", _in_event(F.col("x.target_generation_asset_ref")).alias("target_generation_asset_mention_id"), "x.relation_type", "x.evidence"),
        "technical_mentions": _technical(assets, "generation_asset", "local_generation_asset_ref").unionByName(_technical(components, "associated_component", "local_component_ref")),
        "case_file_references": files.select(*BASE, F.col("id").alias("case_file_reference_id"), F.col("place").alias("reference_index"), F.col("x").alias("case_file_reference_raw")),
    }


# The key of each table and what its columns refer to.
_KEYS = {
    "publication_events": ("event_id",), "generation_asset_mentions": ("generation_asset_mention_id",), "generation_asset_names": ("generation_asset_mention_id", "name_index"),
    "associated_components": ("associated_component_id",), "associated_component_names": ("associated_component_id", "name_index"),
    "associated_component_generation_links": ("associated_component_id", "link_index"), "administrative_actions": ("administrative_action_id",),
    "administrative_action_targets": ("administrative_action_id", "target_index"), "participant_mentions": ("participant_mention_id",), "location_mentions": ("location_mention_id",),
    "generation_asset_relations": ("generation_asset_relation_id",), "technical_mentions": ("technical_mention_id",), "case_file_references": ("case_file_reference_id",),
}
_PARENT = {"generation_asset_mention_id": "generation_asset_mentions", "associated_component_id": "associated_components", "administrative_action_id": "administrative_actions"}
_POLYMORPHIC = {
    "administrative_action_targets": ("target_kind", "target_entity_id", {"event": ("publication_events", "event_id"), "generation_asset": ("generation_asset_mentions", "generation_asset_mention_id"), "associated_component": ("associated_components", "associated_component_id")}),
    "generation_asset_relations": (None, None, {"source_generation_asset_mention_id": ("generation_asset_mentions", "generation_asset_mention_id"), "target_generation_asset_mention_id": ("generation_asset_mentions", "generation_asset_mention_id")}),
}


def specs(tables: dict[str, DataFrame]) -> list[TableSpec]:
    """Contracts of the flattened tables: keys, references to the event and to parents, polymorphic targets."""
    out = []
    for name, df in tables.items():
        references = [] if name == "publication_events" else [ForeignKey(("event_id",), "publication_events", ("event_id",))]
        for column, parent in _PARENT.items():
            if column in df.columns and parent != name:
                references.append(ForeignKey((column,), parent, (column,)))
        kind, target, branches = _POLYMORPHIC.get(name, (None, None, {}))
        references += [ForeignKey((target or value,), parent, (column,), kind, value if kind else None) for value, (parent, column) in branches.items()]
        required = (*_KEYS[name], *BASE)
        schema = T.StructType([T.StructField(f.name, f.dataType, f.name not in required) for f in df.schema])
        out.append(TableSpec(name, schema, _KEYS[name], tuple(references)))
    return out


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """The violations of all contracts, with a few samples each; empty if the tables are sound."""
    return violations(tables, specs(tables)).filter("n > 0")
