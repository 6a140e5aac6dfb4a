"""From normalised mentions to projects: events, catalogue, and the places of each project."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..operators import aggregates as A
from ..operators import joins as J

PLACES = uuid.uuid5(uuid.NAMESPACE_URL, "lumbrera:project-place:v1")


def asset_projects(assets: DataFrame, grouping: DataFrame) -> DataFrame:
    """asset_id, event_id, technology, project_id: every asset has exactly one project, and no other has."""
    return J.checked_join(assets.select("asset_id", "event_id", "technology"), grouping.select("asset_id", "project_id"), ["asset_id"], validate="1:1", same_keys=True)


def attributions(targets: DataFrame, links: DataFrame, owned: DataFrame) -> DataFrame:
    """action_id, project_id.

    A target that is the event stands for all of the event's projects, an asset
    for its own, a component for the projects of the assets it is linked to.
    """
    by_event = owned.select("event_id", "project_id").distinct()
    of_asset = owned.select("event_id", F.col("asset_id").alias("target_id"), "project_id")
    of_component = links.select("event_id", F.col("component_id").alias("target_id"), "asset_id").join(owned.select("asset_id", "project_id"), "asset_id").drop("asset_id")
    kind = lambda k: targets.filter(F.col("target_kind") == k)
    parts = [
        kind("event").filter("target_id = event_id").join(by_event, "event_id"),
        kind("generation_asset").join(of_asset, ["event_id", "target_id"]),
        kind("associated_component").join(of_component, ["event_id", "target_id"]),
    ]
    out = parts[0].select("action_id", "project_id")
    for part in parts[1:]:
        out = out.unionByName(part.select("action_id", "project_id"))
    return out.distinct()


def project_events(events: DataFrame, actions: DataFrame, targets: DataFrame, links: DataFrame, owned: DataFrame) -> DataFrame:
    """A row per project and action."""
    facts = J.checked_join(attributions(targets, links, owned), actions.select("action_id", "event_id", "action_index", "action_type", "decision"), ["action_id"], validate="m:1")
    dated = J.checked_join(facts, events.select("event_id", "publication_id", "publication_date", "event_index"), ["event_id"], validate="m:1")
    return dated.select("project_id", "event_id", "action_id", "publication_id", "publication_date", "event_index", "action_index", "action_type", "decision")


def projects(events: DataFrame, names: DataFrame, places: DataFrame, owned: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per project: best name, technology, places, first and last date, publications and actions. Two technologies are an error."""
    mixed = owned.groupBy("project_id").agg(F.count_distinct("technology").alias("n")).filter("n <> 1")
    if not mixed.isEmpty():
        raise ValueError(f"projects of several technologies: {[r['project_id'] for r in mixed.limit(5).collect()]}")
    base = owned.groupBy("project_id").agg(F.first("technology").alias("technology"))
    named = names.join(owned.select("asset_id", "project_id"), "asset_id").groupBy("project_id").agg(A.display_name(F.col("name")).alias("project_name"))
    in_event = owned.select("event_id", "project_id").distinct()
    dated = in_event.join(events, "event_id").groupBy("project_id").agg(F.min("publication_date").alias("first_publication_date"), F.max("publication_date").alias("last_publication_date"), F.count_distinct("publication_id").alias("n_publications"))
    counts = facts.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_administrative_actions"))
    where = lambda level, c: F.when(F.col(f"{level}_status") == "resolved", F.col(c))
    located = in_event.join(places, "event_id").groupBy("project_id").agg(
        A.joined_values(where("province", "province_code")).alias("province_codes"), A.joined_values(where("province", "province")).alias("provinces"),
        A.joined_values(where("municipality", "municipality_code")).alias("municipality_codes"), A.joined_values(where("municipality", "municipality")).alias("municipalities"),
    )
    whole = base.join(named, "project_id", "left").join(dated, "project_id").join(located, "project_id", "left")
    return J.left_fill(whole, counts, ["project_id"], {"n_administrative_actions": 0})


def project_places(events: DataFrame, places: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project places, their sources): each resolved mention counts at its most specific level, for every project of its event."""
    status = lambda level: F.col(f"{level}_status") == "resolved"
    level = F.when(status("municipality"), "municipality").when(status("province"), "province").when(status("community"), "autonomous_community")
    code = F.when(F.col("level") == "municipality", F.col("municipality_code")).when(F.col("level") == "province", F.col("province_code")).otherwise(F.col("community_code"))
    rows = places.withColumn("level", level).filter("level is not null").withColumn("code", code).join(owned.select("event_id", "project_id").distinct(), "event_id")
    key = F.concat(F.lit("v1|project:"), F.col("project_id"), F.lit("|level:"), F.col("level"), F.lit("|territory:"), F.col("code"))
    rows = rows.withColumn("project_place_id", F.concat(F.lit("place_"), uuid5(PLACES, key))).join(events.select("event_id", "publication_id", "publication_date"), "event_id")
    sums = rows.groupBy("project_place_id", "project_id", "level", "code").agg(
        F.count_distinct("mention_id").alias("n_mentions"), F.count_distinct("publication_id").alias("n_publications"),
        F.min("publication_date").alias("first_publication_date"), F.max("publication_date").alias("last_publication_date"),
    )
    return sums, rows.select("project_place_id", "mention_id", "event_id", "publication_id", "publication_date").distinct()
