"""Truth tables for evaluation: what an action affects, what is incomplete, and predictions by positional keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import orphans


def affected_assets(actions: DataFrame, targets: DataFrame, assets: DataFrame, components: DataFrame) -> DataFrame:
    """doc, event, action, affected (sorted) and complete: the assets that each action's targets stand for.

    actions (doc, event, action, scored), targets (doc, action, kind, target, scored), assets (doc, event, asset, scored),
    components (doc, component, related, scored). An event stands for all of its assets, a component for those it
    relates to, an asset for itself. If a target, or anything it leads to, is missing or not scored, the action is
    incomplete and affects nothing; an action that isn't scored affects nothing and is complete.
    """
    asked = targets.join(actions.filter("scored").select("doc", "event", "action"), ["doc", "action"]).withColumnRenamed("scored", "told")
    owned = assets.groupBy("doc", "event", "asset").agg((F.min("scored") & (F.count(F.lit(1)) == 1)).alias("sound"))
    parts = components.groupBy(F.col("doc"), F.col("component").alias("target")).agg(F.first("related").alias("related"), (F.min("scored") & (F.count(F.lit(1)) == 1)).alias("part_sound"))
    direct = asked.filter("kind = 'generation_asset'").withColumn("asset", F.col("target"))
    related = asked.filter("kind = 'associated_component'").join(parts, ["doc", "target"], "left")
    related = related.withColumn("told", F.col("told") & F.coalesce("part_sound", F.lit(False))).withColumn("asset", F.explode_outer("related"))
    columns = ["doc", "event", "action", "told", "asset"]
    named = direct.select(columns).unionByName(related.select(columns)).join(owned, ["doc", "event", "asset"], "left")
    whole = asked.filter("kind = 'event'").withColumn("told", F.col("told") & (F.col("target") == F.col("event"))).join(owned, ["doc", "event"], "left")
    other = asked.filter("kind NOT IN ('generation_asset', 'associated_component', 'event')").withColumn("asset", F.lit(None).cast("string")).withColumn("sound", F.lit(False))
    columns.append("sound")
    every = named.select(columns).unionByName(whole.select(columns)).unionByName(other.select(columns))
    sums = every.groupBy("doc", "event", "action").agg(F.min(F.col("told") & F.coalesce("sound", F.lit(False))).alias("ok"), F.array_sort(F.collect_set("asset")).alias("held"))
    joined = actions.select("doc", "event", "action", "scored").join(sums, ["doc", "event", "action"], "left")
    ok, none = F.coalesce("ok", F.lit(False)), F.array().cast("array<string>")
    return joined.select("doc", "event", "action", F.when(F.col("scored") & ok, F.col("held")).otherwise(none).alias("affected"), F.when(F.col("scored"), ok).otherwise(F.lit(True)).alias("complete"))


def truth_problems(documents: DataFrame, events: DataFrame, assets: DataFrame, actions: DataFrame, evidence: DataFrame) -> DataFrame:
    """doc, key and problem of what keeps a truth from being frozen.

    documents (doc, status, specific), events (doc, event), assets (doc, event, asset), actions (doc, event, action) and
    evidence (doc, owner): the scored rows. Children need their parents, a specific document an event and others none,
    an event an asset and an action, an action its own evidence.
    """
    none = F.lit(None).cast("string")

    def told(df: DataFrame, key, problem: str) -> DataFrame:  # noqa: ANN001
        return df.select(F.col("doc").cast("string").alias("doc"), key.cast("string").alias("key"), F.lit(problem).alias("problem"))

    has_events = events.select("doc").distinct()
    found = [
        told(documents.filter("status <> 'complete'"), none, "draft document"),
        told(orphans(events, ["doc"], documents, ["doc"]), F.col("event"), "unknown document"),
        told(orphans(assets, ["doc", "event"], events, ["doc", "event"]), F.col("asset"), "unknown event"),
        told(orphans(actions, ["doc", "event"], events, ["doc", "event"]), F.col("action"), "unknown event"),
        told(documents.filter("specific").join(has_events, "doc", "left_anti"), none, "no event"),
        told(documents.filter("NOT specific").join(has_events, "doc", "left_semi"), none, "unexpected event"),
        told(events.join(assets.select("doc", "event"), ["doc", "event"], "left_anti"), F.col("event"), "no asset"),
        told(events.join(actions.select("doc", "event"), ["doc", "event"], "left_anti"), F.col("event"), "no action"),
        told(actions.join(evidence.select("doc", F.col("owner").alias("action")), ["doc", "action"], "left_anti"), F.col("action"), "no evidence"),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def predictions(parsed: DataFrame) -> DataFrame:
    """table, key, event_key and value (JSON) of every predicted entity of parsed events (identificador_boe, event_index, e).

    Keys are positional, ``<doc>|pred_event_<i>`` and below it a local reference or ``action_<k>``; they are never made
    of attributes, and missing values stay missing.
    """
    events = parsed.select("e", F.concat("identificador_boe", F.lit("|pred_event_"), F.col("event_index").cast("string")).alias("event_key"))
    fields = events.schema["e"].dataType.fieldNames()

    def table(name: str, field: str, local) -> DataFrame:  # noqa: ANN001
        rows = events.select("event_key", F.posexplode(f"e.{field}").alias("k", "x"))
        return rows.select(F.lit(name).alias("table"), F.concat_ws(":", "event_key", local).alias("key"), "event_key", F.to_json("x").alias("value"))

    numbered = lambda kind: F.concat(F.lit(f"{kind}_"), (F.col("k") + 1).cast("string"))
    parts = [events.select(F.lit("events").alias("table"), F.col("event_key").alias("key"), "event_key", F.to_json("e").alias("value"))]
    for name, field, local in (
        ("generation_assets", "generation_assets", F.col("x.local_generation_asset_ref") if "generation_assets" in fields else None),
        ("associated_components", "associated_components", F.col("x.local_component_ref") if "associated_components" in fields else None),
        ("administrative_actions", "administrative_actions", numbered("action")),
        ("locations", "administrative_locations", numbered("location")),
    ):
        if field in fields:
            parts.append(table(name, field, local))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeated_predictions(rows: DataFrame) -> DataFrame:
    """Keys that a prediction has twice."""
    return rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
