"""Predictions held against truth: entities matched in a cascade, then counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import matching as M
from ..operators import spans as S


def match_assets(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc, truth, predicted: forced pairs among assets of a document that share a name (``names`` arrays)."""
    named = lambda df, k: df.select("doc", F.col("id").alias(k), F.explode("names").alias("__raw")).select("doc", k, normalize(F.col("__raw")).alias("name")).filter("name <> ''")
    own = named(truth, "truth").join(named(predicted, "predicted"), ["doc", "name"]).select("doc", "truth", "predicted").distinct()
    return M.match_forced(own, "doc", "truth", "predicted").filter("status = 'forced'").drop("status")


def match_events(truth: DataFrame, predicted: DataFrame, assets: DataFrame) -> DataFrame:
    """doc, truth, predicted: forced pairs among events with the same non-empty set of matched assets (``assets`` arrays)."""
    known = truth.select("doc", F.col("id").alias("truth"), F.explode("assets").alias("asset"))
    mapped = predicted.select("doc", F.col("id").alias("predicted"), F.explode("assets").alias("p")).join(assets.select("doc", F.col("predicted").alias("p"), F.col("truth").alias("asset")), ["doc", "p"])
    in_truth = known.join(assets.select("doc", F.col("truth").alias("asset")), ["doc", "asset"], "left_semi")
    a = in_truth.groupBy("doc", "truth").agg(F.array_sort(F.collect_set("asset")).alias("s"))
    b = mapped.groupBy("doc", "predicted").agg(F.array_sort(F.collect_set("asset")).alias("s"))
    return M.match_forced(a.join(b, ["doc", "s"]).select("doc", "truth", "predicted"), "doc", "truth", "predicted").filter("status = 'forced'").drop("status")


def match_actions(truth: DataFrame, predicted: DataFrame, events: DataFrame) -> DataFrame:
    """doc, truth, predicted: forced pairs among actions of matched events with the same type whose evidence is in a passage."""
    known = truth.select("doc", F.col("id").alias("truth"), F.col("event").alias("truth_event"), "type", "fragments")
    told = predicted.select("doc", F.col("id").alias("predicted"), F.col("event").alias("predicted_event"), "type", "passages")
    within = events.select("doc", F.col("truth").alias("truth_event"), F.col("predicted").alias("predicted_event"))
    parent = F.concat_ws("/", "doc", "truth_event", "type")
    a = known.withColumn("parent", parent).select("parent", "truth", "fragments")
    b = told.join(within, ["doc", "predicted_event"]).withColumn("parent", parent).select("doc", "parent", "predicted", "passages")
    pairs = S.evidence_join(a, "parent", "fragments", b, "passages").select("doc", "truth", "predicted")
    return M.match_forced(pairs, "doc", "truth", "predicted").filter("status = 'forced'").drop("status")


def detection(matched: DataFrame, truth: DataFrame, predicted: DataFrame, entity: str) -> DataFrame:
    """entity, tp, fp, fn, precision, recall, f1; rates without a denominator are null."""
    counts = M.pair_counts(matched.withColumn("status", F.lit("forced")), truth, predicted)
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.select(F.lit(entity).alias("entity"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def evaluate(truth: dict[str, DataFrame], predicted: dict[str, DataFrame]) -> DataFrame:
    """A row of metrics per entity, each stage matched within the matches of the one before."""
    assets = match_assets(truth["assets"], predicted["assets"])
    events = match_events(truth["events"], predicted["events"], assets)
    actions = match_actions(truth["actions"], predicted["actions"], events)
    stages = (("assets", assets), ("events", events), ("actions", actions))
    rows = [detection(found, truth[name], predicted[name], name) for name, found in stages]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def warning_outcomes(df: DataFrame, expected: str, warned: str) -> DataFrame:
    """The four outcomes of a warning against what was expected, and the rate of false warnings."""
    e, w = F.col(expected), F.col(warned)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = df.agg(count(e & w).alias("true_warning"), count(~e & w).alias("false_warning"), count(e & ~w).alias("missed"), count(~e & ~w).alias("quiet"))
    base = F.col("false_warning") + F.col("quiet")
    return one.withColumn("false_warning_rate", F.when(base > 0, F.col("false_warning") / base))
