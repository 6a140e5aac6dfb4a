"""Resolution of place names against a hierarchy, and grouping of mentions into projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.text import normalize
from .aggregates import name_identity
from .joins import token_set_key


def _candidates(mentions: DataFrame, key: str, name: str, units: DataFrame, names: str, stop: Sequence[str]) -> DataFrame:
    """key, code, how: units by a name of theirs, or, where none has it, by the same set of words."""
    asked = mentions.select(key, normalize(F.col(name)).alias("__n"), token_set_key(F.col(name), stop).alias("__t")).filter("__n <> ''")
    known = units.select("code", F.explode(names).alias("__name"))
    exact = asked.join(known.select("code", normalize(F.col("__name")).alias("__n")).distinct(), "__n").select(key, "code", F.lit("name").alias("how"))
    rest = asked.join(exact.select(key).distinct(), key, "left_anti")
    loose = rest.join(known.select("code", token_set_key(F.col("__name"), stop).alias("__t")).distinct(), "__t").select(key, "code", F.lit("words").alias("how"))
    return exact.unionByName(loose).distinct()


def resolve_level(mentions: DataFrame, key: str, name: str, units: DataFrame, names: str = "names", stop: Sequence[str] = (), hint: str | None = None) -> DataFrame:
    """key, status (resolved, ambiguous, not_found, not_provided), code, how.

    ``units`` has code, parent and names. With several candidates, those whose
    parent is the mention's ``hint`` are taken, unless that leaves none.
    """
    found = _candidates(mentions, key, name, units, names, stop).join(units.select("code", "parent").distinct(), "code")
    if hint:
        found = found.join(mentions.select(key, F.col(hint).alias("__hint")), key)
        fits = F.coalesce(F.col("parent") == F.col("__hint"), F.lit(False))
    else:
        fits = F.lit(False)
    sums = found.groupBy(key).agg(F.count_distinct("code").alias("n"), F.min("code").alias("one"), F.count_distinct(F.when(fits, F.col("code"))).alias("n_fit"), F.min(F.when(fits, F.col("code"))).alias("fit"), F.min("how").alias("how"))
    one = F.when(F.col("n_fit") == 1, F.col("fit")).when((F.col("n_fit") == 0) & (F.col("n") == 1), F.col("one"))
    joined = mentions.select(key, normalize(F.col(name)).alias("__n")).join(sums, key, "left")
    status = F.when(F.col("__n") == "", "not_provided").when(F.col("n").isNull(), "not_found").when(one.isNotNull(), "resolved").otherwise("ambiguous")
    return joined.select(key, status.alias("status"), one.alias("code"), F.when(one.isNotNull(), F.col("how")).alias("how"))


def resolve_places(mentions: DataFrame, key: str, child: str, parent: str, children: DataFrame, parents: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """Two levels resolved apart and reconciled: the child's parent rules, and a hint that disagrees makes a conflict."""
    above = resolve_level(mentions, key, parent, parents, stop=stop).withColumnsRenamed({"status": "parent_status", "code": "parent_code", "how": "parent_how"})
    hinted = mentions.select(key, child).join(above.select(key, F.col("parent_code").alias("__hint")), key)
    below = resolve_level(hinted, key, child, children, stop=stop, hint="__hint").withColumnsRenamed({"status": "child_status", "code": "child_code", "how": "child_how"})
    up = children.select(F.col("code").alias("child_code"), F.col("parent").alias("implied")).distinct()
    both = above.join(below, key).join(up, "child_code", "left")
    conflict = F.col("implied").isNotNull() & F.col("parent_code").isNotNull() & (F.col("implied") != F.col("parent_code"))
    parent_code = F.coalesce("implied", "parent_code")
    status = F.when(conflict, "conflict").when((F.col("child_status") == "ambiguous") | (F.col("parent_status") == "ambiguous"), "ambiguous").when(parent_code.isNotNull(), "resolved").when((F.col("child_status") == "not_provided") & (F.col("parent_status") == "not_provided"), "not_provided").otherwise("not_found")
    level = F.when(F.col("child_code").isNotNull(), "child").when(parent_code.isNotNull(), "parent")
    return both.select(key, "child_code", parent_code.alias("parent_code"), "child_status", "parent_status", status.alias("status"), level.alias("level"))


def resolve_hierarchy(mentions: DataFrame, key: str, municipalities: DataFrame, provinces: DataFrame, communities: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """Three levels (columns municipality, province and community of the mentions), each unit with code, parent and names.

    Every level is resolved apart, with what the level above resolved to as a hint among several candidates; then the
    lowest resolved unit rules those above it. A stated level that resolved to another unit is a conflict.
    """
    above = resolve_places(mentions, key, "province", "community", provinces, communities, stop)
    above = above.select(key, F.col("child_code").alias("__province"), F.col("parent_code").alias("__community"), F.col("child_status").alias("province_status"), F.col("parent_status").alias("community_status"), F.col("status").alias("__status"))
    hinted = mentions.select(key, "municipality").join(above.select(key, F.col("__province").alias("__hint")), key)
    below = resolve_level(hinted, key, "municipality", municipalities, stop=stop, hint="__hint")
    below = below.select(key, F.col("code").alias("municipality_code"), F.col("status").alias("municipality_status"))
    of_province = provinces.select(F.col("code").alias("__own"), F.col("parent").alias("__own_community")).distinct()
    of_town = municipalities.select(F.col("code").alias("municipality_code"), F.col("parent").alias("__own")).distinct()
    both = above.join(below, key).join(of_town, "municipality_code", "left").join(of_province, "__own", "left")
    apart = lambda own, told: own.isNotNull() & told.isNotNull() & (own != told)
    conflict = (F.col("__status") == "conflict") | apart(F.col("__own"), F.col("__province")) | apart(F.col("__own_community"), F.col("__community"))
    province, community = F.coalesce("__own", "__province"), F.coalesce("__own_community", "__community")
    states = [F.col(f"{level}_status") for level in ("municipality", "province", "community")]
    anywhere = lambda value: F.array_contains(F.array(*states), value)
    status = (
        F.when(conflict, "conflict").when(anywhere("ambiguous"), "ambiguous").when(community.isNotNull() | province.isNotNull(), "resolved")
        .when(~anywhere("not_found"), "not_provided").otherwise("not_found")
    )
    level = F.when(F.col("municipality_code").isNotNull(), "municipality").when(province.isNotNull(), "province").when(community.isNotNull(), "autonomous_community")
    return both.select(
        key, "municipality_code", province.alias("province_code"), community.alias("community_code"), "municipality_status", "province_status", "community_status", status.alias("status"), level.alias("level")
    )


def geography_anchor(places: DataFrame, key: str) -> DataFrame:
    """Per key the sorted resolved child codes, else parent codes, else ``unresolved``."""
    codes = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "resolved", F.col(c)))), ",")
    sums = places.groupBy(key).agg(codes("child_code").alias("c"), codes("parent_code").alias("p"))
    return sums.select(key, F.when(F.col("c") != "", F.concat(F.lit("child:"), "c")).when(F.col("p") != "", F.concat(F.lit("parent:"), "p")).otherwise("unresolved").alias("anchor"))


def group_projects(mentions: DataFrame, member: str, name: str, technology: str, anchor: str, namespace) -> DataFrame:
    """member, match_key, project_id: equal name identity, technology and anchor; nothing transitive."""
    identity = mentions.groupBy(member, technology, anchor).agg(name_identity(normalize(F.col(name))).alias("identity"))
    key = F.concat_ws("|", F.lit("v1"), "identity", technology, anchor)
    return identity.filter(F.col("identity").isNotNull()).select(member, key.alias("match_key"), F.concat(F.lit("project_"), uuid5(namespace, key)).alias("project_id"))


def most_specific(rows: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Rows of the most specific level that a key has."""
    best = F.max(rank).over(Window.partitionBy(*keys))
    return rows.withColumn("__best", best).filter(F.col(rank) == F.col("__best")).drop("__best")
