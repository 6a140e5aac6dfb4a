"""Connected components of a link table by alternating large-star and small-star steps.

Labels only ever move to smaller ids, every step is a join and an aggregation
over links, and each round is written to the shared folder; nothing is
collected but two numbers that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


#: Nodes with more links than this get their least partner by broadcast; there is at most one for every so many links.
HOT_LINKS = 1_000_000


def _star(links: DataFrame, name: str, hot_links: int) -> DataFrame:
    """Links (u, v) become (v, m) and (u, m), m being the least of u and its partners v."""
    least = Written(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), name).df
    hot = least.filter(F.col("n") > hot_links).select("u", "m")
    if not hot.limit(1).count():
        return links.join(least.select("u", "m"), "u")
    # The links of a hub stay where they are.
    cold = links.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return links.join(F.broadcast(hot), "u").union(cold)


def connected_components(links: DataFrame, hot_links: int = HOT_LINKS) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b); pairs may repeat or be equal."""
    both = F.when(F.col("a") > F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    now = Written(links.filter("a <> b").select(both.alias("p")).select("p.*").distinct(), "links")
    state = _state(now.df)
    while state[0]:
        e = now.df
        every = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(every, "large-star", hot_links).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = Written(large, "links-large").df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        starred = _star(down, "small-star", hot_links)
        small = starred.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(starred.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        following = Written(small, "links-small")
        now.drop()
        now, before = following, state
        state = _state(now.df)
        if state == before:
            break
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
