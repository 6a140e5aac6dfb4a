"""Set operations over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.dropDuplicates()


def evolving_union(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks are null, in the order of first appearance."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def disjoint_union(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of tables without a common key; a common key is an error."""
    if not first.join(second, list(keys), "left_semi").isEmpty():
        raise ValueError(f"the tables share a key of {list(keys)}")
    return first.unionByName(second)


def append_log(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The log with new rows appended; of rows with one key the new one stays."""
    return evolving_union(log.join(new.select(key).distinct(), key, "left_anti"), new)


def key_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with ``change``: added, removed, changed or same; null-safe over all other columns."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*keys, F.struct(*values).alias("__new"), F.lit(True).alias("__in_new"))
    both = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def row_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows with their surplus on either side, counted; none if the tables are equal as bags of rows."""
    columns = first.columns
    signed = first.withColumn("__n", F.lit(1)).unionByName(second.select(*columns).withColumn("__n", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("__n").alias("surplus")).filter("surplus <> 0")


def frames_equal(first: DataFrame, second: DataFrame) -> bool:
    return sorted(first.columns) == sorted(second.columns) and row_differences(first, second).isEmpty()


def semantic_hash(df: DataFrame) -> DataFrame:
    """One row: n_rows and a hash of the bag of rows, whatever their order."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias("bag_hash"))


def reuse_or_append(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows with ``outcome``: reused if the same row is known, appended if the key is new, collision otherwise."""
    values = [c for c in known.columns if c != key]
    old = known.select(key, F.struct(*values).alias("__old"), F.lit(True).alias("__known"))
    joined = new.join(old, key, "left")
    outcome = F.when(F.col("__known").isNull(), "appended").when(F.col("__old").eqNullSafe(F.struct(*values)), "reused").otherwise("collision")
    return joined.withColumn("outcome", outcome).drop("__old", "__known")
