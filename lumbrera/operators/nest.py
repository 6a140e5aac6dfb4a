"""Nested documents: flattening to tables, counting, deleting and numbering inside arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import positional


def flatten(df: DataFrame, parent: str, array: str, kind: str, fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """A row per element, with a positional id counted from 1 and its parent's id."""
    exploded = df.select(F.col(parent), *carry, F.posexplode(array).alias("__at", "__item"))
    return exploded.select(positional(F.col(parent), kind, F.col("__at") + 1).alias(f"{kind}_id"), parent, *carry, (F.col("__at") + 1).alias(f"{kind}_index"), *[F.col(f"__item.{f}").alias(f) for f in fields])


def count_nodes(outer: Column, inner: str) -> Column:
    """Elements of the arrays ``inner`` over all elements of ``outer``."""
    return F.aggregate(outer, F.lit(0), lambda a, e: a + F.coalesce(F.size(e[inner]), F.lit(0)))


def delete_nested(df: DataFrame, key: str, array: str, id_field: str, targets: DataFrame) -> DataFrame:
    """df without the array elements named by targets (key, id); ``emptied`` tells if none is left of some."""
    gone = targets.groupBy(key).agg(F.collect_set("id").alias("__gone"))
    joined = df.join(gone, key, "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<string>")))
    kept = F.filter(F.col(array), lambda e: ~F.array_contains(F.col("__gone"), e[id_field].cast("string")))
    return joined.withColumn("__kept", kept).withColumn("emptied", (F.size("__kept") == 0) & (F.size(array) > 0)).drop(array, "__gone").withColumnRenamed("__kept", array)


def issues(**checks: Column) -> Column:
    """Names of the failed checks, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
