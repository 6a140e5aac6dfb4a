"""Joins with checks, and joins that aren't plain equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize


class CardinalityError(ValueError):
    """A join's input breaks the cardinality that it declares."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "m:m", same_keys: bool = False) -> DataFrame:
    """Equality join; ``validate`` (1:1, 1:m, m:1, m:m) and ``same_keys`` are checked by their own jobs first."""
    left_side, right_side = validate.split(":")
    for side, df, name in ((left_side, left, "left"), (right_side, right, "right")):
        if side == "1" and not duplicate_keys(df, keys).isEmpty():
            raise CardinalityError(f"the {name} side repeats a key of {list(keys)}")
    if same_keys:
        for a, b, name in ((left, right, "right"), (right, left, "left")):
            if not a.join(b, list(keys), "left_anti").isEmpty():
                raise CardinalityError(f"a key of {list(keys)} is missing on the {name} side")
    return left.join(right, list(keys), how)


def left_fill(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Left join with values for what isn't matched."""
    joined = left.join(right, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def with_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "matched") -> DataFrame:
    """Left join with a column that tells whether there was a match."""
    return left.join(right.withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def polymorphic_join(facts: DataFrame, kind: str, branches: dict[str, tuple[DataFrame, Column]], columns: Sequence[str]) -> DataFrame:
    """Facts split by the value of ``kind``, each joined to its own table by its own condition; distinct union of ``columns``."""
    parts = [facts.filter(F.col(kind) == value).join(side, on).select(*columns) for value, (side, on) in branches.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates()


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``first`` and the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def names_join(asked: DataFrame, name: str, known: DataFrame, names: str) -> DataFrame:
    """Rows of ``known`` whose array ``names`` holds the normalised ``name``: an equality join on the exploded names."""
    lookup = known.withColumn("__name", F.explode(F.array_distinct(F.transform(F.col(names), normalize))))
    return asked.withColumn("__name", normalize(F.col(name))).join(lookup, "__name").drop("__name")


def token_set_key(text: Column, stop: Sequence[str]) -> Column:
    """Equal for texts with the same words but for stop words; null if none is left."""
    words = F.array_sort(F.array_except(F.array_distinct(F.split(normalize(text), " ")), F.array(*[F.lit(w) for w in ("", *stop)])))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def alias_overlap(left: DataFrame, left_key: str, left_names: str, right: DataFrame, right_key: str, right_names: str) -> DataFrame:
    """Pairs of keys whose name arrays share a normalised name."""
    a = left.select(left_key, F.explode(left_names).alias("__n")).select(left_key, normalize(F.col("__n")).alias("__n"))
    b = right.select(right_key, F.explode(right_names).alias("__n")).select(right_key, normalize(F.col("__n")).alias("__n"))
    return a.filter("__n <> ''").join(b, "__n").select(left_key, right_key).distinct()


def set_equality(left: DataFrame, left_key: str, right: DataFrame, right_key: str, item: str) -> DataFrame:
    """Pairs of keys with the same non-empty set of items: joined on the sorted sets."""
    a = left.groupBy(left_key).agg(F.array_sort(F.collect_set(item)).alias("__s"))
    b = right.groupBy(right_key).agg(F.array_sort(F.collect_set(item)).alias("__s"))
    return a.filter(F.size("__s") > 0).join(b, "__s").select(left_key, right_key)


def ordered_subset(df: DataFrame, code: str, codes: Sequence[str]) -> DataFrame:
    """Rows of the codes with their place in the list; a code without a row has one of nulls (found is false)."""
    wanted = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(codes)], "position int, " + f"`{code}` {df.schema[code].dataType.simpleString()}")
    return F.broadcast(wanted).join(df.withColumn("found", F.lit(True)), code, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def two_registries(facts: DataFrame, first: DataFrame, first_keys: Sequence[str], second: DataFrame, second_keys: Sequence[str]) -> DataFrame:
    """Facts with ``registry``: first, second, none, or contradiction if both know the row."""
    a = facts.join(first.select(*first_keys).distinct().withColumn("__1", F.lit(True)), list(first_keys), "left")
    b = a.join(second.select(*second_keys).distinct().withColumn("__2", F.lit(True)), list(second_keys), "left")
    kind = F.when(F.col("__1") & F.col("__2"), "contradiction").when(F.col("__1"), "first").when(F.col("__2"), "second").otherwise("none")
    return b.withColumn("registry", kind).drop("__1", "__2")


def one_registry(facts: DataFrame, first: DataFrame, first_keys: Sequence[str], second: DataFrame, second_keys: Sequence[str]) -> DataFrame:
    """As ``two_registries``; a fact that both registries know is an error."""
    rows = two_registries(facts, first, first_keys, second, second_keys)
    if (bad := rows.filter("registry = 'contradiction'").first()) is not None:
        raise CardinalityError(f"both registries know {bad.asDict()}")
    return rows


def orphans(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """Child rows with complete keys that have no parent."""
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys, strict=True)]).distinct()
    return child.dropna(subset=list(child_keys)).join(known, list(child_keys), "left_anti")
