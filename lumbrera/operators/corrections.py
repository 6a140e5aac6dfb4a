"""Corrections that name their target and say what it must be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CorrectionError(ValueError):
    """A correction has no target, several, or one that isn't what it says."""


def verified(corrections: DataFrame, targets: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """The corrections, after a check that each has exactly one target with the same facts (null-safe)."""
    known = targets.select(key, *[F.col(f).alias(f"__{f}") for f in facts], F.lit(1).alias("__hit"))
    same = None
    for f in facts:
        equal = F.col(f).eqNullSafe(F.col(f"__{f}"))
        same = equal if same is None else same & equal
    joined = corrections.join(known, key, "left").groupBy(key).agg(F.count("__hit").alias("n"), F.min(F.coalesce(same, F.lit(False)).cast("int")).alias("ok"))
    bad = joined.filter((F.col("n") != 1) | (F.col("ok") != 1)).limit(5).collect()
    if bad:
        raise CorrectionError(f"{[r[key] for r in bad]} don't match one target each")
    return corrections


def scope(df: DataFrame, key: str, *lists: DataFrame) -> tuple[DataFrame, int]:
    """The rows named by any of the lists, and how many names are in several; an unknown name is an error."""
    from functools import reduce

    names = reduce(DataFrame.unionByName, [x.select(key).distinct() for x in lists])
    wanted = names.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    unknown = wanted.join(df.select(key).distinct(), key, "left_anti").limit(5).collect()
    if unknown:
        raise CorrectionError(f"unknown: {[r[key] for r in unknown]}")
    return df.join(wanted.select(key), key, "left_semi"), wanted.filter("n > 1").count()


def one_row(df: DataFrame, key: str, value: object) -> dict:
    """The one row with this key."""
    rows = df.filter(F.col(key) == F.lit(value)).limit(2).collect()
    if len(rows) != 1:
        raise CorrectionError(f"{key} = {value!r} has {'no row' if not rows else 'several rows'}")
    return rows[0].asDict()
