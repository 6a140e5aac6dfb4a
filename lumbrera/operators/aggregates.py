"""Aggregates over names and values, profiles and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, normalize


def display_name(name: Column) -> Column:
    """Best of the names: most words, longest, then first by normalised and raw form."""
    tidy = clean(name)
    usable = F.when(tidy != "", tidy)
    return F.min_by(usable, F.when(usable.isNotNull(), F.struct(-F.size(F.split(usable, " ")), -F.length(usable), normalize(usable), usable)))


def joined_values(value: Column, separator: str = " | ") -> Column:
    """Distinct non-blank values by normalised then raw form, joined; null if there are none."""
    tidy = F.trim(value)
    pairs = F.array_sort(F.collect_set(F.when(tidy != "", F.struct(normalize(tidy).alias("n"), tidy.alias("v")))))
    return F.nullif(F.array_join(F.transform(pairs, lambda p: p["v"]), separator), F.lit(""))


def short_list(values: Column, limit: int = 3, more: str = " y {} más") -> Column:
    """The first ``limit`` values of a sorted array joined by commas, and how many more there are."""
    head, tail = more.split("{}")
    listed = F.array_join(F.slice(values, 1, limit), ", ")
    rest = F.size(values) - limit
    return F.when(rest > 0, F.concat(listed, F.lit(head), rest.cast("string"), F.lit(tail))).otherwise(listed)


def first_filled(*sets: Column) -> Column:
    """The first of the arrays that isn't empty."""
    return F.coalesce(*[F.when(F.size(s) > 0, s) for s in sets])


def ordered_unique(value: Column, *order: Column) -> Column:
    """Distinct values in the order of their first place."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.array_distinct(F.transform(rows, lambda r: r["v"]))


def holds_all(observed: Column, required: Sequence[str]) -> Column:
    return F.size(F.array_intersect(observed, F.array(*[F.lit(r) for r in required]))) == len(set(required))


def name_identity(name: Column) -> Column:
    """The one name, or ``aliases:[a||b]`` of the sorted distinct ones; null without any."""
    names = F.array_sort(F.collect_set(F.nullif(F.trim(name), F.lit(""))))
    return F.when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.size(names) > 1, F.concat(F.lit("aliases:["), F.array_join(names, "||"), F.lit("]")))


def column_profile(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """column_name, data_type, n_rows, n_nulls, n_distinct and role, in one pass over the table."""
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for c in df.columns:
        sums += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__nulls"), F.count_distinct(c).alias(f"{c}__distinct")]
    one = df.agg(*sums)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col("n_rows"), F.col(f"{c}__nulls").alias("n_nulls"), F.col(f"{c}__distinct").alias("n_distinct"), F.lit("key" if c in key else "value").alias("role")) for c, t in df.dtypes]
    return one.select(F.inline(F.array(*rows)))


def table_quality(df: DataFrame, name: str, key: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    """One row: rows, columns, rows of repeated keys (all of them), nulls, and the range of each date."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{k}") for c in dates for k, f in (("min", F.min), ("max", F.max))], F.sum(sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))).alias("nulls"))
    ranges = [f(f"{c}_{k}").alias(f"{c}_{k}") for c in dates for k, f in (("min", F.min), ("max", F.max))]
    return groups.agg(F.lit(name).alias("table_name"), F.sum("n").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_repeated_key_rows"), F.sum("nulls").alias("n_nulls"), *ranges)


def micro_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; a rate without a denominator is null, f1 is 0 if both rates are."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one = df.agg(count(truth & predicted).alias("tp"), count(~truth & predicted).alias("fp"), count(truth & ~predicted).alias("fn"))
    rate = lambda a, b: F.when(b > 0, a / b)
    p, r = F.col("precision"), F.col("recall")
    one = one.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return one.withColumn("f1", F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def confusion(df: DataFrame, expected: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """A row per expected class, a column per predicted class and for missing ones, zeros filled."""
    wide = df.withColumn("__p", F.coalesce(F.col(predicted), F.lit("missing"))).groupBy(expected).pivot("__p", [*classes, "missing"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def match_method(names: DataFrame, group: str, member: str, name: str) -> DataFrame:
    """Per group: singleton, shared_name if a name is in every member, else variant."""
    members = names.groupBy(group).agg(F.count_distinct(member).alias("members"))
    common = names.groupBy(group, name).agg(F.count_distinct(member).alias("holders")).groupBy(group).agg(F.max("holders").alias("widest"))
    both = members.join(common, group)
    return both.select(group, "members", F.when(F.col("members") == 1, "singleton").when(F.col("widest") == F.col("members"), "shared_name").otherwise("variant").alias("method"))
