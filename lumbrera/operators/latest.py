"""One row per key: latest, best, first; order and adjacency within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], nulls_first: bool = True) -> DataFrame:
    """The last row of each key in a total order; nulls count as earliest (or latest).

    A max over structs, so rows are combined before the shuffle and a key with
    very many rows costs no more than its share of each task.
    """
    others = [c for c in df.columns if c not in (*keys, *order)]
    flags = [F.col(c).isNotNull() if nulls_first else F.col(c).isNull() for c in order]
    rank = F.struct(*[x.alias(f"o{i}") for i, pair in enumerate(zip(flags, (F.col(c) for c in order), strict=True)) for x in (F.struct(*pair),)])
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *others), rank).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}").alias(c) for c in (*order, *others)]).select(*df.columns)


def with_ties(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Keys whose latest ``at`` occurs more than once."""
    counts = df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"))
    return latest_per_key(counts, keys, [at]).filter("n > 1")


def best_by_precedence(df: DataFrame, keys: Sequence[str], kind: str, precedence: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row of the first kind there is, the latest of that kind; kinds not listed never count."""
    rank = F.lit(None).cast("int")
    for i, value in enumerate(precedence):
        rank = F.when(F.col(kind) == value, F.lit(len(precedence) - i)).otherwise(rank)
    ranked = df.withColumn("__rank", rank).filter("__rank is not null")
    return latest_per_key(ranked, keys, ["__rank", *order]).drop("__rank")


def broken_sequences(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Keys whose index isn't exactly 1 to n."""
    c = F.col(index)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.count_distinct(c).alias("different"))
    return sums.filter("not (low = 1 and high = n and different = n)")


def timeline(df: DataFrame, keys: Sequence[str], header: Sequence[str], items: Sequence[Column]) -> DataFrame:
    """Per key and header one row with its items in order."""
    return df.groupBy(*keys, *header).agg(F.array_sort(F.collect_list(F.struct(*items))).alias("items"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, quota: int, seed: str) -> DataFrame:
    """The ``quota`` rows of each stratum with the least SHA-256 of seed and key."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    within = Window.partitionBy(*strata).orderBy("sample_hash", key)
    return df.withColumn("sample_hash", digest).withColumn("sample_rank", F.row_number().over(within)).filter(F.col("sample_rank") <= quota)


def round_robin(df: DataFrame, strata: Sequence[str], key: str, n: int) -> DataFrame:
    """First of every stratum, then every second, and so on: the first n rows."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(key))
    # No stratum gives more than n rows, which each task can tell before the shuffle.
    return df.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def hash_batches(df: DataFrame, key: str, size: int, seed: str, slots: int | None = None, slot_rows: int = 100_000) -> DataFrame:
    """Batches of ``size`` rows in the order of the hash of seed and key.

    Ranked within slots of the hash's range, of about ``slot_rows`` rows each;
    the slots' sizes are summed apart, so no task orders the whole table.
    """
    slots = slots or max(1, min(1 << 20, -(-df.count() // slot_rows)))
    hashed = df.withColumn("batch_hash", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256))
    hashed = hashed.withColumn("__slot", F.shiftright(F.conv(F.substring("batch_hash", 1, 8), 16, 10).cast("long") * slots, 32).cast("int"))
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy("__slot").agg(F.count(F.lit(1)).alias("n")).select("__slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__slot").orderBy("batch_hash", key)) + F.col("__before")
    return hashed.join(F.broadcast(offsets), "__slot").withColumn("batch", (F.floor((rank - 1) / size) + 1).cast("int")).drop("__slot", "__before")


def broken_chain(journal: DataFrame, stream: Sequence[str], seq: str, previous: str, own: str) -> DataFrame:
    """Rows whose ``previous`` isn't the ``own`` hash of the row before."""
    before = F.lag(own).over(Window.partitionBy(*stream).orderBy(seq))
    return journal.withColumn("expected", before).filter(~F.col(previous).eqNullSafe(F.col("expected")))


def group_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Each row with its group's sum: sums are joined back, so hot groups needn't meet in one task."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias(name))
    return df.join(sums, list(keys))
