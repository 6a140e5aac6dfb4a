"""Hash-chained journals: one JSON line an entry, each with the digest of itself and of the entry before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(previous: Column, body: Column) -> Column:
    """SHA-256 of an entry: the digest before it (nothing at the start) and its body."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), body), 256)


def chained(entries: DataFrame, stream: Sequence[str], order: Sequence[str], body: str) -> DataFrame:
    """stream, seq (from 1), at (the first of ``order``), body, previous and own.

    A chain is sequential by nature: a stream's bodies are folded in one row, so streams are single journals of
    bounded length; any number of them goes in parallel.
    """
    held = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(body).alias("body"))))
    whole = entries.groupBy(*stream).agg(held.alias("held"))
    start = F.array().cast("array<string>")
    last = lambda hashes: F.get(hashes, F.size(hashes) - 1)
    hashes = F.aggregate("held", start, lambda done, e: F.concat(done, F.array(digest(last(done), e["body"]))))
    rows = whole.withColumn("hashes", hashes).select(*stream, "hashes", F.posexplode("held").alias("k", "e"))
    return rows.select(
        *stream, (F.col("k") + 1).alias("seq"), F.col("e.o0").alias("at"), F.col("e.body").alias("body"), F.get("hashes", F.col("k") - 1).alias("previous"), F.get("hashes", F.col("k")).alias("own")
    )


def problems(journal: DataFrame, stream: Sequence[str]) -> DataFrame:
    """Entries with what is wrong: their own digest, the link to the one before, the sequence, or time moving back."""
    before = Window.partitionBy(*stream).orderBy("seq")
    linked = journal.withColumn("__own", F.lag("own").over(before)).withColumn("__at", F.lag("at").over(before)).withColumn("__seq", F.coalesce(F.lag("seq").over(before), F.lit(0)))
    checks = {
        "digest": ~F.col("own").eqNullSafe(digest(F.col("previous"), F.col("body"))),
        "link": ~F.col("previous").eqNullSafe(F.col("__own")),
        "sequence": F.col("seq") != F.col("__seq") + 1,
        "time": F.coalesce(F.col("at") < F.col("__at"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return linked.withColumn("problems", found).filter(F.size("problems") > 0).drop("__own", "__at", "__seq")


def heads(journal: DataFrame, stream: Sequence[str]) -> DataFrame:
    """The durable head of each journal: its last seq and digest."""
    return journal.groupBy(*stream).agg(F.max("seq").alias("seq"), F.max_by("own", "seq").alias("own"))


def write(journal: DataFrame, path: str) -> None:
    """A JSON line an entry."""
    journal.write.json(path)


def read(spark, path: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
