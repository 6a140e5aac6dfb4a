"""Declared table contracts: columns, keys, domains and references, checked into one table of violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import duplicate_keys, orphans


class ContractError(ValueError):
    """A table doesn't have the columns that its contract declares."""


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    kind: str | None = None  # a polymorphic reference holds for rows whose ``kind`` column has ``value``
    value: str | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    references: tuple[ForeignKey, ...] = ()
    domains: dict[str, tuple] = field(default_factory=dict)

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def cast(self, df: DataFrame) -> DataFrame:
        """The declared columns in their order and types; a missing one is an error."""
        if missing := [f.name for f in self.schema if f.name not in df.columns]:
            raise ContractError(f"{self.name} lacks {missing}")
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def check_schema(self, df: DataFrame) -> None:
        """Names, order and types, not nullability: files come back nullable."""
        got, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in self.schema]
        if got != want:
            raise ContractError(f"{self.name} has {got}, not {want}")

    def nulls(self) -> Sequence[str]:
        return [f.name for f in self.schema if not f.nullable]


def add_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns first, missing ones null, further ones kept at the end."""
    known = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*known, *[c for c in df.columns if c not in schema.names])


def _shown(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def _found(table: str, df: DataFrame, checks: dict[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """table_name, check_name and shown of every row that fails a check: one pass over the table for all of them."""
    failed = F.array(*[F.when(bad, F.struct(F.lit(name).alias("check_name"), _shown(columns).alias("shown"))) for name, (bad, columns) in checks.items()])
    return df.select(F.lit(table).alias("table_name"), F.explode(F.array_compact(failed)).alias("f")).select("table_name", "f.*")


def violations(tables: dict[str, DataFrame], specs: Sequence[TableSpec], samples: int = 5) -> DataFrame:
    """table_name, check_name, n, samples (the first few) of every check of the specs, passed ones with n = 0.

    Nulls and domains of a table are checked in one pass, keys and references in one each; all are counted together.
    """
    found, names = [], []
    for spec in specs:
        df, rows = tables[spec.name], {}
        for c in spec.nulls():
            rows[f"null:{c}"] = (F.col(c).isNull(), spec.key)
        for c, values in spec.domains.items():
            rows[f"domain:{c}"] = (F.col(c).isNotNull() & ~F.col(c).isin(list(values)), (c,))
        if rows:
            found.append(_found(spec.name, df, rows))
        whole = {f"key:{','.join(spec.key)}": (duplicate_keys(df, spec.key), spec.key)}
        for fk in spec.references:
            child = df if fk.kind is None else df.filter(F.col(fk.kind) == fk.value)
            name = f"reference:{','.join(fk.columns)}->{fk.parent}" + (f":{fk.value}" if fk.kind else "")
            whole[name] = (orphans(child, fk.columns, tables[fk.parent], fk.parent_columns), fk.columns)
        found += [bad.select(F.lit(spec.name).alias("table_name"), F.lit(name).alias("check_name"), _shown(columns).alias("shown")) for name, (bad, columns) in whole.items()]
        names += [(spec.name, name) for name in (*rows, *whole)]
    counts = reduce(DataFrame.unionByName, found).groupBy("table_name", "check_name", "shown").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("table_name", "check_name").orderBy("shown")
    ranked = counts.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= samples)
    tops = ranked.groupBy("table_name", "check_name").agg(F.array_join(F.array_sort(F.collect_list("shown")), ";").alias("samples"))
    sums = counts.groupBy("table_name", "check_name").agg(F.sum("n").alias("n"))
    checks = next(iter(tables.values())).sparkSession.createDataFrame(names, "table_name string, check_name string")
    every = checks.join(sums.join(tops, ["table_name", "check_name"]), ["table_name", "check_name"], "left")
    return every.select("table_name", "check_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.lit("")).alias("samples"))


def all_of(*checks: Column) -> Column:
    return reduce(Column.__and__, checks)
