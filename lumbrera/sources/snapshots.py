"""Snapshots: tables published together with a manifest, and checked when read again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import TableSpec, violations
from ..operators.sets import semantic_hash


class SnapshotError(ValueError):
    """A snapshot isn't what its manifest says."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def publish(tables: dict[str, DataFrame], path: str) -> dict:
    """Write all tables and the manifest beside the target, then rename: readers see all or nothing. An existing target is an error."""
    spark = next(iter(tables.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise SnapshotError(f"{path} exists")
    _, staging = _fs(spark, f"{path}.staging")
    fs.delete(staging, True)
    manifest = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}.staging/{name}")
        row = semantic_hash(spark.read.parquet(f"{path}.staging/{name}")).first()
        manifest[name] = {"n_rows": row["n_rows"], "bag_hash": str(row["bag_hash"]), "columns": df.columns}
    out = fs.create(_fs(spark, f"{path}.staging/manifest.json")[1])
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if not fs.rename(staging, target):
        raise SnapshotError(f"{path} can't be published")
    return manifest


def read(spark: SparkSession, path: str, specs: list[TableSpec] | None = None) -> dict[str, DataFrame]:
    """The tables, after a check of rows, columns and hashes, and of the contracts if given."""
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect()))
    tables = {}
    for name, said in manifest.items():
        df = spark.read.parquet(f"{path}/{name}")
        row = semantic_hash(df).first()
        if df.columns != said["columns"] or row["n_rows"] != said["n_rows"] or str(row["bag_hash"]) != said["bag_hash"]:
            raise SnapshotError(f"{name} in {path} isn't what the manifest says")
        tables[name] = df
    if specs and not (found := violations(tables, specs).filter("n > 0")).isEmpty():
        raise SnapshotError(f"{path} breaks its contract: {found.first().asDict()}")
    return tables


def differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of one table only, as often as they are more there, with the side that has them."""
    same = recomputed.select(*stored.columns)
    return stored.exceptAll(same).withColumn("side", F.lit("stored")).unionByName(same.exceptAll(stored).withColumn("side", F.lit("recomputed")))


def read_recomputed(spark: SparkSession, path: str, derived: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], specs: list[TableSpec] | None = None) -> dict[str, DataFrame]:
    """The tables of a checked snapshot, after computing each derived one again from the others and comparing."""
    tables = read(spark, path, specs)
    for name, compute in derived.items():
        again = compute(tables)
        if sorted(again.columns) != sorted(tables[name].columns) or not differences(tables[name], again).isEmpty():
            raise SnapshotError(f"{name} in {path} isn't what its sources give")
    return tables
