"""An extension: the log of attempts as a stream, kept as one latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.latest import latest_per_key
from ..operators.sets import evolving_union


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def keep_latest(log: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], watermark: tuple[str, str] | None = None):  # noqa: ANN201
    """A query that upserts each batch's latest rows; every version is written whole, so a replayed batch changes nothing."""
    if watermark:
        log = log.withWatermark(*watermark).dropDuplicatesWithinWatermark([*keys, *order])

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{target}/v{batch_id - 1}"
        known = spark.read.parquet(before) if batch_id else None
        merged = latest_per_key(evolving_union(known, batch) if known is not None else batch, keys, order)
        merged.write.mode("overwrite").parquet(f"{target}/v{batch_id}")

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
