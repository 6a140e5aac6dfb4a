"""A training-data pipeline over ``documents``: five stages, each written and read again as the next one's input.

Every stage takes any documents: null, empty and very long texts, null and
repeated ids, repeated rows, empty tables and extra columns, whatever their
names, which all but the last stage return as they came. What each stage makes
of these cases is said at its function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbrera.llm import cotrain, decontaminate, packing, simhash, suffixes
from lumbrera.llm.common import Written, scratch_scope
from lumbrera.llm.queries import table

#: A table of document keys of at most so many rows is broadcast.
BROADCAST_ROWS = 400_000


def _carried(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns in ``apart`` and all others in one struct, so that names can't clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(*apart, F.struct(*others).alias("others"))


def _restored(df: DataFrame, like: DataFrame, *apart: str) -> DataFrame:
    return df.select(*[F.col(c) if c in apart else F.col(f"others.`{c}`") for c in like.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are judged by the rest; without labels of both kinds all stay; repeated rows share a verdict.
    """
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    carried = docs.select("text", "source", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others"))
    return _restored(cotrain.score(carried, model).filter("kept"), docs, "text")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a five-word shingle similarity of 0.8 or more, the one with the smallest doc_id of each group stays.

    Texts without words are copies of each other; of equal rows one stays; of different texts with one doc_id both stay,
    unless they are near copies (then the one with the lesser text hash does); rows with a null doc_id stay.
    """
    return simhash.keep_one_of_each(docs, BROADCAST_ROWS, width=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller doc_id has are cut; characters that are cut in part go whole.

    Null texts stay null; rows with equal doc_id don't affect each other, and a null doc_id counts as the largest.
    """
    cut = suffixes.remove_repeats(_carried(docs, "doc_id", "text"), 50, keep=("others",), as_text=True)
    back = _restored(cut.withColumnRenamed("kept", "text"), docs, "doc_id", "text")
    return back.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else back


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go.

    Texts without words stay; an item of fewer words, but one at least, is one window; rows are told apart by doc_id and text.
    """
    with scratch_scope("contaminated"):
        found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), 10)
        hit = Written(found.filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("r").alias("__hash")).distinct(), "contaminated").df
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    same = F.col("__hash").eqNullSafe(F.xxhash64(docs["text"])) & F.col("__id").eqNullSafe(docs["doc_id"])
    return docs.join(hit, same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids and places in the packed sequences.

    A null or empty text is one piece with the end id alone; repeated rows are packed as often as they occur.
    """
    return packing.pack(docs, keep=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Co-training, suffix sorting and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_scope(f"stage-{k}"):
            written = Written(stage(spark, docs, sf_dir), f"stage-{k}", "snappy")
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
