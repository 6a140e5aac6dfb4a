"""Candidates met with their local documents, one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import document_stem
from ..operators.joins import CardinalityError, checked_join


def with_documents(candidates: DataFrame, documents: DataFrame, policy: str, pattern: str) -> DataFrame:
    """Candidates (id, day, stem, policy) with text, sha256 and text_length of their files (file, id, day, text, sha256).

    A file is named by its candidate's stem. A stem that isn't the candidate's, another policy, a missing or doubled
    file, and a document that says another id or day are errors.
    """
    wrong = candidates.filter((F.col("stem") != document_stem(F.col("id"), F.col("day"), pattern)) | ~F.col("policy").eqNullSafe(F.lit(policy)))
    if (bad := wrong.first()) is not None:
        raise CardinalityError(f"{bad['id']} has another stem or policy")
    named = documents.select(
        F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("id").alias("__id"), F.col("day").alias("__day"), "text", "sha256", F.length("text").alias("text_length")
    )
    met = checked_join(candidates, named, ["stem"], how="left", validate="1:1")
    told = F.col("id").eqNullSafe(F.col("__id")) & F.col("day").eqNullSafe(F.col("__day"))
    if (bad := met.filter(~told).first()) is not None:
        raise CardinalityError(f"{bad['id']} has no file, or one of another document")
    return met.drop("__id", "__day")
