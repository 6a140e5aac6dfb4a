"""Stable ids as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The hexadecimal digits of the name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16)
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.lower(variant), F.substring(digest, 18, 15))


def text_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """The prefix and the first digits of the SHA-256 of the parts, joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def document_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def positional(parent: Column, kind: str, index: Column) -> Column:
    """``parent_kind_index``, counted from 1."""
    return F.concat_ws("_", parent, F.lit(kind), index.cast("string"))
