"""Casts, codes, references and canonical forms as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean, documentary
from .titles import ACTIONS, has

# What modifies an act, and wording that tells of earlier acts.
MODIFIED = r"modificaci[oó]n|modificad[ao]|\bmodifica(?:n|da|do)?\b"
MODIFIABLE = (
    "autorizacion_administrativa_previa", "autorizacion_administrativa_construccion", "autorizacion_explotacion", "declaracion_utilidad_publica",
    "declaracion_impacto_ambiental", "informe_impacto_ambiental", "informe_determinacion_afeccion_ambiental",
)
PRIOR_MODIFIED_AND_CONSTRUCTION = (
    r"autorizaci[oó]n\s+administrativa\s+previa[^.;]{0,100}modificaci[oó]n(?:es)?[^.;]{0,100}\by\s+autorizaci[oó]n\s+administrativa\s+(?:de\s+)?construcci[oó]n"
)
HISTORICAL = (
    r"^(?:mediante|por)\s+(?:resoluci[oó]n|orden)|^con\s+fecha\s+\d|^en\s+fecha\s+\d|antecedentes?|previamente|con\s+anterioridad|"
    r"hab[ií]a\s+(?:sido|obtenido|solicitado|autorizado)"
)
DOCUMENT_ID = r"^BOE-[A-Z]-\d{4}-\d+$"


def clean_or_null(text: Column) -> Column:
    """Cleaned text; null if nothing is left."""
    return F.nullif(clean(text), F.lit(""))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def date_or_null(value: Column) -> Column:
    """The date that a text begins with; null if it isn't one."""
    return F.try_to_timestamp(value).cast("date")


def as_array(value: Column, kind: T.DataType) -> Column:
    """No value is an empty array, one value an array of it."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(value, F.array().cast(kind))
    return F.when(value.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(value))


def exact_code(code: Column, width: int) -> Column:
    """Whether the code has exactly ``width`` digits; false for null."""
    return F.coalesce(code.cast("string").rlike(rf"\A[0-9]{{{width}}}\z"), F.lit(False))


def document_url(document: Column, base: str, pattern: str = DOCUMENT_ID) -> Column:
    """``base`` and the id; an id of another form is an error."""
    bad = F.raise_error(F.concat(F.lit("not a document id: "), F.coalesce(document, F.lit("null"))))
    return F.when(document.rlike(pattern), F.concat(F.lit(base), document)).otherwise(bad.cast("string"))


def document_stem(document: Column, day: Column, pattern: str = DOCUMENT_ID) -> Column:
    """``YYYYMMDD_ID``; an id of another form is an error."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), document_url(document, "", pattern))


def distinct_folded(values: Column) -> Column:
    """Values in their order without those equal to an earlier one but for case and white space."""
    keys = F.transform(values, lambda v: F.lower(F.trim(F.regexp_replace(v, r"(?U)\s+", " "))))
    return F.filter(values, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def sorted_refs(refs: Column, first: str = "event", kinds: tuple[str, ...] = ("generation_asset",)) -> Column:
    """Distinct references ``kind_number``: ``first``, then the given kinds, then others, each by number."""

    def rank(r: Column) -> Column:
        kind = F.regexp_replace(r, r"_\d+$", "")
        place = F.lit(len(kinds) + 1)
        for i, k in enumerate(kinds):
            place = F.when(kind == k, F.lit(i + 1)).otherwise(place)
        number = F.regexp_extract(r, r"_(\d+)$", 1).try_cast("long")
        return F.struct(F.when(r == first, F.lit(0)).otherwise(place).alias("k"), F.coalesce(number, F.lit(0)).alias("n"), r.alias("r"))

    return F.transform(F.array_sort(F.transform(F.array_distinct(refs), rank)), lambda s: s["r"])


def _in_key_order(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_in_key_order(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _in_key_order(v, kind.elementType))
    return value


def canonical_json(value: Column, kind: T.StructType) -> Column:
    """JSON of a struct with sorted keys, no blanks, and nulls written."""
    return F.to_json(_in_key_order(value, kind), {"ignoreNullFields": "false"})


def _identity(text: str) -> str:
    letters = (c for c in unicodedata.normalize("NFKD", text).casefold() if unicodedata.category(c) != "Mn")
    return " ".join("".join(c if c.isalnum() else " " for c in letters).split())


def identity_name(name: Column) -> Column:
    """A name without case, accents and punctuation, in any script; null stays null."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            known = {n: _identity(n) for n in names.dropna().unique()}
            yield pd.Series([known.get(n) for n in names], dtype=object)

    return fold(name)


def evidence_text(text: Column) -> Column:
    """Compatibility form without case and with single blanks; punctuation stays."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else " ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in texts], dtype=object)

    return fold(text)


def modification_expected(title: Column, action: Column) -> Column:
    """Whether a title says that the act of this type is a modification; null if it doesn't name the act.

    The word must stand in the act's own clause. Where a modified prior authorisation is coordinated with one for
    construction, the latter is modified only if the rest of the title says so. Other types are never modifications.
    """
    key = documentary(title)
    coordinated = has(key, PRIOR_MODIFIED_AND_CONSTRUCTION)
    tail = F.regexp_replace(key, rf"(?U)^.*?(?:{PRIOR_MODIFIED_AND_CONSTRUCTION})", "")
    prior, construction = MODIFIABLE[:2]
    out = F.lit(False)
    for kind in MODIFIABLE:
        if kind not in ACTIONS:
            continue
        pattern = ACTIONS[kind]
        # From the last clause end before the act to the first one after it.
        matched = F.regexp_extract(key, rf"(?U)({pattern})", 1)
        at = F.instr(key, matched)
        head, rest = F.substr(key, F.lit(1), at - 1), F.substr(key, at + F.length(matched))
        own = F.concat(F.regexp_extract(head, r"[^.;]*$", 0), matched, F.regexp_extract(rest, r"^[^.;]*", 0))
        told = has(own, MODIFIED)
        if kind == prior:
            told = F.when(coordinated, F.lit(True)).otherwise(told)
        elif kind == construction:
            told = F.when(coordinated, has(tail, MODIFIED)).otherwise(told)
        out = F.when(action == kind, F.when(has(key, pattern), told)).otherwise(out)
    return out


def is_historical(evidence: Column) -> Column:
    """Whether the wording tells of an earlier act."""
    return has(documentary(evidence), HISTORICAL)


def shared_prefix_names(first: Column, others: Column, prefix: str) -> Column:
    """Names of a list whose first has a prefix that the others share: ``plant A``, ``B`` also as ``plant B``."""
    head = F.regexp_extract(first, rf"(?iU)^({prefix})\s+\S", 1)
    return F.when(head != "", F.concat(F.array(first), F.transform(others, lambda o: F.concat_ws(" ", head, o))))


def bounded_lists(text: Column, opening: str) -> Column:
    """The items of each list in brackets after ``opening``, cut at commas and semicolons; lists of one item don't count."""
    found = F.regexp_extract_all(text, F.lit(rf"(?iU)(?:{opening})\s*\(([^()]*)\)"), F.lit(1))
    items = F.transform(found, lambda x: F.filter(F.transform(F.split(x, r"\s*[,;]\s*"), lambda i: F.trim(i)), lambda i: i != ""))
    return F.filter(items, lambda i: F.size(i) >= 2)


def table_names(text: Column, header: str, second: str, context: str, row: str, width: int = 2) -> Column:
    """Names in tables written a cell a line.

    A table begins with a line that is ``header`` and a next one with ``second``, where one of the two lines before
    has ``context``; its rows have ``width`` cells, of which the second must have ``row``, or the table ends.
    """

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([_table_names(x or "", header, second, context, row, width) for x in texts], dtype=object)

    return find(text)


def _table_names(text: str, header: str, second: str, context: str, row: str, width: int) -> list[str]:
    lines = [" ".join(line.split()).lower() for line in text.splitlines() if line.strip()]
    names: set[str] = set()
    for at in range(len(lines) - 1):
        told = " ".join(lines[max(0, at - 2) : at])
        if not (re.fullmatch(header, lines[at]) and re.search(second, lines[at + 1]) and re.search(context, told)):
            continue
        for cell in range(at + width, len(lines) - 1, width):
            if not re.search(row, lines[cell + 1]):
                break
            names.add(lines[cell])
    return sorted(names)
