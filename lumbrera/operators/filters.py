"""Filters whose empty selection means no filter."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_folded
from .latest import latest_per_key


def selected(df: DataFrame, **choices: Iterable) -> DataFrame:
    """OR within a column, AND across columns; an empty choice leaves the column free."""
    for column, values in choices.items():
        if values := list(values or ()):
            df = df.filter(F.col(column).isin(values))
    return df


def between(df: DataFrame, column: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Inclusive interval; either end may be open."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def any_column_in(df: DataFrame, columns: Sequence[str], values: Sequence) -> DataFrame:
    return df.filter(reduce(Column.__or__, (F.col(c).isin(list(values)) for c in columns))) if values else df


def is_exactly(column: str, value: bool) -> Column:
    """Null counts as unequal."""
    return F.coalesce(F.col(column) == value, F.lit(False))


def text_search(df: DataFrame, columns: Sequence[str], text: str | None) -> DataFrame:
    """Rows with the text, without case or accents, in one of the columns."""
    if not text or not text.strip():
        return df
    return df.filter(reduce(Column.__or__, (contains_folded(F.col(c), text) for c in columns)))


def year_interval(year: int) -> tuple[date, date]:
    return date(year, 1, 1), date(year, 12, 31)


def event_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str, latest: bool, start=None, end=None, years: Sequence[int] = (), **choices: Iterable) -> DataFrame:
    """All rows, or first the latest of each key; then the predicates: a filter never makes an older row the latest."""
    base = latest_per_key(df, keys, order) if latest else df
    base = between(base, day, start, end)
    if years:
        base = base.filter(F.year(day).isin(list(years)))
    return selected(base, **choices)


def keys_at_levels(df: DataFrame, key: str, levels: dict[str, Sequence]) -> DataFrame:
    """Keys that have a row for every level with a choice: the intersection of the levels' key sets."""
    out = df.select(key).distinct()
    for column, values in levels.items():
        if values:
            out = out.join(df.filter(F.col(column).isin(list(values))).select(key).distinct(), key, "left_semi")
    return out


def search_universe(df: DataFrame, key: str, day: str, start, end, cutoff, main: DataFrame, holdout: DataFrame) -> DataFrame:
    """Rows within the dates, before the cutoff or in the main scope, and not held out."""
    dated = between(df, day, start, end)
    early = dated.filter(F.col(day) < F.lit(cutoff))
    scoped = dated.filter(F.col(day) >= F.lit(cutoff)).join(main.select(key).distinct(), key, "left_semi")
    return early.unionByName(scoped).join(holdout.select(key).distinct(), key, "left_anti")
