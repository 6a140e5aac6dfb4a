"""Audit views: traces, summaries, identities, orders, sources and identifiers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .filters import between, selected
from .joins import CardinalityError, checked_join
from .latest import latest_per_key


def display_order(value: Column) -> tuple[Column, Column]:
    """Order by normalised, then raw form."""
    return normalize(value), value


def sorted_set(value: Column, when: Column | None = None) -> Column:
    """Aggregate: distinct non-blank values, those of rows that hold ``when``, in display order."""
    usable = F.trim(value) != "" if when is None else when & (F.trim(value) != "")
    pairs = F.array_sort(F.collect_set(F.when(usable, F.struct(normalize(value).alias("n"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def observed_values(df: DataFrame, column: str) -> DataFrame:
    """The column's distinct values in display order."""
    return df.select(F.col(column).cast("string").alias(column)).dropna().distinct().orderBy(*display_order(F.col(column)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def with_several(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys with more than one value of the column, and how many."""
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("n")).filter("n > 1")


def ratio(numerator: Column, denominator: Column, name: str) -> list[Column]:
    """numerator, denominator, the ratio (null without a denominator) and why it is null; a part above its whole is an error."""
    bad = F.raise_error(F.lit("a ratio needs 0 <= numerator <= denominator")).cast("double")
    value = F.when((numerator < 0) | (numerator > denominator), bad).otherwise(F.try_divide(numerator, denominator))
    return [numerator.alias("numerator"), denominator.alias("denominator"), value.alias(name), F.when(denominator == 0, "zero_denominator").alias("undefined_reason")]


def territorial_trace(sources: DataFrame, places: DataFrame, projects: DataFrame, place: str, project: str) -> DataFrame:
    """A row per source, with its place and that place's project; places and projects are unique, so no source is repeated."""
    return checked_join(checked_join(sources, places, [place], validate="m:1"), projects, [project], validate="m:1")


def audit_rows(df: DataFrame, order: Sequence[str], day: str | None = None, start=None, end=None, **choices: Iterable) -> DataFrame:  # noqa: ANN001
    """Rows that fit the choices and dates (an empty choice leaves its column free), in the audit's order."""
    rows = selected(df, **choices)
    return (between(rows, day, start, end) if day else rows).orderBy(*order)


def publication_summary(actions: DataFrame, sources: DataFrame, publication: str, day: str, action: str) -> DataFrame:
    """Each publication of either table once, with its distinct actions; one with two dates is an error."""
    every = actions.select(publication, day, F.col(action).alias("__a")).unionByName(sources.select(publication, day, F.lit(None).cast(actions.schema[action].dataType).alias("__a")))
    sums = every.groupBy(publication).agg(F.min(day).alias(day), F.max(day).alias("__last"), F.count_distinct("__a").alias("n_actions"))
    bad = F.raise_error(F.lit("a publication has more than one date")).cast("long")
    return sums.select(day, publication, F.when(F.col(day).eqNullSafe(F.col("__last")), F.col("n_actions")).otherwise(bad).alias("n_actions"))


def catalogue_territories(places: DataFrame, project: str, levels: Mapping[str, tuple[str, Column | None]]) -> DataFrame:
    """Per project a sorted set for each level: name -> (column, the rows that count for it)."""
    return places.groupBy(project).agg(*[sorted_set(F.col(c), when).alias(name) for name, (c, when) in levels.items()])


def identity_sets(projects: DataFrame, places: DataFrame, project: str, community: str, province: str, municipality: str, level: str) -> DataFrame:
    """Per project the values a selection may stand for: communities, provinces and municipalities with those above them.

    Read from the places themselves, never from a display list that may be cut; projects without places have empty sets.
    """
    in_province, in_town = F.col(province).isNotNull(), (F.col(level) == "municipality") & F.col(municipality).isNotNull()
    sets = catalogue_territories(places, project, {
        "communities": (community, None), "provinces": (province, in_province), "province_communities": (community, in_province),
        "municipalities": (municipality, in_town), "municipality_provinces": (province, in_town), "municipality_communities": (community, in_town),
    })
    empty = F.array().cast("array<string>")
    return projects.join(sets, project, "left").withColumns({c: F.coalesce(c, empty) for c in sets.columns if c != project})


def level_order(level: Column, name: Column, levels: Sequence[str]) -> list[Column]:
    """Order by the level's place in the list (others last), then by the normalised name."""
    rank = F.lit(len(levels))
    for i, value in enumerate(levels):
        rank = F.when(level == value, F.lit(i)).otherwise(rank)
    return [rank, normalize(name)]


def current_sources(df: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose composite key is a current source; a source that is listed twice is an error."""
    return checked_join(df, sources.select(*keys), keys, validate="m:1")


def decisive_successes(attempts: DataFrame, sources: DataFrame, source: Sequence[str], key: str, order: Sequence[str], **required: object) -> DataFrame:
    """Per document the latest attempt on its current source that has every required value (null never has)."""
    good = attempts
    for column, value in required.items():
        good = good.filter(F.col(column) == F.lit(value))
    return latest_per_key(current_sources(good, sources, source), [key], order)


def valid_documents(df: DataFrame, status: str, text: str, ok: str = "ok") -> DataFrame:
    return df.filter((F.col(status) == ok) & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))


def all_valid(df: DataFrame, status: str, text: str, ok: str = "ok") -> DataFrame:
    """The rows, if every one is valid; else an error."""
    if not df.filter(~F.coalesce((F.col(status) == ok) & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""), F.lit(False))).isEmpty():
        raise CardinalityError("a document isn't valid")
    return df


def misnumbered(df: DataFrame, group: str, id_: str, suffix: str) -> DataFrame:
    """Groups whose ids aren't exactly group_suffix_1 to group_suffix_n."""
    number = F.regexp_extract(F.col(id_), rf"_{suffix}_([1-9][0-9]*)$", 1).try_cast("long")
    own = F.col(id_) == F.concat_ws("_", F.col(group).cast("string"), F.lit(suffix), number.cast("string"))
    sums = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(own, number)).alias("good"), F.max(F.when(own, number)).alias("high"))
    return sums.filter(~((F.col("good") == F.col("n")) & (F.col("high") == F.col("n")))).select(group, "n")


def serialized(df: DataFrame) -> DataFrame:
    """Each row as JSON with its columns in order of name, nulls written."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))


def not_in(df: DataFrame, whole: DataFrame) -> DataFrame:
    """Serialized rows that ``whole`` lacks: none, if df is a subset of it."""
    return serialized(df).join(serialized(whole).distinct(), "row", "left_anti")


def corrections_within(corrections: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """The corrections of documents in the universe; a correction listed twice is an error."""
    if not corrections.groupBy(*corrections.columns).count().filter("count > 1").isEmpty():
        raise CardinalityError("a correction is listed twice")
    return corrections.join(universe.select(key).distinct(), key, "left_semi")


def place_audit(mentions: DataFrame, mention: str, links: DataFrame) -> DataFrame:
    """One row: mentions, those that are linked, those left out, and links beyond one per mention."""
    linked = links.agg(F.count(F.lit(1)).alias("__links"), F.count_distinct(mention).alias("n_resolved"))
    counts = mentions.agg(F.count(F.lit(1)).alias("n_mentions")).join(linked)  # two single rows
    return counts.select("n_mentions", "n_resolved", (F.col("n_mentions") - F.col("n_resolved")).alias("n_omitted"), (F.col("__links") - F.col("n_resolved")).alias("n_expansions"))
