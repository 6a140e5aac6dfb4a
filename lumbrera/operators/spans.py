"""Units of a text, the shortest unit that holds what is sought, and the section that a place belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import documentary


def source_units(title: Column, text: Column) -> Column:
    """The title, the lines and the sentences in order, each once, without blanks."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.;])\s+")))
    every = F.concat(F.array(F.coalesce(title, F.lit(""))), lines, sentences)
    # a lambda of one parameter: trim by itself would get the index as the characters to trim
    return F.array_distinct(F.filter(F.transform(every, lambda u: F.trim(u)), lambda u: u != ""))


def shortest_unit(units: Column, anchors: Column, patterns: Sequence[str] = ()) -> Column:
    """The shortest unit (of equal ones the first) with all anchors and patterns; else the shortest with any anchor; else null."""

    def pick(test) -> Column:  # noqa: ANN001
        indexed = F.transform(units, lambda u, i: F.struct(F.length(u).alias("n"), i.alias("i"), u.alias("u")))
        return F.array_min(F.filter(indexed, lambda x: test(documentary(x["u"]))))["u"]

    holds = lambda u: F.forall(anchors, lambda a: F.contains(u, documentary(a)))
    told = lambda u: F.lit(True) if not patterns else sum((u.rlike(f"(?U){p}").cast("int") for p in patterns), F.lit(0)) == len(patterns)
    some = lambda u: F.exists(anchors, lambda a: F.contains(u, documentary(a)))
    return F.coalesce(pick(lambda u: holds(u) & told(u)), pick(some))


def places(text: Column, pattern: str) -> Column:
    """Starts (from 0) of all matches of the pattern: sums of the parts' lengths before each."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern)
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, zero, lambda a, s: F.struct((a["at"] + s["g"] + s["m"]).alias("at"), F.array_append(a["out"], a["at"] + s["g"]).alias("out")))["out"]


def section_at(place: Column, facts: Column, grounds: Column, operative: Column) -> Column:
    """facts, grounds, operative, pre_operative or body: by the heading places before it and after."""
    last = lambda xs: F.array_max(F.filter(xs, lambda x: x <= place))
    after = lambda xs, y: F.array_min(F.filter(xs, lambda x: x > y))
    fact, ground = last(facts), last(grounds)
    fact_end = F.array_min(F.concat(F.filter(grounds, lambda x: x > fact), F.filter(operative, lambda x: x > fact)))
    ground_end = after(operative, ground)
    first = F.array_min(operative)
    return (
        F.when(fact.isNotNull() & (fact_end.isNull() | (place < fact_end)), "facts")
        .when(ground.isNotNull() & (ground_end.isNull() | (place < ground_end)), "grounds")
        .when(first.isNotNull() & (place >= first), "operative")
        .when(first.isNotNull(), "pre_operative")
        .otherwise("body")
    )


def evidence_join(facts: DataFrame, parent: str, fragments: str, passages: DataFrame, texts: str) -> DataFrame:
    """Facts and passages of one parent where some passage holds some fragment, as documentary text."""
    joined = facts.join(passages, parent)
    held = F.exists(F.col(fragments), lambda f: F.exists(F.col(texts), lambda t: F.contains(documentary(t), documentary(f))))
    return joined.filter(held)
