"""Forced pairs of a bipartite candidate graph, and components of small graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _augment(left: str, edges: dict[str, set[str]], match: dict[str, str], seen: set[str]) -> bool:
    """Whether ``left`` gets a partner along an alternating path (iterative, so long paths are no matter)."""
    stack, chosen = [(left, iter(sorted(edges.get(left, ()))))], []
    while stack:
        node, partners = stack[-1]
        partner = next((p for p in partners if p not in seen), None)
        if partner is None:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        seen.add(partner)
        chosen.append((node, partner))
        if partner not in match:
            for a, b in chosen:
                match[b] = a
            return True
        stack.append((match[partner], iter(sorted(edges.get(match[partner], ())))))
    return False


def maximum_matching(edges: dict[str, set[str]]) -> dict[str, str]:
    """Partner of each matched right node."""
    match: dict[str, str] = {}
    for left in sorted(edges):
        _augment(left, edges, match, set())
    return match


def forced_pairs(edges: dict[str, set[str]]) -> set[tuple[str, str]]:
    """Pairs in every maximum matching, found again among what is left until there are no more."""
    edges, forced = {a: set(b) for a, b in edges.items() if b}, set()
    while edges:
        match = maximum_matching(edges)
        size, sure = len(match), set()
        for b, a in match.items():
            without = {x: (y - {b} if x == a else set(y)) for x, y in edges.items()}
            if len(maximum_matching(without)) < size:
                sure.add((a, b))
        if not sure:
            return forced
        forced |= sure
        gone_a, gone_b = {a for a, _ in sure}, {b for _, b in sure}
        edges = {a: rest for a, bs in edges.items() if a not in gone_a and (rest := bs - gone_b)}
    return forced


def match_forced(candidates: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """group, left, right, status (forced or ambiguous) of every candidate pair; groups are single documents, so small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: dict[str, set[str]] = {}
        for a, b in zip(pdf[left], pdf[right], strict=True):
            edges.setdefault(a, set()).add(b)
        forced = forced_pairs(edges)
        taken_a, taken_b = {a for a, _ in forced}, {b for _, b in forced}
        status = ["forced" if (a, b) in forced else "excluded" if a in taken_a or b in taken_b else "ambiguous" for a, b in zip(pdf[left], pdf[right], strict=True)]
        return pdf.assign(status=status)

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    pairs = candidates.select(group, left, right).distinct()
    return pairs.groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{left}` {kinds[left]}, `{right}` {kinds[right]}, status string")


def group_components(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, node, component (least node) within each group's own small graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(pdf[a], pdf[b], strict=True):
            x, y = sorted((root(x), root(y)))
            parent[y] = x
        nodes = sorted(parent)
        return pd.DataFrame({group: pdf[group].iloc[0], "node": nodes, "component": [root(n) for n in nodes]})

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, node {kinds[a]}, component {kinds[a]}")


def pair_counts(matched: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn of forced pairs against all truths and predictions."""
    tp = matched.filter(F.col("status") == "forced").agg(F.count(F.lit(1)).alias("tp"))
    sums = tp.join(truth.agg(F.count(F.lit(1)).alias("t"))).join(predicted.agg(F.count(F.lit(1)).alias("p")))
    return sums.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))
