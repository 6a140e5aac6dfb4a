"""Two-tier retrieval of documents for names: exact phrases first, then all words with corroboration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize


def usable(phrase: Column, generic: Sequence[str]) -> Column:
    """Whether some word that isn't generic has four letters or more."""
    return F.exists(F.split(phrase, " "), lambda w: ~w.isin(*generic, "") & w.rlike("^[a-z]{4,}$"))


def inverted_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """term, doc, places (sorted) of the normalised text."""
    words = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(normalize(F.col(text)), " ")).alias("at", "term")).filter("term <> ''")
    return words.groupBy("term", "doc").agg(F.array_sort(F.collect_list("at")).alias("places"))


def phrase_matches(queries: DataFrame, query: str, phrase: str, docs: DataFrame, doc: str, text: str, generic: Sequence[str] = (), floor: int = 10, share: float = 0.0005) -> DataFrame:
    """query, doc: documents with the whole phrase between word ends, for phrases in at most max(floor, share x documents) of them.

    A phrase is looked for only in documents that hold its rarest word.
    """
    asked = queries.select(F.col(query).alias("query"), normalize(F.col(phrase)).alias("p")).filter("p <> ''").filter(usable(F.col("p"), generic) if generic else F.lit(True)).distinct()
    terms = asked.select("p", F.explode(F.split("p", " ")).alias("term")).distinct()
    corpus = docs.select(F.col(doc).alias("doc"), normalize(F.col(text)).alias("n"))
    index = corpus.select("doc", F.explode(F.array_distinct(F.split("n", " "))).alias("term"))
    counts = index.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = terms.join(counts, "term", "left").groupBy("p").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    holds = F.contains(F.concat(F.lit(" "), "n", F.lit(" ")), F.concat(F.lit(" "), "p", F.lit(" ")))
    found = index.join(rarest, "term").select("p", "doc").join(corpus, "doc").filter(holds).select("p", "doc").distinct()
    total = docs.agg(F.greatest(F.lit(floor), F.ceil(F.lit(share) * F.count(F.lit(1)))).alias("most"))
    frequent = found.groupBy("p").agg(F.count_distinct("doc").alias("df")).join(total).filter("df <= most").select("p")
    return found.join(frequent, "p", "left_semi").join(asked, "p").select("query", "doc").distinct()


def word_matches(queries: DataFrame, query: str, name: str, docs: DataFrame, doc: str, text: str, generic: Sequence[str] = (), markers: Sequence[str] = ()) -> DataFrame:
    """query, doc: documents that hold all words of the name (two at least) that aren't generic, and one of the markers if any are given."""
    keep = F.filter(F.array_distinct(F.split(normalize(F.col(name)), " ")), lambda w: (F.length(w) >= 2) & ~w.isin(*generic, ""))
    asked = queries.select(F.col(query).alias("query"), keep.alias("words")).filter(F.size("words") >= 2)
    words = asked.select("query", F.size("words").alias("n"), F.explode("words").alias("term"))
    corpus = docs.filter(normalize(F.col(text)).rlike("|".join(markers))) if markers else docs
    index = corpus.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(F.split(normalize(F.col(text)), " "))).alias("term"))
    met = index.join(words, "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n"))
    return met.filter("held = n").select("query", "doc")


def two_tiers(first: DataFrame, second: DataFrame) -> DataFrame:
    """query, doc, tier: a pair of the first tier isn't repeated in the second."""
    return first.withColumn("tier", F.lit(1)).unionByName(second.join(first, ["query", "doc"], "left_anti").withColumn("tier", F.lit(2)))
