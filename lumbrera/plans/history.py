"""Earlier publications of known projects: signatures, the search universe, two tiers of retrieval and the scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import filters as P
from ..operators import retrieve as V

# Words that identify no project, and what marks a technology in a normalised text.
GENERIC = (
    "solar", "solares", "eolico", "eolica", "eolicos", "eolicas", "fotovoltaico", "fotovoltaica", "fotovoltaicos", "fotovoltaicas", "parque",
    "parques", "planta", "plantas", "proyecto", "proyectos", "central", "centrales", "instalacion", "instalaciones", "generacion", "fase", "modulo",
    "modulos", "fv", "pfv", "psfv", "pe", "peol", "de", "del", "la", "las", "el", "los", "y", "en",
)
MARKERS = {
    "fotovoltaica": ("fotovolta", " planta solar ", " psfv ", " pfv ", " fv "),
    "eolica": ("eolic", " aerogenerador", " parque eolico ", " pe "),
    "hidroelectrica": ("hidroelect", " central hidraul", " aprovechamiento hidraul"),
    "termosolar": ("termosolar", "solar termoelect"),
    "biomasa": ("biomasa",),
    "biogas": ("biogas",),
    "cogeneracion": ("cogeneracion",),
}


def signatures(mentions: DataFrame) -> DataFrame:
    """project_id, aliases, locations and technologies (sorted arrays), and a JSON of them as a stable signature."""
    sets = [F.array_sort(F.collect_set(normalize(F.col(c)))).alias(n) for c, n in (("name", "aliases"), ("location", "locations"))]
    rows = mentions.groupBy("project_id").agg(*sets, F.array_sort(F.collect_set("technology")).alias("technologies"))
    return rows.withColumn("signature", F.to_json(F.struct("aliases", "locations", "technologies")))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, technology: technologies whose marker the text has."""
    # The text is a lambda's argument, so that it is normalised once and not for every marker.
    told = F.array(F.concat(F.lit(" "), normalize(F.col("text")), F.lit(" ")))
    has = lambda n, marks: reduce(Column.__or__, (F.contains(n, F.lit(m)) for m in marks))
    found = F.transform(told, lambda n: F.array_compact(F.array(*[F.when(has(n, marks), F.lit(t)) for t, marks in MARKERS.items()])))
    return docs.select("doc_id", F.explode(F.flatten(found)).alias("technology"))


def candidates(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """project_id, doc_id, tier.

    The first tier has a whole alias as a phrase; the second all its telling
    words, a marker of a technology or the phrase of a location of the project,
    and, for a single telling word, seven letters and at most three documents.
    """
    alias = signed.select("project_id", F.explode("aliases").alias("alias"))
    first = V.phrase_matches(alias, "project_id", "alias", docs, "doc_id", "text", generic=GENERIC)
    told = alias.select(F.concat_ws("\t", "project_id", "alias").alias("q"), "alias")
    words = V.word_matches(told, "q", "alias", docs, "doc_id", "text", generic=GENERIC).select(F.substring_index("query", "\t", 1).alias("project_id"), F.col("doc").alias("doc_id"))
    rare_name = F.filter(F.split("alias", " "), lambda w: ~w.isin(*GENERIC, ""))
    single = alias.filter(F.size(rare_name) == 1).select("project_id", F.get(rare_name, F.lit(0)).alias("word")).filter(F.length("word") >= 7)
    rare = V.phrase_matches(single, "project_id", "word", docs, "doc_id", "text", floor=3, share=0.0).select(F.col("query").alias("project_id"), F.col("doc").alias("doc_id"))
    met = words.unionByName(rare).distinct()
    # Only pairs that the words met are held against technologies, which are few and shared by most.
    own = met.join(signed.select("project_id", F.explode("technologies").alias("technology")), "project_id")
    by_technology = own.join(marked(docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi")), ["doc_id", "technology"], "left_semi").select("project_id", "doc_id")
    places = signed.select("project_id", F.explode("locations").alias("place"))
    by_place = V.phrase_matches(places, "project_id", "place", docs, "doc_id", "text", floor=1 << 30).select(F.col("query").alias("project_id"), F.col("doc").alias("doc_id"))
    backed = by_technology.unionByName(by_place).distinct()
    second = met.join(backed, ["project_id", "doc_id"], "left_semi").select(F.col("project_id").alias("query"), F.col("doc_id").alias("doc"))
    return V.two_tiers(first, second).select(F.col("query").alias("project_id"), F.col("doc").alias("doc_id"), "tier")


def build(mentions: DataFrame, docs: DataFrame, main: DataFrame, holdout: DataFrame, start, end, cutoff) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(links, scope): the retrieved documents of each project, and each document once with its best tier and number of projects.

    The universe is settled on ids and dates before any text is read.
    """
    chosen = P.search_universe(docs.select("doc_id", "day"), "doc_id", "day", start, end, cutoff, main, holdout)
    links = candidates(signatures(mentions), docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    scope = links.groupBy("doc_id").agg(F.min("tier").alias("tier"), F.count_distinct("project_id").alias("n_projects"))
    return links, scope
