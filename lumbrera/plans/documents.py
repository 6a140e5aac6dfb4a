"""Titles, evidence, dates, sections, rings and nested documents, bound to strings made from the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as X
from ..functions import titles
from ..operators import corrections as K
from ..operators import geometry as G
from ..operators import spans as S
from . import gold, silver
from .registry import Tables, query


def _by_key(key: str, *choices: str) -> Column:
    """The choices in turn, by the key's remainder."""
    rest = F.lit(choices[-1])
    for i, choice in reversed(list(enumerate(choices[:-1]))):
        rest = F.when(F.col(key) % len(choices) == i, F.lit(choice)).otherwise(rest)
    return rest


def _case(key: str, *choices: str | None) -> str:
    told = lambda c: "NULL" if c is None else f"'{c}'"
    return "CASE " + key + f" % {len(choices)} " + " ".join(f"WHEN {i} THEN {told(c)}" for i, c in enumerate(choices)) + " END"


_TITLES = (
    "Resolución por la que se otorga autorización administrativa previa a la planta fotovoltaica SOL",
    "Corrección de errores de la declaración de impacto ambiental",
    "Anuncio por el que se somete a información pública la declaración de impacto ambiental del parque eólico VIENTO",
    "Anuncio de licitación del suministro", "Gasoducto de enlace", "Prórroga concedida",
)
_ACTIONS = ("autorizacion_administrativa_previa", "correccion_errores", "evaluacion_impacto_ambiental", "", "", "prorroga")
_DECISIONS = ("autorizado", "rectificado", "sometido_informacion_publica", None, None, "prorrogado")
_GUARDS = ("require_project_review", "no_deterministic_decision", "require_project_review", "force_not_relevant", "force_not_relevant", "no_deterministic_decision")


def _titled(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", _by_key("p_partkey", *_TITLES).alias("title"))


@query(f"SELECT p_partkey, {_case('p_partkey', *_ACTIONS)} AS actions FROM part")
def title_actions(t: Tables) -> DataFrame:
    return _titled(t).select("p_partkey", F.array_join(titles.title_actions(F.col("title")), ",").alias("actions"))


@query(f"SELECT p_partkey, {_case('p_partkey', *_DECISIONS)} AS decision FROM part")
def title_decisions(t: Tables) -> DataFrame:
    rows = _titled(t).withColumn("action", F.get(titles.title_actions(F.col("title")), F.lit(0)))
    return rows.select("p_partkey", F.when(F.col("action").isNotNull(), titles.title_decision(F.col("title"), F.col("action"))).alias("decision"))


@query(f"SELECT p_partkey, {_case('p_partkey', *_GUARDS)} AS decision FROM part")
def scope_guard(t: Tables) -> DataFrame:
    return _titled(t).select("p_partkey", titles.scope_guard(F.col("title"))["decision"].alias("decision"))


@query(f"SELECT p_partkey, {_case('p_partkey', *_GUARDS)} = 'force_not_relevant' AS deterministic FROM part WHERE p_partkey % 4 <> 0")
def extraction_plan(t: Tables) -> DataFrame:
    pending = _titled(t).join(t.part.filter("p_partkey % 4 = 0").select("p_partkey"), "p_partkey", "left_anti")
    return pending.select("p_partkey", (titles.scope_guard(F.col("title"))["decision"] == "force_not_relevant").alias("deterministic"))


@query(f"SELECT p_partkey, {_case('p_partkey', 'eolica', 'fotovoltaica', 'termosolar', 'hidroelectrica', 'biomasa', None, None)} AS kind FROM part")
def generation_types(t: Tables) -> DataFrame:
    told = _by_key("p_partkey", "Parque EÓLICO", "planta fotovoltaica", "TERMOSOLAR", "Central hidroeléctrica", "biomasa forestal", "eólica y fotovoltaica", "subestación")
    return t.part.select("p_partkey", titles.generation_type(told).alias("kind"))


_TOLD = "concat(day(o_orderdate), ' de ', CASE WHEN month(o_orderdate) = 1 THEN 'Enero' ELSE 'mayo' END, ' de ', year(o_orderdate), ' y 31/2/1999')"


@query("SELECT o_orderkey, strftime(make_date(CAST(year(o_orderdate) AS INT), CASE WHEN month(o_orderdate) = 1 THEN 1 ELSE 5 END, CAST(day(o_orderdate) AS INT)), '%Y-%m-%d') AS found, make_date(CAST(year(o_orderdate) AS INT), CASE WHEN month(o_orderdate) = 1 THEN 1 ELSE 5 END, CAST(day(o_orderdate) AS INT)) < DATE '1998-01-01' AS earlier FROM orders")
def dates_in_text(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.expr(_TOLD).alias("told"))
    return rows.select("o_orderkey", F.array_join(F.transform(titles.dates(F.col("told")), lambda d: d.cast("string")), ",").alias("found"), titles.has_earlier_date(F.col("told"), F.lit("1998-01-01").cast("date")).alias("earlier"))


_SAID = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"""
SELECT conv_id, turn, coalesce(before <> '' AND contains(told, before), false) AS supported
FROM (SELECT conv_id, turn, {_SAID} AS told, lag({_SAID}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def evidence_supported(t: Tables) -> DataFrame:
    """The turn before, in capitals and over several lines, as evidence of each turn."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("evidence", F.replace(F.upper(before), F.lit(" "), F.lit("\n ")))
    return rows.select("conv_id", "turn", X.evidence_supported(F.col("evidence"), F.col("text")).alias("supported"))


@query("""
SELECT doc_id, CASE WHEN length(text) >= 1000 THEN rtrim(text, ' ') ELSE text || chr(10) || 'ANEXO de bienes ' || text END AS kept FROM documents WHERE text IS NOT NULL""")
def annex_cut(t: Tables) -> DataFrame:
    """Every text with an annex after it, which counts from 1000 characters on."""
    marked = F.concat("text", F.lit("\nANEXO de bienes "), F.col("text"))
    return t.documents.filter("text IS NOT NULL").select("doc_id", X.cut_after(marked, r"\nANEXO", 1000).alias("kept"))


@query("SELECT p_partkey, " + _case("p_partkey", "facts", "grounds", "operative", "pre_operative", "body") + " AS section FROM part")
def document_sections(t: Tables) -> DataFrame:
    told = _by_key("p_partkey", "a HECHO b HERE c RAZON d RESUELVE", "HECHO RAZON b HERE RESUELVE", "HECHO RAZON RESUELVE b HERE", "b HERE c RESUELVE", "HERE alone")
    rows = t.part.select("p_partkey", told.alias("told"))
    place = F.instr("told", "HERE") - 1
    at = lambda p: S.places(F.col("told"), p)
    return rows.select("p_partkey", S.section_at(place, at("HECHO"), at("RAZON"), at("RESUELVE")).alias("section"))


@query("SELECT n_nationkey, CAST((n_nationkey + 1) * (n_regionkey + 2) AS DOUBLE) AS area, n_nationkey >= 1 AS holds FROM nation")
def ring_area(t: Tables) -> DataFrame:
    w, h = (F.col("n_nationkey") + 1).cast("double"), (F.col("n_regionkey") + 2).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    rows = t.nation.select("n_nationkey", F.array(point(zero, zero), point(w, zero), point(w, h), point(zero, h)).alias("ring"))
    return rows.select("n_nationkey", G.signed_area(F.col("ring")).alias("area"), G.inside(F.lit(1.5), F.lit(0.5), F.col("ring")).alias("holds"))


@query("""
SELECT count(*) AS n_documents, count(*) FILTER (quality IS NOT NULL) AS n_reviewed, count(*) FILTER (quality = 1 AND n_chars > 1000) AS n_agreed,
  CASE WHEN count(quality) = 0 THEN 1.0 ELSE round(count(*) FILTER (quality = CAST(n_chars > 1000 AS INT)) / count(quality), 9) END AS rate
FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_metric(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    auto = (F.col("n_chars") > 1000).cast("int")
    rate = F.when(F.count("quality") == 0, 1.0).otherwise(F.round(count(F.col("quality") == auto) / F.count("quality"), 9))
    return rows.agg(F.count(F.lit(1)).alias("n_documents"), count(F.col("quality").isNotNull()).alias("n_reviewed"), count((F.col("quality") == 1) & (F.col("n_chars") > 1000)).alias("n_agreed"), rate.alias("rate"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS matched FROM supplier")
def fuzzy_names(t: Tables) -> DataFrame:
    """Best name of the same nation by edit similarity, if it is 0.9 or more and 0.04 ahead of the second."""
    asked = t.supplier.select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise("x").alias("asked"))
    known = t.supplier.select("s_nationkey", F.col("s_suppkey").alias("code"), F.reverse("s_name").alias("back"), "s_name")
    blocks = asked.join(known, "s_nationkey")
    similar = 1 - F.levenshtein(X.normalize(F.col("asked")), X.normalize(F.col("s_name"))) / F.greatest(F.length("asked"), F.length("s_name"))
    order = Window.partitionBy("s_suppkey").orderBy(F.desc("similarity"), "code")
    top = blocks.withColumn("similarity", similar).withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("similarity").over(order)).filter("place = 1")
    ahead = F.col("second").isNull() | (F.col("similarity") - F.col("second") >= 0.04)
    return top.select("s_suppkey", F.when((F.col("similarity") >= 0.9) & ahead, F.col("code")).alias("matched"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 15 = 0")
def scope_lists(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_nationkey")
    return K.scope(rows, "c_custkey", rows.filter("c_custkey % 10 = 0"), rows.filter("c_custkey % 15 = 0"))[0]


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 = 0")
def verified_corrections(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_size")
    return K.verified(rows.filter("p_partkey % 3 = 0"), rows, "p_partkey", ["p_size"])


def extractions(t: Tables) -> DataFrame:
    """A nested document per conversation: an event per turn, one asset each, and an action on the event."""
    ref, none = F.lit("generation_asset_1"), F.array().cast("array<string>")
    asset = F.struct(ref.alias("local_generation_asset_ref"), F.array("role", F.lit("x")).alias("names_raw"), F.lit("eolica").alias("generation_type"), F.col("text").alias("evidence"))
    action = F.struct(F.lit("prorroga").alias("action_type"), F.lit("prorrogado").alias("decision"), F.array(F.lit("event"), ref).alias("targets"), F.lit("e").alias("evidence"))
    event = F.struct(F.col("turn"), F.array(asset).alias("generation_assets"), F.array(action).alias("administrative_actions"), none.alias("case_file_references"), F.lit("s").alias("event_summary"))
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(event)).alias("publication_events"))
    return rows.select(F.to_json(F.struct(F.concat(F.lit("D"), F.col("conv_id").cast("string")).alias("boe_id"), F.lit("2024-01-01").alias("publication_date"), "publication_events")).alias("j"))


_PLACED = "(SELECT 'D' || conv_id || '_event_' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS event_id, role FROM conversations)"


@query(f"SELECT event_id, event_id || '_generation_asset_1' AS asset_id, CAST(n AS INT) AS name_index, CASE n WHEN 1 THEN role ELSE 'x' END AS name_raw FROM {_PLACED}, (VALUES (1), (2)) v(n)")
def silver_names(t: Tables) -> DataFrame:
    names = silver.flatten(silver.parse(extractions(t), "j"))["generation_asset_names"]
    return names.select("event_id", F.col("generation_asset_mention_id").alias("asset_id"), "name_index", "name_raw")


@query(f"SELECT event_id, event_id || '_action_1' AS action_id, target_kind, CASE target_kind WHEN 'event' THEN event_id ELSE event_id || '_generation_asset_1' END AS target FROM {_PLACED}, (VALUES ('event'), ('generation_asset')) v(target_kind)")
def silver_targets(t: Tables) -> DataFrame:
    rows = silver.flatten(silver.parse(extractions(t), "j"))["administrative_action_targets"]
    return rows.select("event_id", F.col("administrative_action_id").alias("action_id"), "target_kind", F.col("target_entity_id").alias("target"))


@query("SELECT 'p' || l_suppkey AS project_id, count(DISTINCT l_orderkey || ':' || l_linenumber) AS n_actions, count(DISTINCT l_orderkey) AS n_events FROM lineitem GROUP BY 1")
def gold_project_events(t: Tables) -> DataFrame:
    """Orders as events, lines as actions on the supplier's asset, suppliers as projects."""
    lines = t.lineitem.select(F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("event_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("action_id"), F.col("l_suppkey").cast("string").alias("s"))
    asset = F.concat_ws("/", "event_id", "s")
    owned = gold.asset_projects(lines.select(asset.alias("asset_id"), "event_id", F.lit("fv").alias("technology")).distinct(), lines.select(asset.alias("asset_id"), F.concat(F.lit("p"), F.col("s")).alias("project_id")).distinct())
    targets = lines.select("event_id", "action_id", F.lit("generation_asset").alias("target_kind"), asset.alias("target_id")).distinct()
    links = targets.filter("false").select("event_id", F.col("target_id").alias("component_id"), F.col("target_id").alias("asset_id"))
    actions = lines.select("action_id", "event_id").distinct().select("action_id", "event_id", F.lit(1).alias("action_index"), F.lit("a").alias("action_type"), F.lit("d").alias("decision"))
    events = lines.select("event_id").distinct().select("event_id", F.col("event_id").alias("publication_id"), F.lit("2024-01-01").alias("publication_date"), F.lit(1).alias("event_index"))
    facts = gold.project_events(events, actions, targets, links, owned)
    return facts.groupBy("project_id").agg(F.count_distinct("action_id").alias("n_actions"), F.count_distinct("event_id").alias("n_events"))


@query(f"SELECT n_nationkey, 'place_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 15) AS place_id FROM (SELECT n_nationkey, sha1(unhex('{gold.PLACES.hex}') || encode('v1|project:p|level:province|territory:' || n_nationkey)) AS h FROM nation)")
def project_place_ids(t: Tables) -> DataFrame:
    key = F.concat(F.lit("v1|project:p|level:province|territory:"), F.col("n_nationkey").cast("string"))
    return t.nation.select("n_nationkey", F.concat(F.lit("place_"), I.uuid5(uuid.UUID(gold.PLACES.hex), key)).alias("place_id"))


@query("SELECT n_regionkey AS k, n_name AS id, 't' || n_nationkey AS title, r_name AS department_name, CASE WHEN n_regionkey % 2 = 0 THEN 'H' END AS heading FROM nation JOIN region ON n_regionkey = r_regionkey")
def summary_items(t: Tables) -> DataFrame:
    """A daily summary per region, its nations under a heading or straight in a department."""
    from ..sources.readers import summary_items as parse

    item = F.struct(F.col("n_name").alias("identificador"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("titulo"))
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_regionkey", "r_name").agg(F.collect_list(item).alias("items"))
    even = F.col("n_regionkey") % 2 == 0
    department = F.struct(F.col("r_name").alias("nombre"), F.when(~even, F.col("items")).alias("item"), F.when(even, F.struct(F.lit("H").alias("nombre"), F.col("items").alias("item"))).alias("epigrafe"))
    section = F.struct(F.lit("1").alias("codigo"), department.alias("departamento"))
    issue = F.struct(F.lit("7").alias("numero"), F.array(section).alias("seccion"))
    summary = F.struct(F.struct(F.lit("20240102").alias("fecha_publicacion")).alias("metadatos"), issue.alias("diario"))
    payload = F.to_json(F.struct(F.struct(summary.alias("sumario")).alias("data")))
    return parse(rows.select(F.col("n_regionkey").alias("k"), payload.alias("p")), "p").select("k", "id", "title", "department_name", "heading")
