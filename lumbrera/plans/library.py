"""Registered queries of sources, text units, hierarchies, contracts and projects' places."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import contracts as C
from ..operators import corrections as K
from ..operators import filters as P
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import resolve as R
from ..operators import retrieve as V
from ..operators import spans as S
from ..sources import readers, snapshots
from . import evaluation, gold, history, silver
from .catalog import norm
from .documents import extractions
from .registry import Tables, query


def _folder(t: Tables) -> str:
    """A new folder in the shared one; a local session without one has its own."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/library/{uuid.uuid4().hex}"


def _spec(name: str, schema: str, key: tuple[str, ...], *references: C.ForeignKey) -> C.TableSpec:
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}
    return C.TableSpec(name, T.StructType([T.StructField(c, kinds[k]) for c, k in (x.split() for x in schema.split(", "))]), key, references)


_NATION = _spec("nation", "n_nationkey int, n_name string, n_regionkey int", ("n_nationkey",), C.ForeignKey(("n_regionkey",), "region", ("r_regionkey",)))
_REGION = _spec("region", "r_regionkey int, r_name string", ("r_regionkey",))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_round_trip(t: Tables) -> DataFrame:
    """Two tables published together, read back with their manifest and contracts, one of them computed again."""
    path = _folder(t)
    snapshots.publish({"nation": _NATION.cast(t.nation), "region": _REGION.cast(t.region), "large": _REGION.cast(t.region.filter("r_regionkey > 1"))}, path)
    return snapshots.read_recomputed(t.spark, path, {"large": lambda tables: tables["region"].filter("r_regionkey > 1")}, [_NATION, _REGION])["nation"]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def declared_parquet(t: Tables) -> DataFrame:
    """A Parquet file read by its declared schema, an empty typed table added."""
    path = _folder(t)
    _NATION.cast(t.nation).write.parquet(path)
    return readers.parquet(t.spark, path, _NATION).filter("n_regionkey = 1").unionByName(_NATION.empty(t.spark))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_nationkey > 4 THEN c_mktsegment ELSE '' END AS c_mktsegment FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    path = _folder(t)
    t.customer.select("c_custkey", "c_name", F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment")).alias("c_mktsegment")).write.option("header", True).csv(path)
    return readers.text_csv(t.spark, path, ["c_custkey", "c_name", "c_mktsegment"], keep_empty=True)


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders")
def scope_file(t: Tables) -> DataFrame:
    path = _folder(t)
    t.orders.select("o_custkey").distinct().write.parquet(path)
    return readers.scope(t.spark, path, ("id", "o_custkey"))


@query("SELECT r_regionkey AS code, r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def json_directory(t: Tables) -> DataFrame:
    """A JSON file of each region."""
    path = _folder(t)
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name")).agg(F.collect_list("n_name").alias("nations"))
    rows.withColumn("k", F.col("code")).repartition("k").write.partitionBy("k").json(path)
    found = readers.json_files(t.spark, f"{path}/k=*", T._parse_datatype_string("code int, name string, nations array<string>"))
    return found.select("code", "name", F.size("nations").cast("bigint").alias("n"))


@query("SELECT 'D-' || n_nationkey AS id, DATE '2024-01-02' AS day, n_name AS title, n_name || chr(10) || '1 < 2 & é' || chr(10) || 'a | ' || n_regionkey AS text FROM nation")
def xml_text(t: Tables) -> DataFrame:
    """An XML file of each nation, with entities, a quoted section, a comment and a table."""
    path = _folder(t)
    xml = F.concat(
        F.lit("<documento><metadatos><identificador>D-"), F.col("n_nationkey").cast("string"), F.lit("</identificador><fecha_publicacion>20240102</fecha_publicacion><titulo>"), "n_name",
        F.lit("</titulo></metadatos><texto><p>"), "n_name", F.lit("</p><!-- <p>no</p> --><p>1 &lt; <![CDATA[2 &]]> &#233;</p><table><tr><td>a</td><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr></table></texto></documento>"),
    )
    t.nation.select(F.col("n_nationkey").alias("k"), xml.alias("x")).repartition("k").write.partitionBy("k").text(path)
    return readers.xml_documents(t.spark, f"{path}/k=*/*.txt").select("id", "day", "title", "text")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, 'Polygon' AS kind, CAST(n_nationkey AS DOUBLE) AS min_lon, n_nationkey + 2.5 AS max_lon, CAST(-n_regionkey AS DOUBLE) AS min_lat, 1.5 AS max_lat FROM nation")
def geojson_boxes(t: Tables) -> DataFrame:
    path = _folder(t)
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    x, y = F.col("n_nationkey"), -F.col("n_regionkey")
    ring = F.array(corner(x, y), corner(x + 2.5, y), corner(x + 2.5, F.lit(1.5)), corner(x, y))
    feature = F.struct(F.struct(x.cast("string").alias("code"), F.col("n_name").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    t.nation.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("x")).coalesce(1).write.text(path)
    return readers.geojson(t.spark, path).drop("coordinates")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 3")
def one_row(t: Tables) -> DataFrame:
    row = K.one_row(_NATION.cast(t.nation), "n_nationkey", 3)
    return t.spark.createDataFrame([tuple(row[f.name] for f in _NATION.schema)], _NATION.schema)


@query("SELECT n_nationkey, CAST(NULL AS DOUBLE) AS weight, n_name, n_regionkey FROM nation")
def added_columns(t: Tables) -> DataFrame:
    return C.add_missing(t.nation.select("n_nationkey", "n_name", "n_regionkey"), T._parse_datatype_string("n_nationkey int, weight double, n_name string"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1995")
def year_rows(t: Tables) -> DataFrame:
    start, end = P.year_interval(1995)
    return P.between(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", start, end)


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left_many(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.checked_join(t.customer.select("c_custkey"), orders, ["c_custkey"], how="left", validate="1:m")


_TOLD = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"SELECT a.conv_id, a.turn, b.turn AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND contains(b.told, a.told) AND a.told <> ''".replace("conversations", f"(SELECT conv_id, turn, {_TOLD} AS told FROM conversations)"))
def evidence_pairs(t: Tables) -> DataFrame:
    """Turns whose text another turn of the conversation holds, but for white space."""
    facts = t.conversations.filter("trim(text) <> ''").select("conv_id", "turn", F.array("text").alias("fragments"))
    passages = t.conversations.select("conv_id", F.col("turn").alias("other"), F.array(F.replace("text", F.lit(" "), F.lit("  "))).alias("texts"))
    return S.evidence_join(facts, "conv_id", "fragments", passages, "texts").select("conv_id", "turn", "other")


@query("""
SELECT 'lines' AS table_name, 'reference:ref->part:A' AS check_name, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
UNION ALL SELECT 'lines', 'reference:ref->supplier:R', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def polymorphic_references(t: Tables) -> DataFrame:
    """Returned lines refer to suppliers, accepted ones to parts, of which some are left out."""
    ref = F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).otherwise(F.col("l_suppkey"))
    lines = t.lineitem.select(F.monotonically_increasing_id().alias("id"), F.col("l_returnflag").alias("kind"), ref.alias("ref"))
    spec = _spec("lines", "id bigint, kind string, ref bigint", ("id",), C.ForeignKey(("ref",), "part", ("p_partkey",), "kind", "A"), C.ForeignKey(("ref",), "supplier", ("s_suppkey",), "kind", "R"))
    found = C.violations({"lines": lines, "part": t.part.filter("p_size > 10"), "supplier": t.supplier.filter("s_acctbal > 0")}, [spec])
    return found.filter("check_name LIKE 'reference%'").select("table_name", "check_name", "n")


_FIRST = "(SELECT count(*) AS n FROM (SELECT conv_id FROM conversations GROUP BY 1))"


@query(" UNION ALL ".join(f"SELECT '{table}' AS table_name, 'reference:event_id->publication_events' AS check_name, {k} * n AS n FROM {_FIRST}" for table, k in (("generation_asset_mentions", 1), ("generation_asset_names", 2), ("administrative_actions", 1), ("administrative_action_targets", 2))) + f" UNION ALL SELECT 'administrative_action_targets', 'reference:target_entity_id->publication_events:event', n FROM {_FIRST}")
def silver_problems(t: Tables) -> DataFrame:
    """The contracts of the flattened tables once each document's first event is gone."""
    tables = silver.flatten(silver.parse(extractions(t), "j"))
    tables["publication_events"] = tables["publication_events"].filter("event_index > 1")
    return silver.validate(tables).select("table_name", "check_name", "n")


@query("""
SELECT o_orderpriority AS project_id, CASE WHEN c_nationkey % 3 = 0 THEN 'province' ELSE 'autonomous_community' END AS level,
  CASE WHEN c_nationkey % 3 = 0 THEN 'p' || c_nationkey ELSE 'c' || n_regionkey END AS code,
  count(DISTINCT o_custkey) AS n_mentions, count(DISTINCT o_orderkey) AS n_publications, min(o_orderdate) AS first_publication_date, max(o_orderdate) AS last_publication_date
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 3 = 0 OR c_nationkey % 5 <> 0 GROUP BY 1, 2, 3""")
def project_places(t: Tables) -> DataFrame:
    """Orders as events and publications, priorities as projects, customers as mentions at the level of a nation or a region."""
    located = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    status = lambda c: F.when(c, "resolved").otherwise("not_found")
    text, none = (lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))), F.lit(None).cast("string")
    places = located.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("mention_id"), F.lit("not_provided").alias("municipality_status"), none.alias("municipality_code"),
        status(F.col("c_nationkey") % 3 == 0).alias("province_status"), text("p", "c_nationkey").alias("province_code"), status(F.col("c_nationkey") % 5 != 0).alias("community_status"), text("c", "n_regionkey").alias("community_code"),
    )
    owned = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("project_id"))
    events = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("publication_id"), F.col("o_orderdate").alias("publication_date"))
    return gold.project_places(events, places, owned)[0].drop("project_place_id")


@query("""
SELECT c_mktsegment, CASE WHEN c <> '' THEN 'child:' || c WHEN p <> '' THEN 'parent:' || p ELSE 'unresolved' END AS anchor FROM (
  SELECT c_mktsegment, coalesce(string_agg(DISTINCT 'n' || c_nationkey, ',' ORDER BY 'n' || c_nationkey) FILTER (c_acctbal > 9900), '') AS c,
    coalesce(string_agg(DISTINCT 'r' || c_nationkey % 5, ',' ORDER BY 'r' || c_nationkey % 5) FILTER (c_acctbal > 9500), '') AS p FROM customer GROUP BY 1)""")
def geography_anchors(t: Tables) -> DataFrame:
    places = t.customer.select(
        "c_mktsegment", F.when(F.col("c_acctbal") > 9500, "resolved").otherwise("not_found").alias("status"),
        F.when(F.col("c_acctbal") > 9900, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("child_code"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("parent_code"),
    )
    return R.geography_anchor(places, "c_mktsegment")


_MARKED = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS technology FROM d WHERE " + " OR ".join(f"contains(n, '{m}')" for m in marks) for name, marks in history.MARKERS.items())


@query(f"WITH d AS (SELECT doc_id, ' ' || {norm('text')} || ' ' AS n FROM documents) {_MARKED}")
def technology_marks(t: Tables) -> DataFrame:
    return history.marked(t.documents)


@query("""
SELECT c_mktsegment AS project_id, array_to_string(list_sort(list(DISTINCT lower(n_name))), ',') AS aliases, array_to_string(list_sort(list(DISTINCT lower(r_name))), ',') AS locations
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""".replace("lower(n_name)", norm("n_name")).replace("lower(r_name)", norm("r_name")))
def project_signatures(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    mentions = rows.select(F.col("c_mktsegment").alias("project_id"), F.col("n_name").alias("name"), F.col("r_name").alias("location"), F.lit("eolica").alias("technology"))
    return history.signatures(mentions).select("project_id", F.array_join("aliases", ",").alias("aliases"), F.array_join("locations", ",").alias("locations"))


@query("SELECT r_regionkey, count(*) + 1 AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def item_counts(t: Tables) -> DataFrame:
    """Items in a list and, deeper, a single one."""
    rows = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct("n_name")).alias("item"))
    payload = F.to_json(F.struct(F.struct("item", F.struct(F.struct("r_regionkey").alias("item")).alias("inner")).alias("data")))
    return rows.select("r_regionkey", readers.count_items(payload).alias("n"))


@query("""
SELECT tw AS true_warning, fw AS false_warning, m AS missed, q AS quiet, CASE WHEN fw + q > 0 THEN round(fw / (fw + q), 9) END AS false_warning_rate FROM (
  SELECT count(*) FILTER (e AND w) AS tw, count(*) FILTER (NOT e AND w) AS fw, count(*) FILTER (e AND NOT w) AS m, count(*) FILTER (NOT e AND NOT w) AS q
  FROM (SELECT toxic = 1 AS e, n_chars < 800 AS w FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL))""")
def warning_outcomes(t: Tables) -> DataFrame:
    rows = t.labels.filter("toxic IS NOT NULL").join(t.documents.select("doc_id", "n_chars"), "doc_id")
    found = evaluation.warning_outcomes(rows.select((F.col("toxic") == 1).alias("e"), (F.col("n_chars") < 800).alias("w")), "e", "w")
    return found.withColumn("false_warning_rate", F.round("false_warning_rate", 9))


@query("""
SELECT DISTINCT o_custkey AS query, o_orderpriority AS doc, CAST(1 AS INT) AS tier FROM orders WHERE o_orderstatus = 'F'
UNION ALL (SELECT o_custkey, o_orderpriority, 2 FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, o_orderpriority, 2 FROM orders WHERE o_orderstatus = 'F')""")
def two_tiers(t: Tables) -> DataFrame:
    pairs = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("doc")).distinct()
    return V.two_tiers(pairs("F"), pairs("O"))


@query("SELECT p_partkey, list_sort(list_transform(list_filter(string_split(p_type || ' ' || p_name, ' '), lambda w: contains(lower(w), 'e')), lambda w, i: {'n': length(w), 'i': i, 'w': w}))[1].w AS unit FROM part")
def shortest_units(t: Tables) -> DataFrame:
    """The shortest word with an e, of equal ones the first."""
    return t.part.select("p_partkey", S.shortest_unit(F.split(F.concat_ws(" ", "p_type", "p_name"), " "), F.array(F.lit("E"))).alias("unit"))


@query("SELECT doc_id, len(list_distinct(list_filter(list_transform(list_concat(['t'], string_split(text, chr(10))), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS n FROM (SELECT doc_id, regexp_replace(text, '[.;]', '', 'g') AS text FROM documents WHERE text IS NOT NULL)")
def source_units(t: Tables) -> DataFrame:
    """Titles and lines of texts without full stops: a line is its own sentence."""
    rows = t.documents.filter("text IS NOT NULL").withColumn("text", F.regexp_replace("text", "[.;]", ""))
    return rows.select("doc_id", F.size(S.source_units(F.lit("t"), F.col("text"))).cast("bigint").alias("n"))


@query(f"SELECT p_partkey, len(list_filter(string_split({norm('p_name')}, ' '), lambda w: w NOT IN ('small', 'ring', 'large') AND regexp_matches(w, '^[a-z]{{4,}}$'))) > 0 AS usable FROM part")
def usable_aliases(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", V.usable(X.normalize(F.col("p_name")), ["small", "ring", "large"]).alias("usable"))


@query(f"SELECT doc_id, nullif({norm('source')}, '') AS source FROM documents")
def normalized_or_null(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_or_null(F.col("source")).alias("source"))


@query("""
SELECT p_partkey, upper(j[1:1]) || j[2:] AS shown FROM (
  SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: CASE WHEN w IN ('RED', 'GEAR') THEN w WHEN lower(w) IN ('ring', 'bolt') THEN lower(w) WHEN length(w) > 1 THEN w[1:1] || lower(w[2:]) ELSE w END), ' ') AS j FROM part)""")
def display_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.display_case(F.upper("p_name"), ["RED", "GEAR"], ["ring", "bolt"]).alias("shown"))


@query("SELECT o_custkey, min(o_totalprice) AS min_x, max(o_totalprice) AS max_x, min(CAST(o_orderkey AS DOUBLE)) AS min_y, max(CAST(o_orderkey AS DOUBLE)) AS max_y FROM orders GROUP BY 1")
def point_bounds(t: Tables) -> DataFrame:
    points = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_totalprice").alias("x"), F.col("o_orderkey").cast("double").alias("y"))).alias("p"))
    return points.select("o_custkey", G.bounds(F.col("p")).alias("b")).select("o_custkey", "b.*")


@query(f"""
WITH m AS (SELECT s.s_suppkey AS id, s.s_nationkey AS own, (s.s_nationkey + s.s_suppkey % 2) % 25 AS told, s.s_suppkey % 3 = 0 AS silent, s.s_suppkey % 7 = 0 AS unknown FROM supplier s),
r AS (SELECT m.*, a.n_regionkey AS own_region, b.n_regionkey AS told_region FROM m JOIN nation a ON a.n_nationkey = own JOIN nation b ON b.n_nationkey = told)
SELECT id, CASE WHEN NOT unknown THEN id END AS municipality_code, CASE WHEN NOT unknown THEN own WHEN NOT silent THEN told END AS province_code,
  CASE WHEN NOT unknown THEN own_region WHEN NOT silent THEN told_region END AS community_code,
  CASE WHEN NOT unknown THEN CASE WHEN NOT silent AND own <> told THEN 'conflict' ELSE 'resolved' END WHEN NOT silent THEN 'resolved' ELSE 'not_found' END AS status,
  CASE WHEN NOT unknown THEN 'municipality' WHEN NOT silent THEN 'province' END AS level FROM r""")
def location_hierarchy(t: Tables) -> DataFrame:
    """Suppliers as municipalities: every second one says another nation, every third none, every seventh has an unknown name."""
    towns = t.supplier.select(F.col("s_suppkey").cast("int").alias("code"), F.col("s_nationkey").alias("parent"), F.array("s_name").alias("names"))
    provinces = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("parent"), F.array("n_name").alias("names"))
    communities = t.region.select(F.col("r_regionkey").alias("code"), F.lit(None).cast("int").alias("parent"), F.array("r_name").alias("names"))
    told = t.nation.select(F.col("n_nationkey").alias("__told"), "n_name")
    rows = t.supplier.withColumn("__told", (F.col("s_nationkey") + F.col("s_suppkey") % 2) % 25).join(F.broadcast(told), "__told")
    mentions = rows.select(
        F.col("s_suppkey").cast("int").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, "nowhere").otherwise(F.col("s_name")).alias("municipality"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name")).alias("province"), F.lit(None).cast("string").alias("community"),
    )
    return R.resolve_hierarchy(mentions, "id", towns, provinces, communities).select("id", "municipality_code", "province_code", "community_code", "status", "level")
