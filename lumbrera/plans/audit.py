"""Registered queries of the audit views, of values and of identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as W
from ..operators import aggregates as G
from ..operators import audit as A
from ..sources import journal as N
from . import silver, truth
from .catalog import norm
from .documents import extractions
from .registry import Tables, query


@query(f"SELECT CAST(row_number() OVER (ORDER BY {norm('p_type')}, p_type) AS INT) AS place, p_type FROM (SELECT DISTINCT p_type FROM part)")
def observed_values(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.orderBy(*A.display_order(F.col("p_type")))  # over the distinct values of a column
    return A.observed_values(t.part, "p_type").select(F.row_number().over(order).alias("place"), "p_type")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return A.value_counts(t.orders, "o_orderpriority")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def keys_with_several(t: Tables) -> DataFrame:
    return A.with_several(t.orders, ["o_custkey"], "o_orderpriority")


@query("""
SELECT lang, n AS numerator, d AS denominator, CASE WHEN d > 0 THEN round(n / d, 9) END AS share, CASE WHEN d = 0 THEN 'zero_denominator' END AS undefined_reason
FROM (SELECT lang, count(*) FILTER (n_chars > 20000 AND source = 'a') AS n, count(*) FILTER (n_chars > 20000) AS d FROM documents GROUP BY lang)""")
def ratio_with_reason(t: Tables) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    long = F.col("n_chars") > 20000
    sums = t.documents.groupBy("lang").agg(count(long & (F.col("source") == "a")).alias("n"), count(long).alias("d"))
    return sums.select("lang", *A.ratio(F.col("n"), F.col("d"), "share")).withColumn("share", F.round("share", 9))


@query("""
SELECT count(*) AS n_mentions, count(DISTINCT o_custkey) AS n_resolved, count(*) - count(DISTINCT o_custkey) AS n_omitted, sum(n) - count(DISTINCT o_custkey) AS n_expansions
FROM (SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def place_audit(t: Tables) -> DataFrame:
    """Customers as mentions, their orders as links."""
    return A.place_audit(t.customer, "o_custkey", t.orders.select("o_custkey"))


_TRACE = "SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey, n_name, n_regionkey, 'https://x/?id=D-' || o_orderkey AS url FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _trace(t: Tables) -> DataFrame:
    """Orders as sources, customers as places, nations as projects."""
    sources = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    places = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    projects = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    trace = A.territorial_trace(sources, places, projects, "o_custkey", "c_nationkey")
    url = W.document_url(F.concat(F.lit("D-"), F.col("o_orderkey").cast("string")), "https://x/?id=", r"^D-\d+$")
    return trace.select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey", "n_name", "n_regionkey", url.alias("url"))


@query(_TRACE)
def territorial_trace(t: Tables) -> DataFrame:
    return _trace(t)


@query(f"SELECT * FROM ({_TRACE}) WHERE n_name IN ('FRANCE', 'KENYA', 'CHINA') AND n_regionkey IN (0, 3)")
def trace_filter(t: Tables) -> DataFrame:
    return A.audit_rows(_trace(t), ["n_name", "o_custkey", "o_orderdate", "o_orderkey"], n_name=["FRANCE", "KENYA", "CHINA"], n_regionkey=[0, 3], o_custkey=[])


@query("""
SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders
WHERE o_orderstatus IN ('F', 'P') AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'""")
def source_rows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    start, end = (F.lit(d).cast("timestamp") for d in ("1994-01-01", "1996-12-31"))
    return A.audit_rows(rows, ["o_orderdate", "o_custkey", "o_orderkey"], "o_orderdate", start, end, o_orderstatus=["F", "P"], o_custkey=())


@query("""
SELECT o_orderdate, o_orderkey, count(DISTINCT l_partkey) AS n_actions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1, 2""")
def publication_summary(t: Tables) -> DataFrame:
    """Orders as sources, their large lines as actions."""
    sources = t.orders.select("o_orderkey", "o_orderdate")
    actions = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(sources, "o_orderkey")
    return A.publication_summary(actions, sources, "o_orderkey", "o_orderdate", "l_partkey")


_PLACES = "(SELECT p_brand, string_split(p_name, ' ')[1] AS maker, CASE WHEN p_size > 10 THEN p_type END AS p_type, CASE WHEN p_size > 30 THEN 'municipality' ELSE 'province' END AS level, p_name FROM part)"


def _set(column: str, when: str = "true") -> str:
    return f"list_transform(list_sort(coalesce(list(DISTINCT {{'n': {norm(column)}, 'v': {column}}}) FILTER ({column} IS NOT NULL AND ({when})), [])), lambda x: x.v)"


def _places(t: Tables) -> DataFrame:
    """Brands as projects: first words as communities, types as provinces, names as municipalities."""
    level = F.when(F.col("p_size") > 30, "municipality").otherwise("province")
    return t.part.select("p_brand", F.split("p_name", " ")[0].alias("maker"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"), level.alias("level"), "p_name")


@query(f"""
SELECT p_brand, {', '.join(f"array_to_string({c}[1:3], ', ') || CASE WHEN len({c}) > 3 THEN ' y ' || (len({c}) - 3) || ' más' ELSE '' END AS {c}" for c in ('communities', 'provinces', 'municipalities'))}
FROM (SELECT p_brand, {_set('maker')} AS communities, {_set('p_type')} AS provinces, {_set('p_name', "level = 'municipality'")} AS municipalities FROM {_PLACES} GROUP BY 1)""")
def territory_rollup(t: Tables) -> DataFrame:
    town = F.col("level") == "municipality"
    sets = A.catalogue_territories(_places(t), "p_brand", {"communities": ("maker", None), "provinces": ("p_type", None), "municipalities": ("p_name", town)})
    return sets.select("p_brand", *[G.short_list(F.col(c)).alias(c) for c in ("communities", "provinces", "municipalities")])


_TOWN, _IN_PROVINCE = "level = 'municipality' AND p_name IS NOT NULL", "p_type IS NOT NULL"
_SETS = {"communities": ("maker", "true"), "provinces": ("p_type", _IN_PROVINCE), "province_communities": ("maker", _IN_PROVINCE), "municipalities": ("p_name", _TOWN), "municipality_provinces": ("p_type", _TOWN), "municipality_communities": ("maker", _TOWN)}


@query("SELECT p_brand, " + ", ".join(f"array_to_string({_set(c, w)}, ';') AS {name}" for name, (c, w) in _SETS.items()) + f" FROM {_PLACES} GROUP BY 1")
def identity_sets(t: Tables) -> DataFrame:
    places = _places(t)
    found = A.identity_sets(places.select("p_brand").distinct(), places, "p_brand", "maker", "p_type", "p_name", "level")
    return found.select("p_brand", *[F.array_join(c, ";").alias(c) for c in _SETS])


@query(f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY {norm('p_name')}, {norm('CAST(p_partkey AS VARCHAR)')}) AS INT) AS place FROM part")
def catalogue_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    name, key = A.display_order(F.col("p_name"))[0], A.display_order(F.col("p_partkey").cast("string"))[0]
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(name, key)).alias("place"))


@query(f"""
SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 WHEN 'AFRICA' THEN 2 ELSE 3 END, {norm('n_name')}, n_nationkey) AS INT) AS place
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def level_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    order = Window.orderBy(*A.level_order(F.col("r_name"), F.col("n_name"), ["EUROPE", "ASIA", "AFRICA"]), "n_nationkey")  # 25 rows
    return named.select("n_nationkey", F.row_number().over(order).alias("place"))


_ATTEMPTS = "(SELECT event_id, user_id, event_type, ts, CASE WHEN value >= 20 THEN 'passed' WHEN value >= 5 THEN 'failed' END AS status FROM events)"
_CURRENT = "(SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) >= 2)"


def _attempts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events as attempts of users on sources (kinds of event), of which those tried twice are current."""
    status = F.when(F.col("value") >= 20, "passed").when(F.col("value") >= 5, "failed")
    current = t.events.groupBy("user_id", "event_type").count().filter("count >= 2")
    return t.events.select("event_id", "user_id", "event_type", "ts", status.alias("status")), current


@query(f"SELECT a.* FROM {_ATTEMPTS} a JOIN {_CURRENT} c ON a.user_id = c.user_id AND a.event_type = c.event_type")
def current_sources(t: Tables) -> DataFrame:
    attempts, current = _attempts(t)
    return A.current_sources(attempts, current, ["user_id", "event_type"])


@query(f"""
SELECT event_id, user_id, event_type, ts, status FROM (
  SELECT a.*, row_number() OVER (PARTITION BY a.user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM {_ATTEMPTS} a JOIN {_CURRENT} c ON a.user_id = c.user_id AND a.event_type = c.event_type WHERE status = 'passed' AND a.event_type <> 'error') WHERE rn = 1""")
def decisive_successes(t: Tables) -> DataFrame:
    attempts, current = _attempts(t)
    rows = A.decisive_successes(attempts.filter("event_type <> 'error'"), current, ["user_id", "event_type"], "user_id", ["ts", "event_id"], status="passed")
    return rows.select("event_id", "user_id", "event_type", "ts", "status")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def valid_documents(t: Tables) -> DataFrame:
    return A.valid_documents(t.documents, "lang", "text", "en").select("doc_id", "lang")


_LINES = "(SELECT l_orderkey, l_orderkey || '_line_' || l_linenumber AS id FROM lineitem WHERE l_quantity > 8)"


@query(f"""
SELECT l_orderkey, count(*) AS n FROM {_LINES} GROUP BY 1
HAVING list_sort(list(DISTINCT id)) <> list_sort(list_transform(range(1, count(*) + 1), lambda k: l_orderkey || '_line_' || k))""")
def misnumbered_ids(t: Tables) -> DataFrame:
    """Orders whose lines aren't numbered without a gap once small lines are left out."""
    ids = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string"))
    return A.misnumbered(t.lineitem.filter("l_quantity > 8").select("l_orderkey", ids.alias("id")), "l_orderkey", "id", "line")


_ROW = "'{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey || '}'"


@query(f"SELECT {_ROW} AS row FROM customer WHERE c_acctbal < 0 AND {_ROW} NOT IN (SELECT {_ROW} FROM customer WHERE c_acctbal > 9000)")
def rows_not_in(t: Tables) -> DataFrame:
    pairs = lambda where: t.customer.filter(where).select("c_nationkey", "c_mktsegment")
    return A.not_in(pairs("c_acctbal < 0"), pairs("c_acctbal > 9000"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def corrections_within(t: Tables) -> DataFrame:
    return A.corrections_within(t.labels.select("doc_id", "quality"), t.documents.filter("lang = 'fr'"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem")
def safe_dates(t: Tables) -> DataFrame:
    """Ship dates as text, small lines' with a letter in them."""
    told = F.concat(F.when(F.col("l_quantity") > 25, "").otherwise("x"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return t.lineitem.select("l_orderkey", "l_linenumber", W.date_or_null(told).alias("day"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) SIMILAR TO '[0-9]{3}' AS three FROM customer")
def exact_codes(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", W.exact_code(F.col("c_custkey"), 3).alias("three"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_D-' || o_orderkey AS stem FROM orders")
def document_stems(t: Tables) -> DataFrame:
    id_ = F.concat(F.lit("D-"), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", W.document_stem(id_, F.col("o_orderdate"), r"^D-\d+$").alias("stem"))


@query("""
SELECT l_orderkey, array_to_string(list_transform(list_sort(list({'k': k, 'n': n, 'r': r})), lambda x: x.r), ',') AS refs FROM (
  SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS k, l_linenumber * 7 % 12 AS n,
    CASE l_returnflag WHEN 'A' THEN 'generation_asset_' ELSE 'component_' END || (l_linenumber * 7 % 12) AS r FROM lineitem
  UNION SELECT DISTINCT l_orderkey, 0, 0, 'event' FROM lineitem) GROUP BY 1""")
def sorted_refs(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "generation_asset").otherwise("component")
    ref = F.concat_ws("_", kind, (F.col("l_linenumber") * 7 % 12).cast("string"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(ref).alias("refs"))
    return rows.select("l_orderkey", F.array_join(W.sorted_refs(F.concat("refs", F.array(F.lit("event")), "refs")), ",").alias("refs"))


@query("SELECT s_suppkey, CASE WHEN upper(s_name) = s_name THEN s_name || '|x' ELSE s_name || '|x' END AS names FROM supplier")
def folded_names(t: Tables) -> DataFrame:
    given = F.array("s_name", F.upper("s_name"), F.lit("x"), F.concat(F.lit("  "), F.lower("s_name")), F.lit("X "))
    return t.supplier.select("s_suppkey", F.array_join(W.distinct_folded(given), "|").alias("names"))


@query("""
SELECT c_custkey, '{"a":{"x":' || c_nationkey || ',"z":"' || c_mktsegment || '"},"b":[' || c_custkey || '],"n":null}' AS j FROM customer""")
def canonical_json(t: Tables) -> DataFrame:
    inner = F.struct(F.col("c_mktsegment").alias("z"), F.col("c_nationkey").alias("x"))
    rows = t.customer.select("c_custkey", F.struct(F.lit(None).cast("string").alias("n"), F.array("c_custkey").alias("b"), inner.alias("a")).alias("s"))
    kind = rows.schema["s"].dataType
    assert isinstance(kind, T.StructType)
    return rows.select("c_custkey", W.canonical_json(F.col("s"), kind).alias("j"))


@query("SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name FROM documents WHERE text IS NOT NULL")
def identity_names(t: Tables) -> DataFrame:
    return t.documents.filter("text IS NOT NULL").select("doc_id", W.identity_name(F.col("text")).alias("name"))


_ENTRIES = "(SELECT user_id, ts, event_id, event_id || ':' || event_type AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_id || ':' || event_type) AS seq FROM events)"


def _journal(t: Tables) -> DataFrame:
    entries = t.events.select("user_id", "ts", "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("body"))
    return N.chained(entries, ["user_id"], ["ts", "event_id"], "body")


@query(f"""
WITH RECURSIVE e AS {_ENTRIES}, c AS (
  SELECT user_id, seq, sha256('|' || body) AS own FROM e WHERE seq = 1
  UNION ALL SELECT e.user_id, e.seq, sha256(c.own || '|' || e.body) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
SELECT user_id, CAST(max(seq) AS INT) AS seq, arg_max(own, seq) AS own FROM c GROUP BY 1""")
def journal_heads(t: Tables) -> DataFrame:
    """A journal of each user's events: its length and last digest."""
    return N.heads(_journal(t), ["user_id"])


@query(f"SELECT user_id, CAST(seq AS INT) AS seq, 'digest' AS problems FROM {_ENTRIES} WHERE body LIKE '%:error'")
def journal_problems(t: Tables) -> DataFrame:
    """The same journals with the bodies of errors rewritten."""
    forged = _journal(t).withColumn("body", F.when(F.col("body").endswith(":error"), "forged").otherwise(F.col("body")))
    return N.problems(forged, ["user_id"]).select("user_id", "seq", F.array_join("problems", ",").alias("problems"))


@query("""
WITH l AS (SELECT *, l_quantity > 3 AND count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS scored FROM lineitem),
a AS (SELECT DISTINCT l_orderkey, l_returnflag FROM l),
r AS (SELECT a.l_orderkey, a.l_returnflag, l.l_linenumber, l.scored FROM a JOIN l USING (l_orderkey)
  WHERE l.l_returnflag = a.l_returnflag OR EXISTS (SELECT 1 FROM l x WHERE x.l_orderkey = a.l_orderkey AND x.l_returnflag = a.l_returnflag AND x.l_linestatus = 'F'))
SELECT l_orderkey AS doc, l_returnflag AS action, bool_and(scored) AS complete,
  CASE WHEN bool_and(scored) THEN string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) ELSE '' END AS affected FROM r GROUP BY 1, 2""")
def affected_assets(t: Tables) -> DataFrame:
    """Lines as assets, return flags as actions on their open lines, or on the whole order where one is finished."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.lit("e").alias("event"), F.col("l_linenumber").cast("string").alias("asset"), (F.col("l_quantity") > 3).alias("scored"), F.col("l_returnflag").alias("action"), "l_linestatus")
    whole = F.col("l_linestatus") == "F"
    targets = lines.select("doc", "action", F.when(whole, "event").otherwise("generation_asset").alias("kind"), F.when(whole, "e").otherwise(F.col("asset")).alias("target"), F.lit(True).alias("scored")).distinct()
    actions = lines.select("doc", "event", "action", F.lit(True).alias("scored")).distinct()
    components = lines.filter("false").select("doc", F.col("asset").alias("component"), F.array("asset").alias("related"), "scored")
    found = truth.affected_assets(actions, targets, lines.select("doc", "event", "asset", "scored"), components)
    return found.select("doc", "action", "complete", F.array_join("affected", ",").alias("affected"))


_LARGE = "(SELECT CAST(l_orderkey AS VARCHAR) AS d, CAST(l_linenumber AS VARCHAR) AS k, l_discount, l_tax, l_returnflag FROM lineitem WHERE l_quantity > 45)"
_SCORED = "(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)"


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS doc, NULL AS key, 'draft document' AS problem FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'no event' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT * FROM {_SCORED})
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'unexpected event' FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IN (SELECT * FROM {_SCORED})
UNION ALL SELECT d, k, 'no asset' FROM {_LARGE} WHERE (d, k) NOT IN (SELECT (d, k) FROM {_LARGE} WHERE l_discount > 0.02)
UNION ALL SELECT d, k, 'no action' FROM {_LARGE} WHERE (d, k) NOT IN (SELECT (d, k) FROM {_LARGE} WHERE l_tax > 0.02)
UNION ALL SELECT d, k, 'no evidence' FROM {_LARGE} WHERE l_tax > 0.02 AND (d, k) NOT IN (SELECT (d, k) FROM {_LARGE} WHERE l_tax > 0.02 AND l_returnflag <> 'R')""")
def truth_problems(t: Tables) -> DataFrame:
    """Orders as documents, their large lines as events with an asset if discounted, an action if taxed, and evidence if not returned."""
    documents = t.orders.select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("complete").alias("status"), (F.col("o_orderstatus") == "F").alias("specific"))
    lines = t.lineitem.filter("l_quantity > 45").withColumnsRenamed({"l_orderkey": "doc", "l_linenumber": "event"})
    assets = lines.filter("l_discount > 0.02").select("doc", "event", F.col("event").alias("asset"))
    actions = lines.filter("l_tax > 0.02").select("doc", "event", F.col("event").alias("action"), "l_returnflag")
    evidence = actions.filter("l_returnflag <> 'R'").select("doc", F.col("action").alias("owner"))
    return truth.truth_problems(documents, lines.select("doc", "event"), assets, actions.drop("l_returnflag"), evidence)


_EVENT = "(SELECT 'D' || conv_id || '|pred_event_' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS event_key FROM conversations)"


@query(f"""
SELECT 'events' AS "table", event_key AS key, event_key FROM {_EVENT} UNION ALL SELECT 'generation_assets', event_key || ':generation_asset_1', event_key FROM {_EVENT}
UNION ALL SELECT 'administrative_actions', event_key || ':action_1', event_key FROM {_EVENT}""")
def prediction_keys(t: Tables) -> DataFrame:
    found = truth.predictions(silver.parse(extractions(t), "j"))
    assert found.columns == ["table", "key", "event_key", "value"]
    return found.select("table", "key", "event_key")
