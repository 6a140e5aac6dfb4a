"""Names, joins, sets, contracts and resolution over the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids as I
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import contracts as C
from ..operators import joins as J
from ..operators import latest as L
from ..operators import matching as M
from ..operators import nest as N
from ..operators import resolve as R
from ..operators import retrieve as V
from ..operators import sets as S
from .registry import Tables, query

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def norm(c: str) -> str:
    """Normalised text in DuckDB."""
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {norm('text')} AS n FROM documents")
def text_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize(F.col("text")).alias("n"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({norm('text')}, 'idiot|clown|thand|mentre')")
def keyword_filter(t: Tables) -> DataFrame:
    return t.documents.filter(X.any_keyword(F.col("text"), ["idiot", "clown", "thand", "mentre"])).select("doc_id")


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS tidy FROM conversations")
def clean_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.clean(F.col("text")).alias("tidy"))


@query(f"""
SELECT a.p_partkey, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(a.w) ELSE 0 END, 6) AS score
FROM (SELECT p_partkey, list_filter(list_distinct(string_split({norm('p_name')}, ' ')), lambda x: x NOT IN ('', 'small')) AS w FROM part) a
JOIN (SELECT p_partkey, list_filter(list_distinct(string_split({norm("p_name || ' ' || p_type")}, ' ')), lambda x: x NOT IN ('', 'small', 'ring')) AS w FROM part) b USING (p_partkey)""")
def token_overlap(t: Tables) -> DataFrame:
    query_, other = X.tokens(F.col("p_name"), ["small"]), X.tokens(F.concat_ws(" ", "p_name", "p_type"), ["small", "ring"])
    return t.part.select("p_partkey", F.round(X.overlap(query_, other), 6).alias("score"))


@query(f"SELECT p_partkey, coalesce(nullif(regexp_replace({norm('p_name')}, '^(?:(?:small|large|red)(?: |$))+', ''), ''), {norm('p_name')}) AS name FROM part")
def distinctive_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.without_leading(F.col("p_name"), ["small", "large", "red"]).alias("name"))


@query(f"""
SELECT p_brand, (list(p_name ORDER BY -len(string_split(p_name, ' ')), -length(p_name), {norm('p_name')}, p_name))[1] AS display,
  string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS names FROM part GROUP BY 1""")
def project_catalog(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(A.display_name(F.col("p_name")).alias("display"), A.joined_values(F.col("p_name")).alias("names"))


@query("""
SELECT p_brand, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ' y ' || (len(v) - 3) || ' más' ELSE '' END AS short
FROM (SELECT p_brand, list_sort(list_distinct(list(p_type))) AS v FROM part GROUP BY 1)""")
def short_list(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("v")).select("p_brand", A.short_list(F.col("v")).alias("short"))


@query("""
SELECT p_brand, array_to_string(CASE WHEN len(big) > 0 THEN big ELSE every END, ',') AS shown FROM (
  SELECT p_brand, list_sort(coalesce(list_distinct(list(p_type) FILTER (p_size > 49)), [])) AS big, list_sort(list_distinct(list(p_type))) AS every FROM part GROUP BY 1)""")
def fallback_summary(t: Tables) -> DataFrame:
    sets = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set(F.when(F.col("p_size") > 49, F.col("p_type")))).alias("big"), F.array_sort(F.collect_set("p_type")).alias("every"))
    return sets.select("p_brand", F.array_join(A.first_filled(F.col("big"), F.col("every")), ",").alias("shown"))


@query("""
SELECT l_returnflag AS kind, l_orderkey AS fact, CAST(o_custkey AS BIGINT) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'
UNION SELECT l_returnflag, l_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N'
UNION SELECT l_returnflag, l_orderkey, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'""")
def polymorphic_attribution(t: Tables) -> DataFrame:
    facts = t.lineitem.select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("fact"), "l_partkey", "l_suppkey")
    branches = {
        "A": (t.orders.select("o_orderkey", F.col("o_custkey").alias("target")), F.col("fact") == F.col("o_orderkey")),
        "N": (t.part.select(F.col("p_partkey").alias("target")), F.col("l_partkey") == F.col("target")),
        "R": (t.supplier.select(F.col("s_suppkey").alias("target")), F.col("l_suppkey") == F.col("target")),
    }
    return J.polymorphic_join(facts, "kind", branches, ["kind", "fact", "target"])


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def checked_join_many_to_one(t: Tables) -> DataFrame:
    return J.checked_join(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation, ["n_nationkey"], validate="m:1").select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def checked_join_one_to_one(t: Tables) -> DataFrame:
    return J.checked_join(t.customer.select("c_custkey", "c_name"), t.customer.select("c_custkey", "c_acctbal"), ["c_custkey"], validate="1:1", same_keys=True)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_pending(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_scope(t: Tables) -> DataFrame:
    scope = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(scope, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS matched FROM orders")
def indicator_join(t: Tables) -> DataFrame:
    return J.with_indicator(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("""
SELECT doc_id, coalesce(quality, CAST(n_chars > 1000 AS INT)) AS quality, CASE WHEN quality IS NULL THEN 'auto' ELSE 'manual' END AS origin
FROM documents LEFT JOIN labels USING (doc_id)""")
def best_selection(t: Tables) -> DataFrame:
    manual = t.labels.select("doc_id", "quality", F.lit("manual").alias("origin"), F.lit(0).alias("at"))
    auto = t.documents.select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"), F.lit("auto").alias("origin"), F.lit(0).alias("at"))
    return L.best_by_precedence(manual.unionByName(auto), ["doc_id"], "origin", ["manual", "auto"], ["at"]).select("doc_id", "quality", "origin")


@query("""
SELECT doc_id, quality, 'manual' AS origin FROM labels UNION ALL
SELECT doc_id, 1, 'auto' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def precedence_anti(t: Tables) -> DataFrame:
    return J.prefer(t.labels.select("doc_id", "quality", F.lit("manual").alias("origin")), t.documents.select("doc_id", F.lit(1).alias("quality"), F.lit("auto").alias("origin")), ["doc_id"])


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST) AS rn FROM conversations) WHERE rn = 1")
def latest_attempt(t: Tables) -> DataFrame:
    return L.latest_per_key(t.conversations, ["conv_id"], ["turn"])


@query("SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem WHERE (l_suppkey, l_shipdate) IN (SELECT (l_suppkey, max(l_shipdate)) FROM lineitem GROUP BY l_suppkey) GROUP BY 1, 2 HAVING count(*) > 1")
def latest_ties(t: Tables) -> DataFrame:
    return L.with_ties(t.lineitem, ["l_suppkey"], "l_shipdate").select("l_suppkey", "l_shipdate", "n")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 8 GROUP BY 1 HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*))")
def index_check(t: Tables) -> DataFrame:
    """Orders whose lines aren't 1 to n once small lines are left out."""
    return L.broken_sequences(t.lineitem.filter("l_quantity > 8"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "n")


_HASH = "sha256('s1|' || CAST(doc_id AS VARCHAR))"


@query(f"SELECT doc_id, lang, sample_rank FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY {_HASH}, doc_id) AS INT) AS sample_rank FROM documents) WHERE sample_rank <= 8")
def stratified_hash_sample(t: Tables) -> DataFrame:
    return L.stratified_sample(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 8, "s1").select("doc_id", "lang", "sample_rank")


@query(f"SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY {_HASH}, doc_id) - 1) / 250) + 1 AS INT) AS batch FROM documents")
def hash_batches(t: Tables) -> DataFrame:
    return L.hash_batches(t.documents.select("doc_id"), "doc_id", 250, "s1").select("doc_id", "batch")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50")
def round_robin_sample(t: Tables) -> DataFrame:
    return L.round_robin(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 50).select("doc_id", "lang")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_id - 1")
def hash_chain(t: Tables) -> DataFrame:
    journal = t.events.select("user_id", "event_id", F.struct("ts", "event_id").alias("seq"), (F.col("event_id") - 1).alias("previous"))
    return L.broken_chain(journal, ["user_id"], "seq", "previous", "event_id").select("user_id", "event_id")


@query("SELECT c_custkey, CASE WHEN a AND b THEN 'contradiction' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'none' END AS registry FROM (SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS a, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS b FROM customer)")
def registry_match(t: Tables) -> DataFrame:
    first = t.supplier.filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    second = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.two_registries(t.customer.select("c_custkey", "c_nationkey"), first, ["c_nationkey"], second, ["c_custkey"]).select("c_custkey", "registry")


@query("SELECT n_nationkey, n_name, CAST(position AS INT) AS position, n_name IS NOT NULL AS found FROM (VALUES ('NATION_3', 0), ('NATION_1', 1), ('NOWHERE', 2)) v(want, position) LEFT JOIN nation ON n_name = want")
def ordered_subset(t: Tables) -> DataFrame:
    rows = J.ordered_subset(t.nation, "n_name", ["NATION_3", "NATION_1", "NOWHERE"])
    return rows.select("n_nationkey", F.when(F.col("found"), F.col("n_name")).alias("n_name"), "position", "found")


@query(f"SELECT DISTINCT a.s_suppkey AS one, b.c_custkey AS other FROM supplier a JOIN customer b ON {norm('a.s_name')} = replace({norm('b.c_name')}, 'customer', 'supplier')")
def alias_overlap(t: Tables) -> DataFrame:
    left = t.supplier.select(F.col("s_suppkey").alias("one"), F.array("s_name").alias("n"))
    right = t.customer.select(F.col("c_custkey").alias("other"), F.array("c_name", F.regexp_replace("c_name", "Customer", "SUPPLIER")).alias("m"))
    return J.alias_overlap(left, "one", "n", right, "other", "m")


_GIVEN = "(SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders WHERE {} GROUP BY 1)"


@query(f"SELECT a.k AS one, b.k AS other FROM {_GIVEN.format("o_orderstatus = 'F'")} a JOIN {_GIVEN.format("o_orderstatus <> 'F'")} b ON a.s = b.s AND a.k = b.k")
def set_equality(t: Tables) -> DataFrame:
    """Customers whose finished and other orders have the same priorities."""
    given = lambda where, name: t.orders.filter(where).select(F.col("o_custkey").alias(name), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("item"))
    return J.set_equality(given("o_orderstatus = 'F'", "one"), "one", given("o_orderstatus <> 'F'", "other"), "other", "item")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000")
def scope_union(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return S.union_distinct(rows.filter("c_mktsegment = 'BUILDING'"), rows.filter("c_acctbal > 5000")).select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 2")
def snapshot_union_disjoint(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey")
    return S.disjoint_union(rows.filter("o_orderkey % 3 = 0"), rows.filter("o_orderkey % 3 = 1"), ["o_orderkey"])


@query("SELECT r_regionkey AS k, r_name AS name, CAST(NULL AS INTEGER) AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def schema_evolving_union(t: Tables) -> DataFrame:
    return S.evolving_union(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent")))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'added' WHEN n_nationkey >= 20 THEN 'removed' WHEN n_nationkey % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM nation")
def dimension_diff(t: Tables) -> DataFrame:
    old = t.nation.filter("n_nationkey >= 5")
    new = t.nation.filter("n_nationkey < 20").withColumn("n_name", F.when(F.col("n_nationkey") % 7 == 0, F.lit("x")).otherwise(F.col("n_name")))
    return S.key_diff(old, new, ["n_nationkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS surplus FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1, 2")
def frame_diff(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    return S.row_differences(rows, rows.filter("l_orderkey % 10 <> 0"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'appended' WHEN p_partkey % 4 = 1 THEN 'collision' ELSE 'reused' END AS outcome FROM part")
def reuse_or_append(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_size")
    known = rows.filter("p_partkey % 4 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 4 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return S.reuse_or_append(known, rows, "p_partkey").select("p_partkey", "outcome")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS status FROM documents")
def append_log(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id")
    return S.append_log(rows.withColumn("status", F.lit("old")), rows.filter("doc_id % 5 = 0").withColumn("status", F.lit("new")), "doc_id")


_UUID = "substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 15)"


@query(f"SELECT p_partkey, 'project_' || {_UUID} AS project_id FROM (SELECT p_partkey, sha1(unhex('{NAMESPACE.hex}') || encode('v1|' || p_name)) AS h FROM part)")
def stable_project_id(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("project_"), I.uuid5(NAMESPACE, F.concat(F.lit("v1|"), F.col("p_name")))).alias("project_id"))


@query(f"""
SELECT p_partkey, 'project_' || {_UUID} AS project_id FROM (
  SELECT p_partkey, sha1(unhex('{NAMESPACE.hex}') || encode('v1|' || {norm('p_name')} || '|' || p_type || '|' || p_brand)) AS h FROM part)""")
def grouping(t: Tables) -> DataFrame:
    return R.group_projects(t.part, "p_partkey", "p_name", "p_type", "p_brand", NAMESPACE).select("p_partkey", "project_id")


@query("""
WITH m AS (SELECT p_type, count(DISTINCT p_partkey) AS members FROM part GROUP BY 1), c AS (SELECT p_type, p_brand, count(DISTINCT p_partkey) AS h FROM part GROUP BY 1, 2)
SELECT p_type, members, CASE WHEN members = 1 THEN 'singleton' WHEN max(h) = members THEN 'shared_name' ELSE 'variant' END AS method FROM m JOIN c USING (p_type) GROUP BY 1, 2""")
def match_method(t: Tables) -> DataFrame:
    return A.match_method(t.part, "p_type", "p_partkey", "p_brand")


@query("SELECT doc_id, sha256(concat_ws(chr(10), CAST(doc_id AS VARCHAR), lang, text)) AS document_hash FROM documents")
def document_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", I.document_hash(F.col("doc_id").cast("string"), F.col("lang"), F.col("text")).alias("document_hash"))


@query("SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code FROM nation")
def padded_codes(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", X.padded_code(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(".0")), 3).alias("code"))


@query("SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) AS label FROM part")
def label_fallback(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.label(F.col("p_type"), {}).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN CAST(p_size AS DECIMAL(38, 6)) / 1000 ELSE CAST(p_size AS DECIMAL(38, 6)) END AS mw FROM part")
def power_parse(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    told = F.when(F.col("p_size") % 5 == 0, F.concat(size, F.lit(" MW y 3 MW"))).when(F.col("p_size") % 3 == 0, F.concat(F.lit("de "), size, F.lit(",0 kW"))).otherwise(F.concat(size, F.lit(" MW")))
    return t.part.select("p_partkey", X.single_power(told).alias("mw"))


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS band FROM documents")
def length_band(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long").alias("band"))


_PAGES = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_PAGES} AS body FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return t.pages.select("page_id", X.clean(bare).alias("body"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _nested(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return t.conversations.groupBy(F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("doc")).agg(turns.alias("turns"))


@query("SELECT 'C' || conv_id AS doc, 'C' || conv_id || '_turn_' || p AS turn_id, CAST(p AS INT) AS turn_index, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations)")
def json_flatten(t: Tables) -> DataFrame:
    return N.flatten(_nested(t), "doc", "turns", "turn", ["role", "text"])


@query("SELECT 'C' || conv_id AS doc, CAST(count(*) AS INT) AS n, CAST(sum(len(string_split(text, ' '))) AS INT) AS words FROM conversations GROUP BY 1")
def nested_counts(t: Tables) -> DataFrame:
    rows = _nested(t).withColumn("turns", F.transform("turns", lambda e: F.struct(e["role"].alias("role"), F.split(e["text"], " ", -1).alias("words"))))
    return rows.select("doc", F.size("turns").alias("n"), N.count_nodes(F.col("turns"), "words").alias("words"))


@query("SELECT 'C' || conv_id AS doc, CAST(count(*) FILTER (turn <> 0) AS INT) AS n, count(*) FILTER (turn <> 0) = 0 AS emptied FROM conversations GROUP BY 1")
def nested_delete(t: Tables) -> DataFrame:
    targets = t.conversations.select(F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("doc"), F.lit("0").alias("id")).distinct()
    return N.delete_nested(_nested(t), "doc", "turns", "turn", targets).select("doc", F.size("turns").alias("n"), "emptied")


_ISSUES = "array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'shouts' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {_ISSUES} AS issues FROM documents")
def document_issues(t: Tables) -> DataFrame:
    found = N.issues(short=F.col("n_chars") < 100, shouts=F.contains("text", F.lit("!!")), foreign=F.col("lang") != "en")
    return t.documents.select("doc_id", F.array_join(found, ",").alias("issues"))


def _mentions(t: Tables) -> DataFrame:
    known = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    child = F.when(F.col("c_custkey") % 5 == 0, F.lower(F.replace("n_name", F.lit("_"), F.lit("  ")))).when(F.col("c_custkey") % 5 == 1, "nowhere").when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("LAND "), F.replace("n_name", F.lit("_"), F.lit(" ")))).otherwise(F.col("n_name"))
    parent = F.when(F.col("c_custkey") % 7 == 0, "EUROPE").when(F.col("c_custkey") % 7 == 1, "").otherwise(F.initcap("r_name"))
    return known.select("c_custkey", child.alias("child"), parent.alias("parent"))


@query("""
WITH m AS (SELECT c_custkey, n_nationkey, n_regionkey, r_regionkey, CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE n_nationkey END AS child,
  CASE WHEN c_custkey % 7 = 0 THEN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') WHEN c_custkey % 7 = 1 THEN NULL ELSE r_regionkey END AS told
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, CAST(child AS INT) AS child_code, CAST(CASE WHEN child IS NULL THEN told ELSE n_regionkey END AS INT) AS parent_code,
  CASE WHEN child IS NOT NULL AND told IS NOT NULL AND told <> n_regionkey THEN 'conflict' WHEN child IS NULL AND told IS NULL THEN 'not_found' ELSE 'resolved' END AS status FROM m""")
def location_resolution(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("parent"), X.name_variants(F.col("n_name")).alias("names"))
    regions = t.region.select(F.col("r_regionkey").alias("code"), F.lit(None).cast("int").alias("parent"), F.array("r_name").alias("names"))
    return R.resolve_places(_mentions(t), "c_custkey", "child", "parent", nations, regions, stop=["land"]).select("c_custkey", "child_code", "parent_code", "status")


@query(f"""
WITH q AS (SELECT item_id, {norm('text')} AS p FROM benchmark),
d AS (SELECT doc_id, ' ' || {norm('text')} || ' ' AS n FROM documents),
f AS (SELECT DISTINCT item_id AS query, p, doc_id AS doc FROM q JOIN d ON contains(n, ' ' || p || ' ')),
few AS (SELECT p FROM f GROUP BY p HAVING count(DISTINCT doc) <= greatest(10, ceil(0.0005 * (SELECT count(*) FROM documents))))
SELECT DISTINCT query, doc FROM f WHERE p IN (SELECT p FROM few)""")
def history_tier1(t: Tables) -> DataFrame:
    return V.phrase_matches(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")


@query(f"""
WITH q AS (SELECT item_id AS query, list_filter(list_distinct(string_split({norm('text')}, ' ')), lambda x: length(x) >= 2 AND x NOT IN ('the', 'de')) AS w FROM benchmark),
d AS (SELECT doc_id AS doc, string_split({norm('text')}, ' ') AS w FROM documents)
SELECT query, doc FROM q JOIN d ON list_has_all(d.w, q.w) WHERE len(q.w) >= 2""")
def history_tier2(t: Tables) -> DataFrame:
    return V.word_matches(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", generic=["the", "de"])


@query("""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' WHEN quality IS NULL AND n_chars > 5000 THEN 'long_unlabelled' END AS reason,
  'queue_' || substr(sha256('doc|' || doc_id), 1, 16) AS queue_id FROM documents LEFT JOIN labels USING (doc_id)
WHERE toxic = 1 OR quality = 0 OR (quality IS NULL AND n_chars > 5000)""")
def review_queue(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    reason = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when(F.col("quality").isNull() & (F.col("n_chars") > 5000), "long_unlabelled")
    return rows.select("doc_id", reason.alias("reason"), I.text_id("queue_", F.lit("doc"), F.col("doc_id").cast("string")).alias("queue_id")).filter("reason is not null")


_METRICS = "SELECT count(*) FILTER (quality = 1 AND p) AS tp, count(*) FILTER (quality <> 1 AND p) AS fp, count(*) FILTER (quality = 1 AND NOT p) AS fn FROM (SELECT quality, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id))"


@query(f"SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM ({_METRICS})")
def micro_prf(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    found = A.micro_metrics(rows, F.col("quality") == 1, F.col("n_chars") > 800)
    return found.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT lang AS expected, count(*) FILTER (g = 'en') AS en, count(*) FILTER (g = 'xx') AS xx, count(*) FILTER (g IS NULL) AS missing FROM (SELECT lang, CASE WHEN contains(text, ' the ') THEN 'en' WHEN n_chars > 1000 THEN 'xx' END AS g FROM documents) GROUP BY 1")
def confusion_matrix(t: Tables) -> DataFrame:
    guess = F.when(F.contains("text", F.lit(" the ")), "en").when(F.col("n_chars") > 1000, "xx")
    return A.confusion(t.documents.select(F.col("lang").alias("expected"), guess.alias("g")), "expected", "g", ["en", "xx"])


_COLUMNS = (("c_custkey", "bigint", "key"), ("c_name", "string", "value"), ("c_nationkey", "int", "value"), ("c_acctbal", "double", "value"), ("c_mktsegment", "string", "value"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, '{r}' AS role FROM customer" for c, k, r in _COLUMNS))
def column_profile(t: Tables) -> DataFrame:
    return A.column_profile(t.customer, ["c_custkey"])


@query("SELECT 'lineitem' AS table_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS n_repeated_key_rows, CAST(0 AS BIGINT) AS n_nulls, min(a) AS l_shipdate_min, max(b) AS l_shipdate_max FROM (SELECT count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def table_quality(t: Tables) -> DataFrame:
    return A.table_quality(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"], ["l_shipdate"])


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(c, T._parse_datatype_string(k), nullable=c.endswith("?")) for c, k in (x.split(":") for x in text.split())])


@query("""
SELECT 'nation' AS table_name, 'null:n_nationkey' AS check_name, CAST(0 AS BIGINT) AS n, '' AS samples UNION ALL SELECT 'nation', 'null:n_regionkey', 0, ''
UNION ALL SELECT 'nation', 'key:n_nationkey', 0, ''
UNION ALL SELECT 'nation', 'domain:n_regionkey', count(*), coalesce(array_to_string(list_sort(list_distinct(list(CAST(n_regionkey AS VARCHAR))))[1:5], ';'), '') FROM nation WHERE n_regionkey NOT IN (0, 1, 2)
UNION ALL SELECT 'nation', 'reference:n_regionkey->region', 0, ''""")
def pk_fk_domain_index_checks(t: Tables) -> DataFrame:
    nation = C.TableSpec("nation", _schema("n_nationkey:int n_regionkey:int"), ("n_nationkey",), (C.ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),), {"n_regionkey": (0, 1, 2)})
    return C.violations({"nation": nation.cast(t.nation), "region": t.region}, [nation])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def foreign_key_orphans(t: Tables) -> DataFrame:
    return J.orphans(t.orders.select("o_orderkey"), ["o_orderkey"], t.lineitem, ["l_orderkey"])


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def top_five(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5)


@query("""
WITH n AS (SELECT n_regionkey, s_suppkey, n_nationkey, count(*) OVER (PARTITION BY n_nationkey) AS rivals FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_regionkey, 's' || s_suppkey AS truth, 'n' || n_nationkey AS predicted, CASE WHEN rivals = 1 THEN 'forced' ELSE 'ambiguous' END AS status FROM n""")
def forced_matching(t: Tables) -> DataFrame:
    pairs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("truth"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("predicted"))
    return M.match_forced(pairs, "n_regionkey", "truth", "predicted")


@query("""
WITH n AS (SELECT conv_id, turn AS node FROM conversations UNION SELECT conv_id, turn + 1 FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, node, (conv_id, node) NOT IN (SELECT (conv_id, turn + 1) FROM conversations WHERE role = 'user') AS starts FROM n)
SELECT conv_id, node, max(node) FILTER (starts) OVER (PARTITION BY conv_id ORDER BY node) AS component FROM s""")
def event_components(t: Tables) -> DataFrame:
    edges = t.conversations.select("conv_id", F.col("turn").alias("a"), (F.col("turn") + F.when(F.col("role") == "user", 1).otherwise(0)).alias("b"))
    return M.group_components(edges, "conv_id", "a", "b")


@query("SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id")
def most_specific_level(t: Tables) -> DataFrame:
    return R.most_specific(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn").distinct()


@query(f"SELECT n_nationkey, array_to_string(list_sort(list_distinct([{norm('n_name')}, {norm("'x, ' || n_name")}])), ',') AS n FROM (SELECT n_nationkey, n_name FROM nation)")
def normalized_names(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.array_join(F.array_sort(F.array_distinct(F.array(X.normalize(F.col("n_name")), X.normalize(F.concat(F.lit("x, "), "n_name"))))), ",").alias("n"))
