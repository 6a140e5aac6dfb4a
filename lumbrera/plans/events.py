"""Latest situations, counts, timelines and filters: the dashboard's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import latest as L
from .registry import Tables, query

_DECISION = "CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END"
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"


def _events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", "ts", "event_id", "value").withColumn("decision", F.expr(_DECISION))


@query(f"SELECT user_id, event_type, ts, event_id, value FROM {_LATEST}")
def latest_actions(t: Tables) -> DataFrame:
    return L.latest_per_key(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query(f"SELECT event_type, {_DECISION} AS decision, count(DISTINCT user_id) AS n_projects FROM {_LATEST} GROUP BY 1, 2")
def situation_counts_latest(t: Tables) -> DataFrame:
    latest = L.latest_per_key(_events(t), ["user_id", "event_type"], ["ts", "event_id"])
    return latest.groupBy("event_type", "decision").agg(F.count_distinct("user_id").alias("n_projects"))


@query(f"SELECT event_type, {_DECISION} AS decision, count(DISTINCT user_id) AS n_projects FROM events GROUP BY 1, 2")
def situation_counts_historical(t: Tables) -> DataFrame:
    return _events(t).groupBy("event_type", "decision").agg(F.count_distinct("user_id").alias("n_projects"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT o_orderkey) AS n_publications FROM orders GROUP BY 1")
def publication_counts_by_year(t: Tables) -> DataFrame:
    pairs = t.orders.select("o_orderkey", "o_orderdate").distinct()
    return pairs.groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_orderkey").alias("n_publications"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT o_custkey) AS n_projects FROM orders GROUP BY 1")
def yearly_distinct_projects(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_custkey").alias("n_projects"))


@query("SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(DISTINCT o_orderkey) AS n_publications FROM orders GROUP BY 1")
def project_activity(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.count_distinct("o_orderkey").alias("n_publications"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_actions FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_fill(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_actions"))
    return J.left_fill(t.customer.select("c_custkey"), counts, ["c_custkey"], {"n_actions": 0})


_SELECTED = """
SELECT o.o_orderkey, o.o_custkey, c.c_name, n.n_name, r.r_name, o.o_orderpriority
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name IN ('ASIA', 'EUROPE') AND o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND o.o_orderdate >= TIMESTAMP '1996-01-01' AND o.o_orderdate <= TIMESTAMP '1998-12-31'"""


def _selection(t: Tables) -> DataFrame:
    places = J.checked_join(t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"], validate="m:1")
    located = t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = P.between(P.selected(t.orders, o_orderpriority=["1-URGENT", "2-HIGH"]), "o_orderdate", F.lit("1996-01-01").cast("timestamp"), F.lit("1998-12-31").cast("timestamp"))
    return rows.join(P.selected(located, r_name=["ASIA", "EUROPE"]), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name", "o_orderpriority")


@query(_SELECTED)
def dashboard_selection(t: Tables) -> DataFrame:
    return _selection(t)


@query(f"SELECT count(DISTINCT o_custkey) AS n_projects, count(DISTINCT o_orderkey) AS n_publications FROM ({_SELECTED})")
def dashboard_kpis(t: Tables) -> DataFrame:
    return _selection(t).agg(F.count_distinct("o_custkey").alias("n_projects"), F.count_distinct("o_orderkey").alias("n_publications"))


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT') AND o_orderstatus IN ('F', 'P')")
def filter_any(t: Tables) -> DataFrame:
    return P.selected(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), o_orderpriority=["1-URGENT"], o_orderstatus=["F", "P"])


@query("""
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first_at, k) AS actions FROM (
  SELECT o_custkey, o_orderpriority, min(o_orderdate) AS first_at, min(o_orderkey) FILTER (o_orderdate = d) AS k FROM (
    SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority) AS d FROM orders) GROUP BY 1, 2)
GROUP BY 1 HAVING count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) = 2""")
def filter_all_match(t: Tables) -> DataFrame:
    seen = t.orders.groupBy("o_custkey").agg(A.ordered_unique(F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")).alias("a"))
    return seen.filter(A.holds_all(F.col("a"), ["1-URGENT", "5-LOW"])).select("o_custkey", F.array_join("a", ",").alias("actions"))


@query(f"SELECT user_id, event_type, ts, event_id FROM {_LATEST} WHERE year(ts) = 2024 AND ts >= TIMESTAMP '2024-01-15' AND event_type IN ('click', 'error', 'view')")
def latest_then_filter(t: Tables) -> DataFrame:
    rows = P.event_rows(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"], "ts", True, F.lit("2024-01-15").cast("timestamp"), None, [2024], event_type=["click", "error", "view"])
    return rows


@query("""
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def territorial_filter(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    both = rows.join(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), "c_custkey", "left")
    return P.keys_at_levels(both, "c_custkey", {"r_name": ["ASIA"], "o_orderstatus": ["F"]})


@query("SELECT n_nationkey AS code, n_name AS name, r_name AS parent, count(DISTINCT c_custkey) AS n_projects FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3")
def territory_counts_nation(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("n_projects"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return counts.join(F.broadcast(named), "n_nationkey").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"), "n_projects")


@query("SELECT r_regionkey AS code, r_name AS name, count(DISTINCT c_custkey) AS n_projects FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def territory_counts_region(t: Tables) -> DataFrame:
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    located = t.customer.join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey"))
    return located.groupBy(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name")).agg(F.count_distinct("c_custkey").alias("n_projects"))


@query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')")
def cascade_options(t: Tables) -> DataFrame:
    return t.nation.join(P.selected(t.region, r_name=["AFRICA", "ASIA"]), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").distinct()


@query("""
SELECT o_custkey, o_orderdate, string_agg(o_orderpriority || ':' || o_orderkey, ';' ORDER BY o_orderpriority, o_orderkey) AS items FROM orders GROUP BY 1, 2""")
def timeline_grouped(t: Tables) -> DataFrame:
    rows = L.timeline(t.orders, ["o_custkey"], ["o_orderdate"], [F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k")])
    return rows.select("o_custkey", "o_orderdate", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["p"], i["k"].cast("string"))), ";").alias("items"))


@query("SELECT user_id, event_type, ts, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, event_id) AS INT) AS place FROM events")
def timeline(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_type", "event_id")
    return t.events.select("user_id", "event_type", "ts", "event_id", F.row_number().over(order).alias("place"))


@query("SELECT event_id, event_type, round(value, 2) AS value, round(sum(value) OVER (PARTITION BY event_type), 2) AS total FROM events")
def group_total_share(t: Tables) -> DataFrame:
    rows = L.group_total(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "total")
    return rows.select("event_id", "event_type", F.round("value", 2).alias("value"), F.round("total", 2).alias("total"))


@query("SELECT event_type, max(value) AS top FROM events GROUP BY 1")
def max_per_group(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.max("value").alias("top"))


@query("SELECT day FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS day)")
def calendar_days(t: Tables) -> DataFrame:
    from ..sources.readers import calendar

    return calendar(t.spark, "2024-01-01", "2024-02-29")


@query("""
SELECT doc_id, lang, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 5000 AND (n_chars < 2000 OR lang = 'en') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def search_universe(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return P.search_universe(docs, "doc_id", "n_chars", 200, 5000, 2000, docs.filter("lang = 'en'"), t.labels.filter("toxic = 1"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'), '00000001')")
def text_search(t: Tables) -> DataFrame:
    return P.text_search(t.supplier.select("s_suppkey", "s_name"), ["s_name"], "  #00000001 ")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (1, 2, 3) OR n_regionkey IN (1, 2, 3)")
def any_column_filter(t: Tables) -> DataFrame:
    return P.any_column_in(t.nation, ["n_nationkey", "n_regionkey"], [1, 2, 3])


@query("SELECT doc_id, quality FROM labels WHERE CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END")
def nullable_equality(t: Tables) -> DataFrame:
    rows = t.labels.withColumn("good", F.expr("case when toxic = 1 then null else quality = 1 end"))
    return rows.filter(P.is_exactly("good", True)).select("doc_id", "quality")
