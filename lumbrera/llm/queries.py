"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_config_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    packed = packing.pack(table(spark, sf_dir, "documents"), keep=("ids_crc32",), slice_bytes=16 << 20)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cotrain

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).select("doc_id", "content_score", "metadata_score", "score", "kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    members = warc.normalise(warc.write_monolithic(table(spark, sf_dir, "pages"), 0))
    found = warc.read_records(members, warc.sidecar_index(members))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_sql() -> str:
    from .urlfilter import LEAST_SOFT, RULES, SOFT_TERMS, STRICT_TERMS

    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH split AS (
      SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS u,
        CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') ELSE '' END AS h,
        CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
    hosted AS (SELECT page_id, u, translate(h, '{upper}', '{lower}') AS host, path FROM split),
    rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
    fit AS (
      SELECT h.page_id, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule, arg_max(r.verdict, length(r.rule_host || r.rule_path)) AS ruled
      FROM hosted h JOIN rules r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
      GROUP BY h.page_id),
    words AS (
      SELECT page_id, ({" OR ".join(map(hit, STRICT_TERMS))}) AS strict, {" + ".join(f"CAST({hit(t)} AS INT)" for t in SOFT_TERMS)} AS soft FROM hosted)
    SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.ruled, CASE WHEN w.strict OR w.soft >= {LEAST_SOFT} THEN 'block' ELSE 'allow' END) AS verdict
    FROM hosted h JOIN words w USING (page_id) LEFT JOIN fit f USING (page_id)"""


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import qualityrules

    found = qualityrules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    shards = repair.write_shards(table(spark, sf_dir, "documents"))
    return repair.read_documents(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontaminate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op10_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold.alias("held_out"))
    found = langid.identify(docs, docs.filter("not held_out"), keep=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_config_lp": op1_pack_config_lp,
    "op2_cotrained_quality": op2_cotrained_quality,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_warc_normaliser": op4_warc_normaliser,
    "op5_url_vocabulary": op5_url_vocabulary,
    "op6_divergence_rules": op6_divergence_rules,
    "op7_repair_token_shards": op7_repair_token_shards,
    "op8_simhash_multi_index": op8_simhash_multi_index,
    "op9_decontaminate_index": op9_decontaminate_index,
    "op10_language_kernel": op10_language_kernel,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows and bytes as hexadecimal digits.
_OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM d, unnest(range(0, greatest(length(h) // 2 - 49, 0))) t(p)),
firsts AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
hit AS (SELECT doc_id, p AS hit FROM w JOIN firsts USING (s) WHERE f < doc_id),
b AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 2) AS x FROM d, unnest(range(0, length(h) // 2)) t(p)),
m AS (SELECT b.doc_id, b.p, x, max(hit) OVER (PARTITION BY b.doc_id ORDER BY b.p) AS last FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.hit = b.p),
g AS (SELECT doc_id, p, x, coalesce(p - last < 50, false) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM g),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)"""

_OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS b FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(b, i + 1, 1) AS INT) + 8 * CAST(substr(b, i + 2, 1) AS INT) + 4 * CAST(substr(b, i + 3, 1) AS INT) + 2 * CAST(substr(b, i + 4, 1) AS INT) + CAST(substr(b, i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM bits"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p + 1 : p + least(len(w), 10)], ' ') AS g FROM i, unnest(range(0, greatest(len(w) - 9, 1))) t(p) WHERE len(w) > 0),
own AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(0, greatest(len(w) - n + 1, 0))) t(p)),
met AS (SELECT doc_id, p, own.n AS n, item_id FROM own JOIN win ON own.n = win.n AND own.g = win.g),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_array_dedup": _OP3_SQL,
    "op4_warc_normaliser": _OP4_SQL,
    "op5_url_vocabulary": op5_sql(),
    "op9_decontaminate_index": _OP9_SQL,
}
