"""Readers with a declared schema, and small generators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import TableSpec
from ..operators.joins import CardinalityError, duplicate_keys


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end, both included; the wrong order is an error."""
    if start > end:
        raise ValueError(f"{start} is after {end}")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def parquet(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """A Parquet table with exactly the declared columns and types."""
    df = spark.read.parquet(path)
    spec.check_schema(df)
    return df


def text_csv(spark: SparkSession, path: str, columns: list[str], keep_empty: bool = False) -> DataFrame:
    """CSV with a header, all columns strings, a byte order mark ignored; ``keep_empty``: empty fields are '' and not null."""
    df = spark.read.options(header=True, encoding="UTF-8", quote='"', escape='"', multiLine=True).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    value = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if keep_empty else F.col(f"`{c}`")
    return df.select(*[value(c).cast("string").alias(c) for c in columns])


def scope(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Ids from a CSV or Parquet file, under the first of the names it has; blank or repeated ids are an error."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    name = next((n for n in names if n in df.columns), None)
    if name is None:
        raise ValueError(f"{path} has none of {names}")
    ids = df.select(F.trim(F.col(name).cast("string")).alias(names[0]))
    if not ids.filter(F.coalesce(F.col(names[0]), F.lit("")) == "").isEmpty() or not duplicate_keys(ids, [names[0]]).isEmpty():
        raise CardinalityError(f"{path} has blank or repeated ids")
    return ids


def json_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())


_BLOCKS = frozenset(("p", "div", "tr", "table", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6"))


def _xml_text(node) -> str:  # noqa: ANN001
    """Text in document order: block ends are line breaks, cells are set off by bars."""
    tag = node.tag.lower() if isinstance(node.tag, str) else ""
    own = (node.text or "") if tag else ""  # comments have none
    inner = own + "".join(_xml_text(child) + (child.tail or "") for child in node)
    if tag in ("td", "th"):
        return f"{inner} | "
    return f"\n{inner}\n" if tag in _BLOCKS else inner


@F.pandas_udf(T.StructType([T.StructField("id", T.StringType()), T.StructField("day", T.DateType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def _parsed_xml(contents: pd.Series) -> pd.DataFrame:
    from datetime import datetime
    from xml.etree import ElementTree

    rows = []
    for content in contents:
        root = ElementTree.fromstring(bytes(content))  # noqa: S314  no entities are resolved
        one = lambda tag, root=root: (root.findtext(f".//{tag}") or "").strip()
        texts = list(root.iter("texto"))
        day = one("fecha_publicacion")
        rows.append((one("identificador"), datetime.strptime(day, "%Y%m%d").date() if day else None, one("titulo"), _xml_text(texts[0]) if texts else ""))  # noqa: DTZ007
    return pd.DataFrame(rows, columns=["id", "day", "title", "body"])


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, id, day, title, text, sha256 and length of XML documents: block ends are line breaks, cells are set off by bars."""
    from ..functions.text import clean

    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), _parsed_xml(F.col("content")).alias("x"), F.sha2("content", 256).alias("sha256"), "length")
    return raw.select("file", "x.id", "x.day", "x.title", clean(F.col("x.body"), keep_lines=True).alias("text"), "sha256", "length")


def _objects(value: Column, path: str) -> Column:
    """The raw JSON objects under a path that holds one, a list of them, or nothing."""
    raw = F.get_json_object(value, path)
    listed = F.when(F.ltrim(raw).startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    return F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))


def _text(value: Column, path: str) -> Column:
    return F.nullif(F.trim(F.get_json_object(value, path)), F.lit(""))


def summary_items(payloads: DataFrame, payload: str) -> DataFrame:
    """The items of daily summaries with their section, department and heading, wherever a department holds them.

    Departments stand in a section or its text; their items stand in them, under
    headings, in their text, or under the text's headings.
    """
    others = [c for c in payloads.columns if c != payload]
    days = payloads.select(*others, F.col(payload).alias("p"), F.to_date(F.get_json_object(payload, "$.data.sumario.metadatos.fecha_publicacion"), "yyyyMMdd").alias("day"))
    issues = days.select("*", F.explode(_objects(F.col("p"), "$.data.sumario.diario")).alias("issue"))
    sections = issues.select("*", F.explode(_objects(F.col("issue"), "$.seccion")).alias("section"))
    held = lambda path, prefix: F.transform(_objects(F.col("section"), path), lambda d: F.struct(d.alias("json"), F.lit(prefix).alias("prefix")))
    departments = sections.select("*", F.explode(F.concat(held("$.departamento", "departamento"), held("$.texto.departamento", "seccion.texto.departamento"))).alias("d"))
    own, prefix = F.col("d.json"), F.col("d.prefix")

    def direct(path: str, where: str) -> Column:
        return F.transform(_objects(own, path), lambda i: F.struct(i.alias("json"), F.lit(None).cast("string").alias("heading"), F.concat(prefix, F.lit(where)).alias("location")))

    def headed(path: str, where: str) -> Column:
        return F.flatten(F.transform(_objects(own, path), lambda h: F.transform(_objects(h, "$.item"), lambda i: F.struct(i.alias("json"), _text(h, "$.nombre").alias("heading"), F.concat(prefix, F.lit(where)).alias("location")))))

    every = F.concat(headed("$.epigrafe", ".epigrafe.item"), direct("$.item", ".item"), direct("$.texto.item", ".texto.item"), headed("$.texto.epigrafe", ".texto.epigrafe.item"))
    item = F.col("i.json")
    return departments.select("*", F.explode(every).alias("i")).select(
        *others, "day", _text(item, "$.identificador").alias("id"), _text(item, "$.titulo").alias("title"), _text(item, "$.url_html").alias("url_html"), _text(item, "$.url_xml").alias("url_xml"),
        _text(F.col("issue"), "$.numero").alias("issue_number"), _text(F.col("section"), "$.codigo").alias("section_code"), _text(F.col("section"), "$.nombre").alias("section_name"),
        _text(own, "$.codigo").alias("department_code"), _text(own, "$.nombre").alias("department_name"), F.col("i.heading").alias("heading"), F.col("i.location").alias("location"),
    )


@F.pandas_udf(T.LongType())
def count_items(payload: pd.Series) -> pd.Series:
    """Objects under keys named ``item`` at any depth of a JSON text."""
    import json

    def count(value: object) -> int:
        if isinstance(value, list):
            return sum(map(count, value))
        if not isinstance(value, dict):
            return 0
        held = value.get("item")
        return (0 if held is None else len(held) if isinstance(held, list) else 1) + sum(count(v) for k, v in value.items() if k != "item")

    return payload.map(lambda p: 0 if p is None else count(json.loads(p)))


def summary_problems(payloads: DataFrame, payload: str, key: str) -> DataFrame:
    """key, n_parsed, n_expected, n_repeated of the summaries whose items weren't all found, or whose ids repeat."""
    parsed = summary_items(payloads.select(key, payload), payload).groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))
    sums = parsed.groupBy(key).agg(F.sum("n").alias("n_parsed"), F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"))
    whole = payloads.select(key, count_items(F.col(payload)).alias("n_expected")).join(sums, key, "left").na.fill(0)
    return whole.filter("n_parsed <> n_expected OR n_repeated > 0")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """code, name, kind and coordinates (JSON) of the features, and the box around each."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    point = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[\s*(-?\d+(?:\.\d+)?)\s*,"), F.lit(1))
    lat = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r",\s*(-?\d+(?:\.\d+)?)\s*\]"), F.lit(1))
    box = [f(F.transform(v, lambda x: x.cast("double"))).alias(n) for v, axis in ((point, "lon"), (lat, "lat")) for f, n in ((F.array_min, f"min_{axis}"), (F.array_max, f"max_{axis}"))]
    return rows.select(F.col("f.properties")["code"].alias("code"), F.col("f.properties")["name"].alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), *box)
