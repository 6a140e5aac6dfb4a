"""Invariants and failures of single operators."""

from __future__ import annotations

import itertools
import random
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from lumbrera.functions import ids, text
from lumbrera.operators import aggregates, contracts, filters, joins, latest, matching, nest, resolve, sets
from lumbrera.sources import readers, snapshots
from lumbrera.streaming import attempts


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def python_normalize(value):
    import re

    plain = unicodedata.normalize("NFKD", (value or "").lower()).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", " ", plain).strip()


def test_normalize_equals_python(spark):
    rnd = random.Random(1)
    samples = ["Planta EÓLICA", "a–b", "l·l", "½ kW", "Straße", "ﬁn ﬂat", None, "", "  ", "Ｆｕｌｌ １２", "x²", "Ångström", "ĳsland"]
    samples += ["".join(rnd.choice("aÉñ·–ß½ x.9ﬁÅ日") for _ in range(12)) for _ in range(100)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = dict(values(df.select("i", text.normalize(F.col("s")).alias("n")), "i", "n"))
    assert [got[i] for i in range(len(samples))] == [python_normalize(s) for s in samples]


@pytest.mark.parametrize(("said", "mw"), [("50 MW", 50), ("1.250,5 kW", 1.2505), ("2 GW", 2000), ("0,5 MW", 0.5), ("entre 3 y 5 MW", None), ("3 MW y 4 MW", None), ("nada", None), (None, None), ("12.5 mw", 12.5)])
def test_power(spark, said, mw):
    got = spark.createDataFrame([(said,)], "s string").select(text.single_power(F.col("s"))).first()[0]
    assert (None if got is None else float(got)) == mw


def test_text_functions(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c(F.col("s"))).first()[0]
    assert one(text.name_variants, "Palmas, Las/Palma") == ["las", "las palma palmas", "palma", "palma palmas", "palmas las", "palmas las palma"]
    assert one(lambda c: text.padded_code(c, 5), " 123.0") == "00123" and one(lambda c: text.padded_code(c, 2), "123") is None
    assert one(lambda c: text.display_case(c, ["FV"], ["de"]), "PARQUE DE SOL fv II") == "Parque de Sol FV II"
    assert one(lambda c: text.cut_after(c, "ANEXO", 5), "ANEXO uno ANEXO dos") == "ANEXO uno"
    assert one(lambda c: text.evidence_supported(F.lit("la “planta” [...] dos"), c), 'En La "Planta"  hay\nuno, dos') is True
    assert one(lambda c: text.evidence_supported(F.lit(""), c), "x") is False
    assert one(lambda c: text.clean(c, keep_lines=True), " a  | \r\n\n b | c |\n") == "a\nb | c"
    assert one(lambda c: text.label(c, {"x": "Known"}), "some_value") == "Some value"


def test_uuid5(spark):
    ns = uuid.uuid4()
    names = ["", "a", "ñandú", "v1|project:x"] + [str(i) for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(ns, F.col("n")).alias("u"))
    assert dict(values(df, "n", "u")) == {n: uuid.uuid5(ns, n).hex for n in names}


def test_latest_is_independent_of_order_and_puts_nulls_first(spark):
    rows = [("a", None, 9), ("a", 1, 1), ("a", 1, 2), ("b", None, 3), ("b", None, 4)]
    for order in itertools.islice(itertools.permutations(rows), 8):
        df = spark.createDataFrame(list(order), "k string, at int, id int")
        assert values(latest.latest_per_key(df, ["k"], ["at", "id"]), "k", "id") == [("a", 2), ("b", 4)]
        assert values(latest.latest_per_key(df, ["k"], ["at", "id"], nulls_first=False), "k", "id") == [("a", 9), ("b", 4)]
    assert latest.latest_per_key(spark.createDataFrame([], "k string, at int, id int"), ["k"], ["at", "id"]).count() == 0


def test_joins_fail_closed(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(a, b, ["k"], validate="1:1")
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(a, b, ["k"], validate="m:1", same_keys=True)
    assert joins.checked_join(a, b, ["k"], validate="m:1").count() == 2
    with pytest.raises(ValueError):
        sets.disjoint_union(a, b, ["k"])


def test_empty_selection_is_no_filter(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert filters.selected(df, v=[]).count() == 2 and filters.selected(df, v=["x"]).count() == 1
    assert filters.text_search(df, ["v"], " ").count() == 2 and filters.any_column_in(df, ["k"], []).count() == 2
    assert filters.keys_at_levels(df, "k", {"v": []}).count() == 2


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    assert sets.frames_equal(a, b) and not sets.frames_equal(a, b.union(a))
    assert sets.semantic_hash(a).first() == sets.semantic_hash(b).first()
    assert values(sets.key_diff(a, b.filter("k = 2"), ["k"]), "k", "change") == [(1, "removed"), (2, "same")]


def test_contracts(spark):
    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("p", T.IntegerType()), T.StructField("kind", T.StringType())])
    spec = contracts.TableSpec("t", schema, ("k",), (contracts.ForeignKey(("p",), "u", ("k",), "kind", "x"),), {"kind": ("x", "y")})
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (None, None, "z")], "k int, p int, kind string")
    found = {r["check_name"]: r["n"] for r in contracts.violations({"t": df, "u": spark.createDataFrame([(4,)], "k int")}, [spec]).collect()}
    assert found == {"null:k": 1, "key:k": 1, "domain:kind": 1, "reference:p->u:x": 1}
    with pytest.raises(contracts.ContractError):
        spec.cast(df.drop("p"))
    with pytest.raises(contracts.ContractError):
        spec.check_schema(df.select("p", "k", "kind"))
    assert spec.empty(spark).count() == 0 and contracts.add_missing(df.drop("p"), schema).columns == ["k", "p", "kind"]


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    tables = {"a": spark.range(5), "b": spark.createDataFrame([(1, "x")], "k int, v string")}
    snapshots.publish(tables, path)
    assert {k: v.count() for k, v in snapshots.read(spark, path).items()} == {"a": 5, "b": 1}
    with pytest.raises(snapshots.SnapshotError):
        snapshots.publish(tables, path)
    spark.range(6).write.mode("overwrite").parquet(f"{path}/a")
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read(spark, path)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,\n2,\"x, y\"\n".encode())
    assert values(readers.text_csv(spark, f"{tmp_path}/a.csv", ["id", "name"], keep_empty=True), "id", "name") == [("1", ""), ("2", "x, y")]
    assert values(readers.scope(spark, f"{tmp_path}/a.csv", ("doc", "id")), "doc") == [("1",), ("2",)]
    (tmp_path / "d.xml").write_text("<d><identificador>X-1</identificador><fecha_publicacion>20240102</fecha_publicacion><titulo>T</titulo><texto><p>uno &amp; dos</p><table><tr><td>a</td><td>b</td></tr></table></texto></d>")
    row = readers.xml_documents(spark, f"{tmp_path}/d.xml").first()
    assert (row["id"], str(row["day"]), row["text"]) == ("X-1", "2024-01-02", "uno & dos\na | b")
    with pytest.raises(ValueError):
        readers.calendar(spark, "2024-02-01", "2024-01-01")
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"code": "1", "name": "n"}, "geometry": {"type": "Polygon", "coordinates": [[[1.5, 2], [3, 4], [1.5, 2]]]}}]}')
    g = readers.geojson(spark, f"{tmp_path}/g.json").first()
    assert (g["code"], g["min_lon"], g["max_lat"]) == ("1", 1.5, 4.0)


def brute_forced(edges):
    edges = set(edges)

    def maximum(es):
        best, found = 0, []
        for n in range(min(len({a for a, _ in es}), len({b for _, b in es})), 0, -1):
            for c in itertools.combinations(sorted(es), n):
                if len({a for a, _ in c}) == n == len({b for _, b in c}):
                    best = n
                    found.append(set(c))
            if best:
                return found
        return found

    out = set()
    while edges:
        every = maximum(edges)
        sure = set.intersection(*every) if every else set()
        if not sure:
            return out
        out |= sure
        edges = {(a, b) for a, b in edges if a not in {x for x, _ in sure} and b not in {y for _, y in sure}}
    return out


def test_forced_pairs_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        edges = {(f"a{rnd.randint(0, 4)}", f"b{rnd.randint(0, 4)}") for _ in range(rnd.randint(0, 8))}
        graph: dict[str, set[str]] = {}
        for a, b in edges:
            graph.setdefault(a, set()).add(b)
        assert matching.forced_pairs(graph) == brute_forced(edges)


def test_grouping_is_not_transitive(spark):
    rows = [("m1", "Sol", "fv", "1"), ("m2", "Sol", "fv", "1"), ("m2", "Luna", "fv", "1"), ("m3", "Luna", "fv", "1"), ("m4", "SOL", "fv", "1"), ("m5", "sol", "fv", "2")]
    df = spark.createDataFrame(rows, "m string, name string, tech string, geo string")
    found = dict(values(resolve.group_projects(df, "m", "name", "tech", "geo", uuid.NAMESPACE_URL), "m", "project_id"))
    assert found["m1"] == found["m4"] and len(set(found.values())) == 4


def test_resolution_ladder(spark):
    parents = spark.createDataFrame([(1, None, ["North"]), (2, None, ["South"])], "code int, parent int, names array<string>")
    children = spark.createDataFrame([(10, 1, ["Vega"]), (20, 2, ["Vega"]), (30, 2, ["Río, El", "El Río"])], "code int, parent int, names array<string>")
    asked = [("a", "vega", "north"), ("b", "vega", ""), ("c", "EL RIO", None), ("d", "rio", "South"), ("e", None, " "), ("f", "x", "y"), ("g", "el río", "North"), ("h", "Vega", "nowhere")]
    df = spark.createDataFrame(asked, "k string, child string, parent string")
    found = {r["k"]: (r["child_code"], r["parent_code"], r["status"]) for r in resolve.resolve_places(df, "k", "child", "parent", children, parents, stop=["el"]).collect()}
    assert found == {"a": (10, 1, "resolved"), "b": (None, None, "ambiguous"), "c": (30, 2, "resolved"), "d": (30, 2, "resolved"), "e": (None, None, "not_provided"), "f": (None, None, "not_found"), "g": (30, 2, "conflict"), "h": (None, None, "ambiguous")}


def test_nested_delete_tells_what_it_emptied(spark):
    df = spark.sql("SELECT 'd' AS doc, array(named_struct('id', 1, 'v', 'x'), named_struct('id', 2, 'v', 'y')) AS a UNION ALL SELECT 'e', array(named_struct('id', 1, 'v', 'z'))")
    targets = spark.createDataFrame([("d", "1"), ("e", "1")], "doc string, id string")
    found = {r["doc"]: (len(r["a"]), r["emptied"]) for r in nest.delete_nested(df, "doc", "a", "id", targets).collect()}
    assert found == {"d": (1, False), "e": (0, True)}


def test_metrics_without_denominators(spark):
    row = aggregates.micro_metrics(spark.createDataFrame([(False, False)], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert row["precision"] is None and row["recall"] is None and row["f1"] is None


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.IntegerType())])
    for rows in ([("a", 1), ("b", 5)], [("a", 3), ("b", 2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/log")
        attempts.keep_latest(attempts.read_log(spark, f"{tmp_path}/log", schema), f"{tmp_path}/out", f"{tmp_path}/check", ["k"], ["at"]).awaitTermination()
    assert values(spark.read.parquet(f"{tmp_path}/out/v1"), "k", "at") == [("a", 3), ("b", 5)]


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_summaries(spark):
    import json

    item = lambda i: {"identificador": f"X-{i}", "titulo": f" t{i} ", "url_xml": "u"}
    sections = [
        {"codigo": "1", "nombre": "A", "departamento": {"codigo": "9", "nombre": "D", "epigrafe": [{"nombre": "E", "item": item(1)}, {"nombre": "F", "item": [item(2), item(3)]}], "item": item(4)}},
        {"codigo": "2", "texto": {"departamento": [{"nombre": "T", "texto": {"item": [item(5)], "epigrafe": {"nombre": "G", "item": item(6)}}}]}},
    ]
    good = {"data": {"sumario": {"metadatos": {"fecha_publicacion": "20240102"}, "diario": {"numero": "7", "seccion": sections}}}}
    odd = {"data": {"sumario": {"metadatos": {"fecha_publicacion": "20240103"}, "diario": [{"numero": "8", "seccion": [{"item": item(1)}]}]}}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(odd)), (3, None)], "k int, p string")
    rows = {r["id"]: r for r in readers.summary_items(df, "p").collect()}
    assert sorted(rows) == [f"X-{i}" for i in range(1, 7)]
    assert (rows["X-1"]["heading"], rows["X-1"]["location"], rows["X-1"]["title"], str(rows["X-1"]["day"])) == ("E", "departamento.epigrafe.item", "t1", "2024-01-02")
    assert rows["X-6"]["location"] == "seccion.texto.departamento.texto.epigrafe.item" and rows["X-5"]["heading"] is None
    assert [tuple(r) for r in readers.summary_problems(df, "p", "k").collect()] == [(2, 1, 0, 0)]
