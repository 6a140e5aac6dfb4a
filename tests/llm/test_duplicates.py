"""SimHash (op 8), suffix sorting (op 3) and decontamination (op 9) against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lumbrera.llm import decontaminate, simhash, suffixes
from lumbrera.llm.components import connected_components
from lumbrera.llm.suffixes import two_stage_sort

from .conftest import prose


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]


def test_fingerprints_and_components(docs, texts):
    rows = simhash.near_duplicate_components(docs).toPandas().drop_duplicates().sort_values("doc_id")
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    assert [x & (1 << 64) - 1 for x in rows.fp] == prints
    component = brute_components(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert list(rows.component_id) == [ids[c] for c in component]


@pytest.mark.parametrize("flips", [4, 5])
def test_links_reach_exactly_the_distance(spark, flips):
    rng = np.random.default_rng(flips)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(6):
            y = x
            for b in rng.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.link_fingerprints(nodes)).collect()}
    want = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [found.get(i, i) for i in range(len(fps))] == want


@pytest.mark.parametrize("part_rows", [200_000, 3])
def test_proposed_links_whatever_the_parts(spark, part_rows):
    rng, rows = np.random.default_rng(8), []
    for g in range(30):
        a, b = (int(x) for x in rng.integers(0, 1 << 62, 2))
        for k in range(3):
            for bit in rng.choice(62, 3, replace=False):
                a ^= 1 << int(bit)
            rows.append((a, b, 5 + k % 2, 10 * g + k))
    nodes = spark.createDataFrame(rows, "fp long, fp2 long, band int, node long")
    found = connected_components(simhash.propose_links(nodes, 32, 4, 2, part_rows)).collect()
    assert {(r["node"], r["component"]) for r in found} == {(n, n - n % 10) for _, _, _, n in rows}


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub(spark):
    hub = spark.range(1, 200).selectExpr("id AS a", "IF(id < 150, 500, 501) AS b").union(spark.sql("SELECT 7L, 501L"))
    found = {r["node"]: r["component"] for r in connected_components(hub.selectExpr("a", "CAST(b AS LONG) AS b"), hot_links=20).collect()}
    assert found == dict.fromkeys([*range(1, 200), 500, 501], 1)


def test_hot_parts_are_dealt_over_salts(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False)) for _ in range(300)})
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, node long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.link_fingerprints(nodes, part_rows=50, probe_rows=40)).collect()}
    want = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_one_of_each_near_copy_stays(docs, texts):
    kept = [r["doc_id"] for r in simhash.keep_one_of_each(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(texts) - {1, 2, 6, 7})  # 0, 1 and 2 have no words; 5, 6 and 7 are near copies


def edited_copies(n, seed=4):
    """Copies of a text of 200 words with one to eight words changed: similarities on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    base = prose(seed, 200, 4000).split()
    out = []
    for i in range(n):
        words = list(base)
        for k, at in enumerate(rng.choice(200, int(rng.integers(1, 9)), replace=False)):
            words[at] = f"changed{i}x{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 4000])
def test_no_proposed_link_is_lost(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block_bytes, raising=False)
    written = edited_copies(150)
    docs = spark.createDataFrame(list(enumerate(written)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in simhash.double_fingerprints(docs, 5, 0.8).collect()}
    shingles = [set(simhash.shingle_hashes(t, 5).tolist()) for t in written]

    def linked(i, j):
        x, y = (rows[i][c] ^ rows[j][c] for c in ("fp", "fp2"))
        x, y = x & (1 << 64) - 1, y & (1 << 64) - 1
        proposed = x.bit_count() + y.bit_count() <= 32 and any((x >> at & 0xFFFF).bit_count() <= 2 for at in (0, 16, 32, 48))
        return proposed and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])

    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert [found[i] for i in range(len(written))] == brute_components(len(written), linked)


def test_near_copies_are_told_by_distinct_shingles(spark):
    often = "same " * 400
    line = "one line that stands again and again in this text\n"
    body = prose(70, 100, 4000)
    rows = [(1, often + prose(71, 60, 4000)), (2, often + prose(72, 60, 4000)), (3, body + "\n" + line * 2), (4, body + "\n" + line * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs, width=5, similarity=0.8).collect()) == [1, 2, 3]


def test_rows_are_told_apart_by_doc_id_and_text(spark):
    a, b, c, d = (prose(i, 80, 4000) for i in (80, 81, 82, 83))
    rows = [(None, a), (None, b), (1, c), (1, c), (2, c), (2, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one_of_each(docs, width=5, similarity=0.8).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (1, c), (2, d)], key=str)


def test_simhash_of_nothing(empty_docs):
    assert simhash.near_duplicate_components(empty_docs).count() == 0
    assert simhash.keep_one_of_each(empty_docs).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=50, max_size=84).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=12))
def test_two_stage_sort_orders_suffixes(rows):
    grid, count = np.zeros((len(rows), 128), np.uint8), np.array([len(r) - 49 for r in rows])
    for i, r in enumerate(rows):
        grid[i, : len(r)] = np.frombuffer(r, np.uint8)
    got = [grid[p // 128, p % 128 :].tobytes().ljust(200, b"\0") for p in two_stage_sort(grid, 84, count)]
    assert got == sorted(grid[r, j:].tobytes().ljust(200, b"\0") for r in range(len(rows)) for j in range(count[r]))


def brute_repeats(pairs, length=50):
    first: dict[bytes, int] = {}
    for i, data in sorted(pairs):
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], i)
    out = {}
    for i, data in pairs:
        hit = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                hit[p : p + length] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~hit[:-1]])
        out[i] = (len(data), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_are_removed(docs, texts):
    rows = suffixes.remove_repeats(docs, 50).collect()
    want = brute_repeats([(i, (t or "").encode()) for i, t in texts.items()])
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]
    assert want[6][1] == want[6][0]


def test_cut_text_is_valid_and_columns_stay(docs, texts):
    rows = suffixes.remove_repeats(docs.select("doc_id", "text", "lang"), 50, keep=("lang",), as_text=True).collect()
    assert {r["doc_id"]: r["kept"] for r in rows}[0] is None
    assert all(r["kept"] == texts[r["doc_id"]] for r in rows if r["n_removed"] == 0)


def test_repeats_of_nothing(empty_docs):
    assert suffixes.remove_repeats(empty_docs).count() == 0


@pytest.mark.parametrize("options", [{"settle": False}, {"hot": 0}, {"settle": False, "hot": 3}])
def test_the_order_of_suffixes_decides_alone(docs, options):
    """Without aggregating equal contexts beforehand, and with all or some anchors dealt by window."""
    want = sorted(map(tuple, suffixes.remove_repeats(docs).collect()), key=repr)
    assert sorted(map(tuple, suffixes.remove_repeats(docs, **options).collect()), key=repr) == want


def test_nothing_goes_without_the_sort(docs, monkeypatch):
    """What one batch of documents doesn't settle comes from the suffix order."""
    count = np.array([1, 1, 1], np.uint8)
    text = np.frombuffer(b"a" * 50 + b"b" * 50 + b"a" * 50, np.uint8)
    numbers = np.array([3, 2, 9]), np.array([10, 11, 12]), np.array([0, 7, 4])
    row, doc, lo, hi = suffixes._repeats_in_bucket(count, *numbers, text, 50)
    assert (row.tolist(), doc.tolist(), lo.tolist(), hi.tolist()) == ([12], [9], [4], [54])
    monkeypatch.setattr(suffixes, "two_stage_sort", lambda *_: np.zeros(0, np.int64))
    assert not len(suffixes._repeats_in_bucket(count, *numbers, text, 50)[0])


def test_too_short_strings_are_an_error(docs):
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, 15)


def brute_contamination(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = {}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    found |= windows[k]
                    hit.update(range(j, j + n))
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def test_contamination(spark, docs, texts):
    passage = texts[9].lower()
    items = [(1, passage), (2, None), (3, "..."), (11, "isn't it"), (10, texts[30][:200]), (1, passage), (None, texts[31])]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, d int")
    rows = decontaminate.contamination(docs, benchmark, 10).collect()
    want = brute_contamination(texts, items)
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == want[r["doc_id"]], r
        assert r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"])


def test_contamination_of_and_by_nothing(spark, docs, empty_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, nothing).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty_docs, nothing).count() == 0


def test_proximity_in_any_order(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "pad " * 30 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    found = decontaminate.proximity_matches(decontaminate.Lookup(decontaminate.PositionalIndex(docs), items), terms=3, span=6).collect()
    assert sorted({r["doc_id"] for r in found}) == [1, 2]


def test_decontamination_plan_is_native(spark, docs):
    items = spark.createDataFrame([(1, "some words of an item that nobody has written before today")], "item_id long, text string")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
