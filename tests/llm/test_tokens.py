"""Packing (op 1) and token shards (op 7) against the tokenizers library."""

from __future__ import annotations

import os
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumbrera.llm import packing, repair
from lumbrera.llm.files import read_ranges
from lumbrera.llm.tokens import encoder, public_path

FILES = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))


@pytest.mark.parametrize(("name", "spaced"), FILES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="aBé .,\n'1#İΣ", max_size=60)), min_size=1, max_size=5))
def test_ids_are_the_library_s(name, spaced, texts):
    library = Tokenizer.from_file(public_path(name))
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder(public_path(name), spaced).encode_many(texts) == want


@pytest.mark.parametrize(("name", "spaced"), FILES)
def test_memory_of_a_batch_is_little_more_than_its_texts_and_ids(name, spaced):
    texts = [" ".join(f"w{(7 * i + k) % 5000}" for k in range(2000)) for i in range(700)] + [None, "", "x"]
    some = encoder(public_path(name), spaced)
    want = [some.encode_many([t])[0] for t in texts]
    tracemalloc.start()
    got = some.encode_many(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want
    assert peak < 2 * sum(map(len, want)) + 5 * sum(len(t or "") for t in texts)


def _ids(name, text, end):
    return Tokenizer.from_file(public_path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def test_packing_places_every_piece(docs, texts):
    rows = packing.pack(docs, keep=("ids", "ids_crc32")).toPandas().sort_values(["doc_id", "piece", "sequence_id"])
    by_sequence = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, own in by_sequence:
        assert own.length.sum() <= 2048
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]]
    for i, text in texts.items():
        ids = _ids("byte_bpe_50k.json", text, 0)
        own = rows[rows.doc_id == i].drop_duplicates("piece") if i == 5 else rows[rows.doc_id == i]
        assert b"".join(own.ids) == np.array(ids, "<u4").tobytes()
        assert list(own.start) == [0, *own.length.cumsum()[:-1]]
        assert all(zlib.crc32(x) == c for x, c in zip(own.ids, own.ids_crc32, strict=True))
        assert (own.length[1:] == 2048).all()
    assert (rows.doc_id == 5).sum() == 2 * len(rows[rows.doc_id == 5].drop_duplicates("piece"))
    assert rows.sequence_id.nunique() <= -(-int(rows.length.sum()) // 2048) + 1


def test_packing_of_nothing(empty_docs):
    assert packing.pack(empty_docs).count() == 0


def test_sequences_are_whole(docs):
    packed = packing.pack(docs)
    joined = packing.sequences(packed).toPandas()
    assert all(4 * n == len(ids) for n, ids in zip(joined.length, joined.ids, strict=True))


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=30))
def test_plan_holds_exactly_the_histogram(histogram):
    plan = packing.plan_packing(histogram, 64)
    got: dict[int, int] = {}
    for held, copies in plan:
        assert sum(k * n for k, n in held.items()) <= 64
        for k, n in held.items():
            got[k] = got.get(k, 0) + n * copies
    assert got == histogram
    lengths = np.array(sorted(histogram))
    decreasing = packing._best_fit(lengths, np.array([histogram[k] for k in lengths]), 64)
    assert sum(n for _, n in plan) <= 1.04 * sum(n for _, n in decreasing) + 4


def test_knapsack_is_optimal():
    lengths, prices = np.array([3, 5, 7]), np.array([1.0, 1.9, 2.6])
    best, _ = packing._knapsack(lengths, prices, 20)
    brute = max(a * 1.0 + b * 1.9 + c * 2.6 for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    assert best[20] == pytest.approx(brute)


def test_shards_round_trip_and_random_access(docs, texts):
    shards = repair.write_shards(docs, shard_tokens=3000)
    found = repair.read_documents(shards).toPandas().sort_values("start")
    order = sorted([*texts, 5])
    assert list(found.doc_id) == order
    start = 0
    for row, i in zip(found.itertuples(), order, strict=True):
        ids = np.array(_ids("word_bpe_49k.json", texts[i], 2), "<u4")
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids == ids.tobytes()
        start += len(ids)
    index = shards.df.toPandas()
    assert len(index) > 3 and index.groupby("name").length.sum().to_dict() == {n: os.path.getsize(f"{shards.folder}/{n}") for n in index.name}
    assert set(os.listdir(shards.folder)) == set(index.name)  # no attempts are left
    for row in index.itertuples():
        (payload,) = read_ranges(f"{shards.folder}/{row.name}", [(row.offset, row.length)])
        shard = repair.Shard(payload)
        whole, at = shard.ids(), 0
        for k, n in enumerate(shard.lengths.tolist()):
            assert (shard.document(k, n // 3, n // 2 + 1) == whole[at : at + n][n // 3 : n // 2 + 1]).all()
            at += n


def test_grammar_replaces_repeated_pairs():
    ids = np.array([7, 8, 9, 2] * 200, "<u4")
    seq, rules = repair.compress(ids, 100, 2)
    assert len(seq) < len(ids) / 2 and len(rules) >= 2
    assert (repair.expand(seq, rules, 100) == ids).all()
    assert all((pairs[:, 0] != 2).all() for pairs in rules)


def test_shards_of_nothing(empty_docs):
    assert repair.read_documents(repair.write_shards(empty_docs)).count() == 0
