"""Token-id shards in a binary format compressed by a Re-Pair grammar.

Documents are dealt by ranges of doc_id, encoded, and cut into shards of about
``shard_tokens`` ids. In a shard the frequent adjacent id pairs are replaced by
nonterminals, round after round; the payload keeps the rules, the expansion
length of every nonterminal, the reduced sequence and, per document, its id,
length and place in the sequence. A document, or any range of its ids, is
decoded from its own part of the sequence: expansion lengths tell which symbols
to expand. A task's shards stand one after another in a file, which an index
table describes (part, shard, start of the shard in its part, n_tokens, file,
offset, length); ``read_documents`` reads them back from there.

Payload (little endian): magic ``RPG1``; counts of documents, rules, symbols and
rounds (4 x u4); base (u4); rules per round (u4 each); doc ids (i8, null as the
least value); document lengths (u4); document symbols (u4); rule pairs (2 x u4
each); expansion lengths (u4 each); sequence (u2 if all symbols fit, else u4;
the width is the last u4 of the header).

Defined results: null or empty text is the end id alone; an empty table gives
no shards and no documents; repeated doc_ids are kept as separate documents, in
order of text; a null doc_id comes first. Extra columns are ignored. Pairs
never begin with the end id, so no rule crosses a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Written, only, scratch_path, slices
from .files import Attempt, listing, publish, read_ranges
from .tokens import encoder, public_path

INDEX = "part int, shard int, start long, n_tokens long, attempt string, name string, offset long, length long"
_MAGIC, _NULL = b"RPG1", np.iinfo(np.int64).min
_HASH, _SLOT_BITS = 0x9E3779B97F4A7C15, 19


def _frequent_pairs(seq: np.ndarray, end_id: int, least: int, most: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the most frequent pairs, their ranks (0: most frequent), and the pairs by rank.

    Pairs are counted in hashed slots, by another hash in every round; of pairs
    that share a slot one stands for it in this round.
    """
    keys = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
    odd = np.uint64(_HASH * (2 * turn + 1) & (1 << 64) - 1)
    slot = ((keys * odd) >> np.uint64(64 - _SLOT_BITS)).astype(np.int32)
    at = np.nonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= least)[slot] & (seq[:-1] != end_id))[0]
    keys, slot = keys[at], slot[at]
    owner = np.zeros(1 << _SLOT_BITS, np.uint64)
    owner[slot] = keys
    own = owner[slot] == keys
    at, slot = at[own], slot[own]
    count = np.bincount(slot, minlength=1 << _SLOT_BITS)
    frequent = np.nonzero(count >= least)[0]
    frequent = frequent[np.lexsort((owner[frequent], -count[frequent]))[:most]]
    rank = np.full(1 << _SLOT_BITS, -1, np.int32)
    rank[frequent] = np.arange(len(frequent))
    rank_at = rank[slot]
    return at[rank_at >= 0], rank_at[rank_at >= 0], owner[frequent]


def compress(ids: np.ndarray, base: int, end_id: int, rounds: int = 30, least: int = 12, most: int = 4096, gain: float = 0.005) -> tuple[np.ndarray, list[np.ndarray]]:
    """The reduced sequence and per round the pairs (n x 2) that nonterminals base, base + 1, ... stand for.

    Rounds go on until no pair occurs ``least`` times or one shortens the sequence by less than ``gain``.
    """
    seq, rules, following = ids.astype(np.uint32), [], base
    for turn in range(rounds):
        before = len(seq)
        if before < 2:
            break
        at, rank, frequent = _frequent_pairs(seq, end_id, least, most, turn)
        if not len(at):
            break
        # Of overlapping pairs the more frequent one goes; of equal ones the first.
        beside = at[1:] == at[:-1] + 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~beside | (rank[1:] < rank[:-1])
        wins[:-1] &= ~beside | (rank[:-1] <= rank[1:])
        at, rank = at[wins], rank[wins]
        used = np.bincount(rank, minlength=len(frequent)) > 0
        symbol = np.cumsum(used) - 1
        pairs = frequent[used]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq[at] = following + symbol[rank]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        following += len(pairs)
        if before - len(seq) < gain * before:
            break
    return seq, rules


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def expand(seq: np.ndarray, rules: list[np.ndarray], base: int) -> np.ndarray:
    """Every nonterminal is written out once, in the order of the rounds; the sequence then copies from there."""
    flat, start, size = np.arange(base, dtype=np.uint32), np.arange(base), np.ones(base, np.int64)
    for pairs in rules:
        sides = pairs.reshape(-1).astype(np.int64)
        own = flat[_ranges(start[sides], size[sides])]
        grown = size[sides].reshape(-1, 2).sum(1)
        start = np.concatenate([start, len(flat) + np.cumsum(grown) - grown])
        size, flat = np.concatenate([size, grown]), np.concatenate([flat, own])
    return flat[_ranges(start[seq], size[seq])]


def _sizes(symbols: np.ndarray, expansion: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    size, held = np.ones(len(symbols), np.int64), symbols >= base
    size[held] = expansion[symbols[held].astype(np.int64) - base]
    return size


def _expansion_lengths(rules: list[np.ndarray], base: int) -> np.ndarray:
    lengths = np.zeros(0, np.uint32)
    for pairs in rules:
        sizes = _sizes(pairs[:, 0], lengths, base) + _sizes(pairs[:, 1], lengths, base)
        lengths = np.concatenate([lengths, sizes.astype(np.uint32)])
    return lengths


def encode_shard(doc_ids: list, ids: list[bytes], base: int, end_id: int, rounds: int = 30) -> bytes:
    whole = np.frombuffer(b"".join(ids), "<u4")
    seq, rules = compress(whole, base, end_id, rounds)
    expansion = _expansion_lengths(rules, base)
    symbol_size = _sizes(seq, expansion, base)
    lengths = np.array([len(x) // 4 for x in ids], "<u4")
    ends = np.searchsorted(np.cumsum(symbol_size), np.cumsum(lengths.astype(np.int64))) + 1
    width = 2 if base + len(expansion) <= 1 << 16 else 4
    head = np.array([len(ids), len(expansion), len(seq), len(rules), base, *map(len, rules), width], "<u4")
    known = np.array([_NULL if d is None else d for d in doc_ids], "<i8")
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    parts = [head, known, lengths, np.diff(ends, prepend=0).astype("<u4"), pairs.astype("<u4"), expansion.astype("<u4"), seq.astype(f"<u{width}")]
    return _MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """A payload opened for random access."""

    def __init__(self, payload: bytes):
        if payload[:4] != _MAGIC:
            raise ValueError("not a shard payload")
        at = 4

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        docs, n_rules, symbols, rounds, self.base = map(int, take(5, "<u4"))
        sizes, (width,) = take(rounds, "<u4"), take(1, "<u4")
        self.doc_ids, self.lengths, spans = take(docs, "<i8"), take(docs, "<u4"), take(docs, "<u4")
        pairs, self.expansion = take(2 * n_rules, "<u4").reshape(-1, 2), take(n_rules, "<u4")
        self.seq = take(symbols, f"<u{width}").astype(np.int64)
        self.rules = np.split(pairs, np.cumsum(sizes)[:-1]) if rounds else []
        self.ends = np.cumsum(spans.astype(np.int64))

    def doc_id(self, k: int) -> int | None:
        return None if self.doc_ids[k] == _NULL else int(self.doc_ids[k])

    def ids(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.base).astype("<u4", copy=False)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the k-th document; only the symbols that reach into them are expanded."""
        seq = self.seq[self.ends[k - 1] if k else 0 : self.ends[k]]
        ends = np.cumsum(_sizes(seq, self.expansion, self.base))
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(seq[a:b], self.rules, self.base)[start - before : stop - before].astype("<u4")


class Shards(NamedTuple):
    """A folder of shard files (``<part>.rpg``) and the index of their shards."""

    folder: str
    index: Written

    @property
    def df(self) -> DataFrame:
        """part, shard, start (of the shard in its part), n_tokens, name (of the file), offset, length."""
        return self.index.df.drop("attempt")


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    end_id: int = 2,
    spaced: bool = False,
    base: int = 49408,
    shard_tokens: int = 1 << 19,
    rounds: int = 30,
) -> Shards:
    """Shard files in ``folder`` (by default one of its own in the shared folder) and their index."""
    path = tokenizer or public_path("word_bpe_49k.json")
    folder = folder or scratch_path(docs.sparkSession, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, end = encoder(path, spaced), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        doc_ids, ids, held, start, rows, out = [], [], 0, 0, [], None

        def flush() -> None:
            nonlocal doc_ids, ids, held, start, out
            out = out or Attempt(folder)
            payload = encode_shard(doc_ids, ids, base, end_id, rounds)
            rows.append((part, len(rows), start, held, out.name, f"{part:06d}.rpg", out.at, len(payload)))
            out.write(payload)
            doc_ids, ids, start, held = [], [], start + held, 0

        for batch in slices(batches, "text", 3 * SLICE_BYTES):
            for doc, own in zip(batch.column(0).to_pylist(), words.encode_many(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc)
                ids.append(own + end)
                held += len(ids[-1]) // 4
                if held >= shard_tokens:
                    flush()
        if ids:
            flush()
        if out:
            out.close()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ordered = only(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = Written(ordered.mapInArrow(run, INDEX), "shard-index")
    publish(index.df, folder)
    return Shards(folder, index)


def read_documents(shards: Shards) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of every document of the files."""
    df, folder = shards.df, shards.folder
    parts = df.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payloads = read_ranges(f"{folder}/{name}", [(e["offset"], e["length"]) for e in entries])
                for start, payload in zip([e["start"] for e in entries], payloads, strict=True):
                    shard = Shard(payload)
                    ends = np.cumsum(shard.lengths.astype(np.int64))
                    places = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype("<i8"))
                    ids = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, places, pa.py_buffer(shard.ids())]).cast(pa.binary())
                    doc_ids = pa.array(shard.doc_ids, mask=shard.doc_ids == _NULL)
                    columns = [doc_ids, pa.array(start + ends - shard.lengths), pa.array(shard.lengths.astype(np.int64)), ids]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    placed = df.join(base, "part").withColumn("start", F.col("start") + F.col("base"))
    return listing(placed, "length", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
