"""Exact repeated substrings across documents by two-stage suffix sorting.

A byte goes if a string of ``length`` bytes over it also starts in a document
with a smaller doc_id. Every ``length``-byte window has one anchor, its least
k-mer by hash, that depends on the window's bytes alone; so equal windows have
equal anchors. Only anchors that occur in two documents or more are followed
up. The bytes around them (the windows that share the anchor occurrence) are
dealt by anchor, and each task sorts the suffixes that start a window:

* a suffix smaller than its successor is sorted directly,
* all others are induced by a scan over the first-byte buckets,
* neighbours with a common prefix of ``length`` bytes or more are equal windows.

Work that travels is packed in blobs per target. Before anything travels,
equal contexts within a batch of documents are aggregated: they go out once,
with the smallest doc_id, and the others are settled, so a hot passage costs
one entry per batch (``settle=False`` sends every context to the sort; results
are the same). In a bucket, equal contexts share a row of the sorted grid, and
the order of suffixes decides every occurrence. An anchor with over HOT_ENTRIES
entries is dealt by its windows' own hashes instead, one window each, so that
different windows of a frequent anchor meet in different buckets.

Defined results: text null or shorter than ``length`` loses nothing; rows with
equal doc_id do not affect each other; a null doc_id counts as larger than all
others. Strings are judged on the input; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Written, buckets_for, drop_stale, give_back, input_bytes, only, slices

_KMER = 16
_MULT = np.uint64(6364136223846793005)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max
#: Row keys are 40 bits of a hash: with the doc_id they tell rows apart, and only those of one doc_id need telling apart.
_ROW_SHIFT = 24
#: Text bytes per target of the dealt work.
BUCKET_BYTES = 3 << 20
#: Anchors with more entries than this are dealt by window.
HOT_ENTRIES = 20_000


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under one compressed frame."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode()
        parts.append(struct.pack("<B", len(code)) + code + struct.pack("<q", len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        k = raw[at]
        kind = np.dtype(raw[at + 1 : at + 1 + k].decode())
        (n,) = struct.unpack_from("<q", raw, at + 1 + k)
        at += 9 + k
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ..."""
    skip = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(skip - start, count)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor hash, first window, number of windows.

    data: bytes of some documents, ends: where each ends. Windows over an end don't count.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = data.astype(np.uint64)
    h = np.zeros(len(data) - _KMER + 1, np.uint64)
    for j in range(_KMER):
        h *= _MULT
        h += wide[j : j + len(h)]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    del wide
    place = np.uint64(32)
    least = (h >> place << place) | np.arange(len(h), dtype=np.uint64)
    span, done = length - _KMER + 1, 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    at = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(n, bool)
    for e in ends[:-1] if len(ends) < 64 else ():
        valid[max(0, e - length + 1) : e] = False
    if len(ends) >= 64:
        cut = np.zeros(n + 1, np.int32)
        np.add.at(cut, np.clip(ends[:-1] - length + 1, 0, n), 1)
        np.add.at(cut, np.clip(ends[:-1], 0, n), -1)
        valid = np.cumsum(cut[:-1]) == 0
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    starts = np.nonzero(first)[0]
    count = np.diff(starts, append=n)
    keep = valid[starts]
    # Two documents can't share a run: the windows over their border are not valid.
    starts, count = starts[keep], count[keep]
    return h[at[starts]], starts, count


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """doc ids (null: the largest number), row keys, texts as bytes."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    ids = column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
    texts = [t or b"" for t in column("text").cast(pa.binary()).to_pylist()]
    return ids, column("row").to_numpy(zero_copy_only=False), texts


def _equal_contexts(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each context the first of those with its bytes; candidates share a key and size, bytes are compared."""
    order = np.lexsort((start, size, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (size[order][1:] != size[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.arange(len(start))
    twin, of = order[~new], first[~new]
    n = size[twin]
    for at in range(0, len(twin), 1 << 15):
        a, b, k = twin[at : at + (1 << 15)], of[at : at + (1 << 15)], n[at : at + (1 << 15)]
        same = data[_ranges(start[a], k)] == data[_ranges(start[b], k)]
        whole = np.logical_and.reduceat(same, np.cumsum(k) - k) if len(k) else np.zeros(0, bool)
        out[a[whole]] = b[whole]
    return out


def find_anchors(docs: DataFrame, length: int, buckets: int, settle: bool = True) -> DataFrame:
    """Blobs of anchors per bucket (kind 0), and of intervals that are settled already per document bucket (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 2):
            ids, rows, texts = _documents(batch)
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            a, start, count = anchors(data, ends, length)
            if not len(a):
                continue
            doc = np.searchsorted(ends, start, "right")
            own = ids[doc]
            settled = np.zeros(len(a), bool)
            if settle:
                twin = _equal_contexts(data, start, count + length - 1, a)
                least = np.full(len(a), _LAST)
                np.minimum.at(least, twin, own)
                settled = own > least[twin]
            at = start - np.concatenate([[0], ends[:-1]])[doc]
            out: tuple[list, ...] = ([], [], [])

            def deal(kind: int, target: np.ndarray, *columns: np.ndarray, out: tuple = out) -> None:
                order = np.argsort(target, kind="stable")
                found, begin = np.unique(target[order], return_index=True)
                for b, own in zip(found.tolist(), np.split(order, begin[1:]), strict=True):
                    for column, value in zip(out, (kind, b, pack_arrays(*(c[own] for c in columns))), strict=True):
                        column.append(value)

            live = ~settled
            short = a[live] & np.uint64(0xFFFFFFFFFFFF)
            deal(0, (short % np.uint64(buckets)).astype(np.int64), short.astype("<u8"), own[live], rows[doc[live]], at[live], count[live].astype(np.uint8))
            if settled.any():
                row = rows[doc[settled]]
                deal(1, np.mod(row, buckets), row, own[settled], at[settled], at[settled] + count[settled] + length - 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["kind", "bucket", "blob"])

    return docs.mapInArrow(run, "kind int, bucket int, blob binary")


def _blobs(rows: pa.Table) -> list[np.ndarray]:
    drop_stale()
    parts = [unpack_arrays(b) for b in rows["blob"].to_pylist()]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _deal_table(kind: int, target: np.ndarray, columns: tuple[np.ndarray, ...]) -> pa.Table:
    order = np.argsort(target, kind="stable")
    found, begin = np.unique(target[order], return_index=True)
    blobs = [pack_arrays(*(c[own] for c in columns)) for own in np.split(order, begin[1:])] if len(order) else []
    return pa.table({"kind": pa.array([kind] * len(blobs), pa.int32()), "bucket": pa.array(found.tolist() if blobs else [], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def recurring(found: DataFrame, buckets: int, hot: int = HOT_ENTRIES) -> DataFrame:
    """Per document bucket, blobs of the anchors that occur in two documents or more (kind 0); kind 1 passes."""

    def run(rows: pa.Table) -> pa.Table:
        if rows["kind"][0].as_py():
            return rows
        a, doc, row, at, count = _blobs(rows)
        order = np.lexsort((doc, a))
        a, doc = a[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        begin = np.nonzero(new)[0]
        size = np.diff(begin, append=len(a))
        many = np.repeat(doc[begin] != doc[begin + size - 1], size)
        back = np.argsort(order, kind="stable")
        a, doc, crowded, many = (c[back] for c in (a, doc, np.repeat(size > hot, size), many))
        pick = np.nonzero(many)[0]
        pick = pick[np.lexsort((at[pick], doc[pick], row[pick]))]
        return _deal_table(0, np.mod(row[pick], buckets), (row[pick], doc[pick], at[pick], count[pick], a[pick], crowded[pick]))

    return found.groupBy("kind", "bucket").applyInArrow(run, "kind int, bucket int, blob binary")


def _per_row(entries: list[np.ndarray]) -> tuple[list[np.ndarray], dict[tuple[int, int], slice]]:
    """The entries (row key, doc id, ...) in order, and where each row's are.

    Rows are told apart by both: row keys are hashes and may be equal for different documents.
    """
    order = np.lexsort((entries[1], entries[0]))
    entries = [c[order] for c in entries]
    row, doc = entries[:2]
    begin = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]))[0] if len(row) else np.zeros(0, int)
    return entries, {(int(row[b]), int(doc[b])): slice(int(b), int(e)) for b, e in zip(begin, [*begin[1:], len(row)], strict=True)}


def _by_window(data: np.ndarray, base: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray, target: np.ndarray, crowded: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Crowded contexts as contexts of one window each, dealt by the window's bytes."""
    whole, n = ~crowded, count[crowded].astype(np.int64)
    own, start = np.repeat(doc[crowded], n), _ranges(at[crowded], n)
    h = np.zeros(len(own), np.uint64)
    for j in range(length):
        h = h * _MULT + data[base[own] + start + j]
    h ^= h >> np.uint64(31)
    dealt = ((h * _MIX >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    parts = ((doc[whole], own), (at[whole], start), (count[whole], np.ones(len(own), count.dtype)), (target[whole], dealt))
    return tuple(np.concatenate(p) for p in parts)


def contexts(docs: DataFrame, marks: DataFrame, length: int, buckets: int) -> DataFrame:
    """The bytes around recurring anchors, as blobs per anchor bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _deal_table(0, np.zeros(0, np.int64), ())
        entries, where = _per_row(_blobs(right))
        parts = []
        for batch in slices(left.combine_chunks().to_batches(), "text", SLICE_BYTES):
            ids, rows, texts = _documents(batch)
            data = np.frombuffer(b"".join(texts), np.uint8)
            base = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
            spans = [(i, where[k]) for i, k in enumerate(zip(rows.tolist(), ids.tolist(), strict=True)) if k in where]
            if not spans:
                continue
            pick = np.concatenate([np.arange(s.start, s.stop) for _, s in spans])
            doc = np.repeat([i for i, _ in spans], [s.stop - s.start for _, s in spans])
            at, count, a, crowded = (c[pick] for c in entries[2:])
            target = (a % np.uint64(buckets)).astype(np.int64)
            if crowded.any():
                doc, at, count, target = _by_window(data, base, doc, at, count, target, crowded, length, buckets)
            size = count.astype(np.int64) + length - 1
            order = np.argsort(target, kind="stable")
            found, begin = np.unique(target[order], return_index=True)
            for b, own in zip(found.tolist(), np.split(order, begin[1:]), strict=True):
                text = data[_ranges(base[doc[own]] + at[own], size[own])]
                parts.append((b, pack_arrays(count[own], ids[doc[own]], rows[doc[own]], at[own], text)))
        return pa.table({"kind": pa.array([0] * len(parts), pa.int32()), "bucket": pa.array([b for b, _ in parts], pa.int32()), "blob": pa.array([x for _, x in parts], pa.binary())})

    cut = docs.withColumn("bucket", F.pmod("row", F.lit(buckets)).cast("int"))
    return cut.groupBy("bucket").cogroup(marks.filter("kind = 0").groupBy("bucket")).applyInArrow(run, "kind int, bucket int, blob binary")


def _words(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """8 bytes from each place, as a number in byte order."""
    view = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))
    return view[at].astype(np.uint64)


def two_stage_sort(grid: np.ndarray, width: int, count: np.ndarray) -> np.ndarray:
    """Places (row * columns + column) of the suffixes that start at the first count[r] columns of row r, in order.

    A suffix goes on to its row's end and then in zeros for ever; bytes from ``width`` on must be zero.
    """
    n, columns = grid.shape
    flat = np.ascontiguousarray(grid).reshape(-1)
    smaller = np.ones((n, width + 1), bool)  # smaller than its successor, or all zeros
    for j in range(width - 1, -1, -1):
        smaller[:, j] = (grid[:, j] < grid[:, j + 1]) | ((grid[:, j] == grid[:, j + 1]) & smaller[:, j + 1])
    # The induced ones need their successors up to the next one that is sorted directly.
    wanted = np.zeros((n, width + 1), bool)
    wanted[:, : int(count.max(initial=0))] = np.arange(int(count.max(initial=0))) < count[:, None]
    for j in range(1, width + 1):
        wanted[:, j] |= wanted[:, j - 1] & ~smaller[:, j - 1]
    row, col = np.nonzero(wanted & smaller)
    direct = row * columns + col
    order = np.lexsort((_words(flat, direct),))
    direct = direct[order]
    tied_at, group = np.arange(len(direct)), np.zeros(len(direct), np.int64)
    depth = 0
    while len(tied_at):
        word = np.where(direct[tied_at] % columns + depth < width, _words(flat, np.minimum(direct[tied_at] + depth, len(flat) - 8)), np.uint64(0))
        if depth:
            order = np.lexsort((word, group))
            direct[tied_at] = direct[tied_at[order]]
            word = word[order]
        new = np.ones(len(tied_at), bool)
        new[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        tied = np.bincount(group)[group] > 1
        depth += 8
        tied &= direct[tied_at] % columns + depth < width
        tied_at, group = tied_at[tied], group[tied]
    bounds = np.searchsorted(flat[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller_flat = np.zeros(n * columns, bool)
    smaller_flat.reshape(n, columns)[:, : width + 1] = smaller
    wanted_flat = np.zeros(n * columns, bool)
    wanted_flat.reshape(n, columns)[:, : width + 1] = wanted
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Puts the predecessors that are larger into their buckets; those of this bucket come back."""
        before = scanned[scanned % columns > 0] - 1
        before = before[wanted_flat[before] & ~smaller_flat[before]]
        if not len(before):
            return before
        own = flat[before]
        order = np.argsort(own, kind="stable")
        before, own = before[order], own[order]
        found, begin = np.unique(own, return_index=True)
        mine = np.zeros(0, np.int64)
        for b, part in zip(found.tolist(), np.split(before, begin[1:]), strict=True):
            if b == byte:
                mine = part
            else:
                pending[b].append(part)
        return mine

    for byte in range(256):
        wave = np.concatenate(pending[byte]) if pending[byte] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, byte)
        sorted_ones = direct[bounds[byte] : bounds[byte + 1]]
        if len(sorted_ones):
            out.append(sorted_ones)
            induce(sorted_ones, byte)
    places = np.concatenate(out) if out else np.zeros(0, np.int64)
    return places[places % columns < count[places // columns]]


def common_prefix_reaches(grid: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether each place's suffix shares ``length`` bytes with the one before it in order."""
    flat = grid.reshape(-1)
    same = np.zeros(len(places), bool)
    at = np.arange(1, len(places))
    for depth in [*range(0, length - 7, 8), length - 8]:
        equal = _words(flat, places[at] + depth) == _words(flat, places[at - 1] + depth)
        at = at[equal]
    same[at] = True
    return same


def first_documents(grid: np.ndarray, width: int, count: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each row's window (row, column): the least doc of the rows where its bytes start, by the order of suffixes."""
    first = np.full((len(grid), int(count.max(initial=0))), _LAST)
    places = two_stage_sort(grid, width, count)
    if len(places):
        begin = np.nonzero(~common_prefix_reaches(grid, places, length))[0]
        row, col = np.divmod(places, grid.shape[1])
        first[row, col] = np.repeat(np.minimum.reduceat(doc[row], begin), np.diff(begin, append=len(places)))
    return first


def _repeats_in_bucket(count: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Intervals (row key, doc id, from, to) to remove, from the contexts of one bucket."""
    size = count.astype(np.int64) + length - 1
    raw, ends = text.tobytes(), np.cumsum(size)
    known: dict[bytes, int] = {}
    context = np.fromiter((known.setdefault(raw[e - s : e], len(known)) for e, s in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(size))
    n, width = len(known), int(size.max(initial=0))
    of = np.zeros(n, np.int64)
    of[context[::-1]] = np.arange(len(context))[::-1]
    least = np.full(n, _LAST)
    np.minimum.at(least, context, doc)
    columns = max(128, -(-width // 8) * 8 + 64)
    grid = np.zeros((n, columns), np.uint8)
    r = np.repeat(np.arange(n), size[of])
    grid.reshape(-1)[r * columns + _ranges(np.zeros(n, np.int64), size[of])] = text[_ranges(ends[of] - size[of], size[of])]
    first = first_documents(grid, width, count[of].astype(np.int64), least, length)
    out = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    for lo in range(0, len(context), 1 << 15):
        own = slice(lo, lo + (1 << 15))
        # A window goes from each occurrence whose document isn't the first one with it.
        edge = np.diff(np.pad(first[context[own]] < doc[own, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (k, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        start = at[own][k].astype(np.int64)
        out.append((row[own][k], doc[own][k], start + begin, start + end + length - 1))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeats(dealt: DataFrame, length: int, buckets: int) -> DataFrame:
    """Per document bucket, blobs of (row key, doc id, from, to) to remove."""

    def run(rows: pa.Table) -> pa.Table:
        row, doc, lo, hi = _repeats_in_bucket(*_blobs(rows), length)
        give_back()
        return _deal_table(1, np.mod(row, buckets), (row, doc, lo, hi))

    return dealt.groupBy("bucket").applyInArrow(run, "kind int, bucket int, blob binary")


def kept_bytes(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of text without the union of the intervals, the bytes removed and the maximal runs."""
    if not len(lo):
        return text, 0, 0
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    begin, end = lo[new], hi[np.concatenate([new[1:], [True]])]
    edges = [0, *np.stack([begin, end], 1).reshape(-1).tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, int((end - begin).sum()), len(begin)


def remove_repeats(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = (), as_text: bool = False, settle: bool = True, hot: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, the columns of ``keep``, n_bytes, n_removed, n_spans and kept of every document.

    kept is binary; ``as_text``: a string, without the characters that were cut in part, and null for null text.
    """
    if length < _KMER:
        raise ValueError(f"length must be {_KMER} or more")
    buckets = buckets_for(input_bytes(docs, "text"), BUCKET_BYTES)
    base = only(docs, "doc_id", "text", *keep).withColumn("row", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), _ROW_SHIFT))
    base = base.withColumn("text", F.col("text").cast("binary")).withColumn("doc_id", F.col("doc_id").cast("long"))
    lean = base.select("doc_id", "row", "text")
    found = Written(recurring(find_anchors(lean, length, buckets, settle), buckets, hot), "recurring", "none")
    marks = Written(repeats(contexts(lean, found.df, length, buckets), length, buckets), "repeats", "none")
    fields = [f for f in base.schema.fields if f.name in keep]
    kept_schema = pa.schema([("doc_id", pa.int64()), *[(f.name, _arrow(f.dataType)) for f in fields], ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if as_text else pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        entries, where = _per_row(_blobs(right) if right.num_rows else [np.zeros(0, np.int64)] * 4)
        none, out = slice(0, 0), []
        for text, row, doc in zip(left["text"].to_pylist(), left["row"].to_pylist(), left["doc_id"].to_pylist(), strict=True):
            s = where.get((row, _LAST if doc is None else doc), none)
            out.append((len(text or b""), *kept_bytes(text or b"", entries[2][s], entries[3][s])))
        kept = [x[1] for x in out]
        if as_text:
            kept = [None if t is None else k.decode("utf-8", "ignore") for k, t in zip(kept, left["text"].to_pylist(), strict=True)]
        columns = [left["doc_id"], *(left[c] for c in keep), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 2, 3)), pa.array(kept, kept_schema.field("kept").type)]
        return pa.Table.from_arrays(columns, schema=kept_schema)

    every = found.df.filter("kind = 1").select("bucket", "blob").union(marks.df.select("bucket", "blob"))
    cut = base.withColumn("bucket", F.pmod("row", F.lit(buckets)).cast("int"))
    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_bytes long, n_removed long, n_spans long", f"kept {'string' if as_text else 'binary'}"])
    return cut.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(run, schema)


def _arrow(kind):  # noqa: ANN001, ANN202
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
