"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at
most ``distance`` bits, they differ in at most distance // segments bits of one
segment. Per segment, every fingerprint stands in a table under its segment's
value and probes the tables with all values in that small Hamming ball; matches
are held against the complete distance. Tables are dealt by the leading bits of
the segment: a probe travels only if a flipped bit is a leading one, and the
rest of the ball is enumerated within the task. A table part with many
fingerprints has its probes dealt over several tasks. Of the pairs found, a
task keeps a spanning forest, so groups of any size give links in proportion to
their members and lose none of the connections.

Defined results: null, empty and blank texts have fingerprint zero, which links
like any other; an empty table gives no rows; repeated rows share a fingerprint
and so a component; rows with a null doc_id get the component of their
fingerprint but never name one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, only, scratch_scope, slices
from .components import connected_components

SEED = 42

#: Bytes of shingle hashes that one task holds of a table part's rows, and of its probes.
BLOCK_BYTES = 16 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle (ASCII lower case, words between ASCII white space), repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [n - 1 for n in accumulate(len(w) + 1 for w in words)]
    starts = [0] + [n + 1 for n in ends[:-1]]
    out = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])] or [digest(joined, SEED)]  # noqa: B905
    return np.array(out, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; signed 64-bit."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known: dict[str | None, int] = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = fingerprint(shingle_hashes(text, width))
                out.append(known[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment of a 64-bit fingerprint."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def hamming_ball(bits: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits`` bits."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of all pairs (a, b), each hooking the larger root under the smaller."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def link_bucket(table: np.ndarray, probes: np.ndarray, low: int, bits: int, lead: int, radius: int, distance: int, most_pairs: int = 1 << 18) -> np.ndarray:
    """Parents over concatenated (table, probes) rows after linking probes to table rows within ``distance``.

    Only ball members whose leading bits match this table part are looked up here.
    """
    everyone = np.concatenate([table, probes])
    parent = np.arange(len(everyone))
    mask = np.uint64((1 << bits) - 1)
    value = (table >> np.uint64(low)) & mask
    order = np.argsort(value, kind="stable")
    value = value[order]
    part = value[0] >> np.uint64(bits - lead) if len(value) else np.uint64(0)
    segment = (probes >> np.uint64(low)) & mask
    for flip in hamming_ball(bits, radius):
        wanted = segment ^ flip
        mine = np.nonzero(wanted >> np.uint64(bits - lead) == part)[0]
        begin = np.searchsorted(value, wanted[mine], "left")
        n = np.searchsorted(value, wanted[mine], "right") - begin
        mine, begin, n = mine[n > 0], begin[n > 0], n[n > 0]
        total = np.cumsum(n)
        at = 0
        while at < len(mine):  # candidates in blocks of bounded size; one probe's matches in runs of rows
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most_pairs, "right")))
            count = n[at:to]
            probe = np.repeat(mine[at:to], count)
            rank = np.arange(len(probe)) - np.repeat(np.cumsum(count) - count, count)
            row = order[np.repeat(begin[at:to], count) + rank]
            close = np.bitwise_count(table[row] ^ probes[probe]) <= distance
            _join_up(parent, row[close], probe[close] + len(table))
            at = to
    return parent


def link_fingerprints(fps: DataFrame, distance: int = 4, segments: int = 3, part_rows: int = 20_000, probe_rows: int = 100_000) -> DataFrame:
    """Links (a, b) that connect the nodes of fps (fp, node; fp distinct) as all pairs within ``distance`` would."""
    spark, bounds, radius = fps.sparkSession, segment_bounds(segments), distance // segments
    n = fps.count()
    lead = max(2, min(16, (max(n, 1) // part_rows).bit_length()))
    flips = [[0, *(int(m) for m in hamming_ball(lead, radius)[1:])] for _ in bounds]
    code = lambda i: F.shiftrightunsigned(F.col("fp"), bounds[i][0] + bounds[i][1] - lead).bitwiseAND(F.lit((1 << lead) - 1))
    parts = F.array(*[(F.lit(i << lead) + code(i)).cast("int") for i in range(segments)])
    counts = fps.select(F.explode(parts).alias("k")).groupBy("k").agg((F.count(F.lit(1)) * len(flips[0])).alias("n"))
    # At most segments * 2**16 rows, whatever the number of fingerprints.
    hot = F.broadcast(Written(counts.filter(F.col("n") > probe_rows).select("k", F.ceil(F.col("n") / probe_rows).cast("int").alias("salts")), "hot-parts").df)
    salts = F.coalesce("salts", F.lit(1))
    probes = F.array(*[(F.lit(i << lead) + code(i).bitwiseXOR(F.lit(m))).cast("int") for i in range(segments) for m in flips[i]])
    asked = fps.select("fp", "node", F.explode(probes).alias("k")).join(hot, "k", "left").select("k", F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"), F.lit(False).alias("held"), "fp", "node")
    held = fps.select("fp", "node", F.explode(parts).alias("k")).join(hot, "k", "left").select("k", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("held"), "fp", "node")

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        held_ = rows["held"].to_numpy(zero_copy_only=False)
        fp, node = (rows[c].to_numpy() for c in ("fp", "node"))
        table, ask = fp[held_].view(np.uint64), fp[~held_].view(np.uint64)
        low, bits = bounds[key[0].as_py() >> lead]
        parent = link_bucket(table, ask, low, bits, lead, radius, distance) if len(table) else np.arange(len(fp))
        node = np.concatenate([node[held_], node[~held_]])
        root = _roots(parent, np.arange(len(parent)))
        tied = node != node[root]
        return pa.table({"a": node[tied], "b": node[root][tied]})

    return asked.union(held).groupBy("k", "salt").applyInArrow(link, "a long, b long")


def near_duplicate_components(docs: DataFrame, width: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links within ``distance`` bits."""
    fps = Written(fingerprints(docs, width), "fingerprints").df
    nodes = Written(fps.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes").df
    component = connected_components(link_fingerprints(nodes, distance, segments))
    named = nodes.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# Near-duplicates by similarity: the fingerprints propose, the shingles decide.


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for a second fingerprint."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _set_hash(distinct: np.ndarray) -> int:
    """Signed 64-bit hash of sorted distinct shingle hashes."""
    return int(np.array([xxhash.xxh3_64_intdigest(distinct.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def double_fingerprints(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, and of the text's distinct shingles two fingerprints (fp, fp2), their number (size), its order of magnitude to the base 1 / similarity (band) and a hash of them all (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known: dict[str | None, tuple[int, int, int, int, int]] = {}
            texts = batch.column(2).to_pylist()
            for text in texts:
                if text not in known:
                    h = np.unique(shingle_hashes(text, width))
                    band = int(np.log(max(len(h), 1)) / -np.log(similarity) + 1e-9)
                    known[text] = (fingerprint(h), fingerprint(_mixed(h)), len(h), band, _set_hash(h))
            columns = [pa.array([known[t][i] for t in texts], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "text_hash", "fp", "fp2", "size", "band", "node"])

    asked = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return asked.mapInArrow(run, "doc_id long, text_hash long, fp long, fp2 long, size long, band int, node long")


def _spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the edges of a minimum spanning forest."""
    parent, used = np.arange(n), []
    order = np.argsort(weight, kind="stable")
    cuts = np.nonzero(np.diff(weight[order]))[0] + 1
    for level in np.split(order, cuts):
        while len(level):
            x, y = _roots(parent, a[level]), _roots(parent, b[level])
            apart = x != y
            level, x, y = level[apart], x[apart], y[apart]
            if not len(level):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            first = np.lexsort((low, high))
            first = first[np.concatenate([[True], np.diff(high[first]) != 0])]
            parent[high[first]] = low[first]
            used.append(level[first])
    return np.concatenate(used) if used else np.zeros(0, np.int64)


def candidates(fp: np.ndarray, fp2: np.ndarray, held: np.ndarray, low: int, bits: int, radius: int, distance: int, most_pairs: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (table row, probe, distance over both fingerprints) of all pairs within ``distance`` that share the segment's ball."""
    mask = np.uint64((1 << bits) - 1)
    value = (fp >> np.uint64(low)) & mask
    table, probes = np.nonzero(held)[0], np.nonzero(~held)[0]
    table = table[np.argsort(value[table], kind="stable")]
    ordered, asked = value[table], value[probes]
    for flip in hamming_ball(bits, radius):
        begin = np.searchsorted(ordered, asked ^ flip, "left")
        n = np.searchsorted(ordered, asked ^ flip, "right") - begin
        mine = np.nonzero(n)[0]
        total, at = np.cumsum(n[mine]), 0
        while at < len(mine):
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most_pairs, "right")))
            count = n[mine[at:to]]
            probe = probes[np.repeat(mine[at:to], count)]
            row = table[np.repeat(begin[mine[at:to]] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            apart = np.bitwise_count(fp[row] ^ fp[probe]).astype(np.int64)
            near = np.nonzero(apart <= distance)[0]
            apart = apart[near] + np.bitwise_count(fp2[row[near]] ^ fp2[probe[near]])
            close = apart <= distance
            if close.any():
                yield row[near][close], probe[near][close], apart[close]
            at = to


def closest_forest(fp: np.ndarray, fp2: np.ndarray, held: np.ndarray, low: int, bits: int, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (row, row, distance over both fingerprints) of a minimum spanning forest of the table rows and their probes."""
    a = b = weight = np.zeros(0, np.int64)
    for found in candidates(fp, fp2, held, low, bits, radius, distance):
        a, b, weight = (np.concatenate(x) for x in zip((a, b, weight), found, strict=True))
        if len(a) > 4 * len(fp):
            keep = _spanning(len(fp), a, b, weight)
            a, b, weight = a[keep], b[keep], weight[keep]
    keep = _spanning(len(fp), a, b, weight)
    return a[keep], b[keep], weight[keep]


def _dealt(nodes: DataFrame, columns: list[str], segments: int, radius: int, part_rows: int, probe_rows: int) -> tuple[DataFrame, int]:
    """Rows (k, salt, held, columns) of every table part and its probes, and the number of leading bits in k.

    A part is a segment and a band of sizes, and in large bands also the
    segment's leading bits; probes go to the bands beside theirs, and to the
    parts that a flip of leading bits leads to.
    """
    bounds = segment_bounds(segments)
    counts = {r["band"]: r["n"] for r in nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    lead = min(12, (max(counts.values(), default=0) // part_rows).bit_length())
    flips = [int(m) for m in hamming_ball(lead, radius)]

    def key(i: int, shift: int, flip: int) -> Column:
        low, bits = bounds[i]
        code = F.shiftrightunsigned(F.col("fp"), low + bits - lead).bitwiseAND(F.lit((1 << lead) - 1)).bitwiseXOR(F.lit(flip))
        return ((F.col("band") + F.lit(shift)).cast("long") * segments + F.lit(i)) * F.lit(1 << lead) + code

    salted = {k: -(-sum(counts.get(k + d, 0) for d in (-1, 0, 1)) * len(flips) // (probe_rows << lead)) for k in counts}
    table = F.create_map(*[F.lit(x).cast("int") for kv in salted.items() for x in kv]) if salted else F.create_map(F.lit(0), F.lit(1))
    salts = F.coalesce(table[F.expr(f"CAST(k DIV {segments << lead} AS INT)")], F.lit(1))
    asked = nodes.select(*columns, F.explode(F.array(*[key(i, d, m) for i in range(segments) for d in (-1, 0, 1) for m in flips])).alias("k"))
    asked = asked.select("k", F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"), F.lit(False).alias("held"), *columns)
    held = nodes.select(*columns, F.explode(F.array(*[key(i, 0, 0) for i in range(segments)])).alias("k"))
    held = held.select("k", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("held"), *columns)
    return asked.union(held), lead


def propose_links(nodes: DataFrame, distance: int, segments: int, radius: int, part_rows: int = 200_000, probe_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between nodes (fp, fp2, band, node) that are closest in both fingerprints, a forest per table part."""
    columns, bounds = ["fp", "fp2", "node"], segment_bounds(segments)
    dealt, lead = _dealt(nodes, columns, segments, radius, part_rows, probe_rows)

    def link(of: tuple, rows: pa.Table) -> pa.Table:
        fp, fp2, node = (rows[c].to_numpy() for c in columns)
        flags = rows["held"].to_numpy(zero_copy_only=False)
        low, bits = bounds[(of[0].as_py() >> lead) % segments]
        # A node's own probe and table row are one vertex.
        distinct, vertex = np.unique(node, return_inverse=True)
        a, b, _ = closest_forest(fp.view(np.uint64), fp2.view(np.uint64), flags, low, bits, radius, distance) if flags.any() else (np.zeros(0, np.int64),) * 3
        x, y = distinct[vertex[a]], distinct[vertex[b]]
        apart = x != y
        return pa.table({"a": np.maximum(x, y)[apart], "b": np.minimum(x, y)[apart]})

    return dealt.groupBy("k", "salt").applyInArrow(link, "a long, b long").distinct()


def untested(rows: pa.Table, segment: int, bounds: list[tuple[int, int]], radius: int, distance: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the proposed pairs (row, row) of a table part whose ends no verified links join so far.

    Sizes must allow the similarity. Over all parts each pair comes once: in
    the first segment that has it, and as the probe of its larger node.
    """
    fp, fp2 = (rows[c].to_numpy().view(np.uint64) for c in ("fp", "fp2"))
    node, size, joined = (rows[c].to_numpy() for c in ("node", "size", "joined"))
    held = rows["held"].to_numpy(zero_copy_only=False)
    if not held.any():
        return
    for a, b, _ in candidates(fp, fp2, held, *bounds[segment], radius, distance):
        fits = (node[a] < node[b]) & (joined[a] != joined[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        for low, bits in bounds[:segment]:
            fits &= np.bitwise_count(((fp[a] ^ fp[b]) >> np.uint64(low)) & np.uint64((1 << bits) - 1)) > radius
        if fits.any():
            yield a[fits], b[fits]


class _Members:
    """Sets of 32-bit numbers, one after another, and how many of one set's numbers are in each of others."""

    def __init__(self, sets: pa.ChunkedArray):
        parts = [np.frombuffer(s.as_buffer(), "<u4") for s in sets]
        self.size = np.array([len(p) for p in parts], np.int64)
        self._numbers = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        self._end = np.cumsum(self.size)
        self._slot = np.full(1 << 16, -1, np.int64)

    def _of(self, i: int) -> np.ndarray:
        return self._numbers[self._end[i] - self.size[i] : self._end[i]]

    def common(self, one: int, others: np.ndarray, most: int = 1 << 21) -> np.ndarray:
        own, mask = self._of(one), np.uint32(len(self._slot) - 1)
        self._slot[own & mask] = own
        crowded = own[self._slot[own & mask] != own]  # another number has the slot
        out, ends, at = np.zeros(len(others), np.int64), np.cumsum(self.size[others]), 0
        while at < len(others):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            count = self.size[others[at:to]]
            start = np.cumsum(count) - count
            numbers = self._numbers[np.repeat(self._end[others[at:to]] - count - start, count) + np.arange(int(count.sum()))]
            hit = self._slot[numbers & mask] == numbers
            if len(crowded):
                hit |= np.isin(numbers, crowded)
            total = np.concatenate([[0], np.cumsum(hit)])
            out[at:to] = total[start + count] - total[start]
            at = to
        self._slot[own & mask] = -1
        return out


def verified_links(rows: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) with the similarity that connect the rows as all such pairs would; only pairs that earlier ones join are left out."""
    sets, parent = _Members(rows["shingles"]), np.arange(rows.num_rows)
    # A node's own probe and table row are one vertex, and so are nodes that verified links join already.
    _, first, vertex = np.unique(rows["joined"].to_numpy(), return_index=True, return_inverse=True)
    parent = np.minimum(parent, first[vertex])
    used: list[tuple[int, int]] = []
    for a, b in pairs:
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        edge = np.concatenate([[0], np.nonzero(np.diff(b))[0] + 1, [len(b)]])
        for at, to in zip(edge[:-1], edge[1:], strict=True):
            probe, mine = int(b[at]), a[at:to]
            mine = mine[_roots(parent, mine) != _roots(parent, np.array([probe]))]
            if not len(mine):
                continue
            both = sets.common(probe, mine)
            mine = mine[both >= similarity * (sets.size[mine] + sets.size[probe] - both)]
            # Of rows that are joined already, one link is enough.
            mine = mine[np.unique(_roots(parent, mine), return_index=True)[1]]
            _join_up(parent, mine, np.full(len(mine), probe))
            used += [(int(x), probe) for x in mine]
    ends = np.array(used, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def remaining_links(nodes: DataFrame, sets: DataFrame, distance: int, segments: int, radius: int, similarity: float, part_rows: int = 200_000, probe_rows: int = 20_000) -> DataFrame:
    """Verified links (a, b) among all proposed pairs of nodes (fp, fp2, band, size, node, joined) with different ``joined``.

    Nodes without such a pair stay behind before the shingles are brought in; a
    part with many shingles is dealt in blocks of table rows by blocks of probes.
    """
    columns, bounds = ["fp", "fp2", "node", "size", "joined"], segment_bounds(segments)
    dealt, lead = _dealt(nodes, columns, segments, radius, part_rows, probe_rows)
    schema = "k long, salt int, held boolean, fp long, fp2 long, node long, size long, joined long"
    segment = lambda k: (k >> lead) % segments

    def meet(of: tuple, rows: pa.Table) -> pa.Table:
        met = np.zeros(rows.num_rows, bool)
        for a, b in untested(rows, segment(of[0].as_py()), bounds, radius, distance, similarity):
            met[a] = met[b] = True
        return rows.select(["k", "salt", "held", *columns]).filter(pa.array(met))

    def verify(of: tuple, rows: pa.Table) -> pa.Table:
        node = rows["node"].to_numpy()
        a, b = verified_links(rows, untested(rows, segment(of[0].as_py()), bounds, radius, distance, similarity), similarity)
        return pa.table({"a": node[a], "b": node[b]})

    met = Written(dealt.groupBy("k", "salt").applyInArrow(meet, schema), "untested").df
    blocks = lambda held: F.ceil(F.sum(F.when(F.col("held") == held, F.col("size") * 4 + 1).otherwise(0)) / BLOCK_BYTES).cast("int")
    parts = met.groupBy("k", "salt").agg(blocks(True).alias("tables"), blocks(False).alias("probes"))
    own = lambda n: F.array(F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = met.join(parts, ["k", "salt"]).withColumn("table", F.explode(F.when(F.col("held"), own("tables")).otherwise(every("tables"))))
    placed = placed.withColumn("probe", F.explode(F.when(F.col("held"), every("probes")).otherwise(own("probes")))).drop("tables", "probes")
    return placed.join(sets, "node").groupBy("k", "salt", "table", "probe").applyInArrow(verify, "a long, b long")


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            distinct = [np.unique(shingle_hashes(t, width)) for t in batch.column(0).to_pylist()]
            sets = [np.unique(h >> np.uint64(32)).astype("<u4").tobytes() for h in distinct]
            yield pa.RecordBatch.from_arrays([pa.array([_set_hash(h) for h in distinct], pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def _same_row(docs: DataFrame) -> Column:
    """Rows are told apart by doc_id and text: those of docs against (__id, __hash)."""
    return (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))


def linked_sets(links: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """node and shingles (sorted 32-bit hashes of the distinct ones) of the links' ends; nodes: node and doc_id and text_hash of one text of it."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = Written(nodes.join(ends, "node", "left_semi").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "link-ends").df
    few = ends.count() <= broadcast_rows
    wanted = docs.join(F.broadcast(ends) if few else ends, _same_row(docs), "left_semi")
    return Written(_shingle_sets(wanted, width).dropDuplicates(["node"]), "shingle-sets").df


def similar_enough(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose documents' distinct shingles have a Jaccard similarity of ``similarity`` or more."""
    pairs = links.join(sets.withColumnsRenamed({"node": "a", "shingles": "s"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "t"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(s, "<u4"), np.frombuffer(t, "<u4")
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 32, segments: int = 4, radius: int = 2, broadcast_rows: int = 400_000) -> DataFrame:
    """doc_id, text_hash, component_id, component_hash: groups of documents linked by a Jaccard similarity of ``width``-word shingles of ``similarity`` or more.

    A group is named by its row with the least doc_id, and of rows with that
    doc_id the one with the least text_hash; rows with a null doc_id are left out.
    Texts with the same distinct shingles are one node. Links are
    proposed by multi-index hashing (every pair with at most
    segments * (radius + 1) - 1 different bits in the first fingerprint, and most
    pairs beyond) and held against the shingles themselves: first a minimum
    spanning forest by the distance over both fingerprints, and where a link of
    it fails, all other proposals that verified links don't join already.
    """
    fps = Written(double_fingerprints(docs, width, similarity).filter(F.col("doc_id").isNotNull()), "double-fingerprints").df
    nodes = Written(fps.groupBy("node", "fp", "fp2", "size", "band").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")), "double-nodes").df.select("node", "fp", "fp2", "size", "band", "row.*")
    links = Written(propose_links(nodes, distance, segments, radius), "proposed-links").df
    sets = linked_sets(links, nodes, docs, width, broadcast_rows)
    checked = Written(similar_enough(links, sets, similarity), "checked-links").df
    component = connected_components(checked)
    failed = links.join(checked, ["a", "b"], "left_anti")
    if failed.limit(1).count():
        proposed = connected_components(links).withColumnRenamed("component", "proposed")
        unsettled = failed.select(F.col("a").alias("node")).join(proposed, "node").select("proposed").distinct()
        still = nodes.join(proposed.join(unsettled, "proposed", "left_semi"), "node").join(component, "node", "left")
        still = Written(still.select("fp", "fp2", "band", "size", "node", F.coalesce("component", "node").alias("joined")), "unsettled-nodes").df
        more = Written(remaining_links(still, sets, distance, segments, radius, similarity), "remaining-links").df
        component = connected_components(checked.union(more)) if more.limit(1).count() else component
    named = nodes.join(component, "node", "left").select("node", F.struct("doc_id", "text_hash").alias("row"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("row").alias("least"))
    named = Written(named.join(least, "component").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("component_hash")), "named-nodes").df
    return fps.join(named, "node").select("doc_id", "text_hash", "component_id", "component_hash")


def keep_one_of_each(docs: DataFrame, broadcast_rows: int = 400_000, **options: float) -> DataFrame:
    """docs without the rows whose component is named by another, and of rows equal in doc_id and text one; rows with a null doc_id stay."""
    with scratch_scope("gone"):
        found = Written(similar_components(docs, **options), "components").df
        others = found.filter("doc_id <> component_id OR text_hash <> component_hash")
        gone = Written(others.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "gone").df
        again = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    kept = docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, _same_row(docs), "left_anti")
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(kept.filter("doc_id IS NULL")) if again else kept
