"""Best-fit packing of token sequences through a configuration linear program.

Every document becomes its ids and an end id. Longer documents are cut into
full pieces, the first of which takes the remainder. Only the histogram of
piece lengths (at most ``capacity`` counts, whatever the corpus size) reaches
the driver, where the configuration linear program over it is solved by
multiplicative weights; a knapsack dynamic program over the current prices
finds the configurations. Rounding down leaves a residual histogram that is
solved again and at last placed by best fit, all on counts. The plan goes back
as a table of intervals per length, bounded by ``capacity`` and ``rounds``;
each piece finds its place from its rank among the pieces of its length.

Defined results: null or empty text is one piece with the end id alone; an
empty table gives no rows; repeated rows are packed as often as they occur;
ties in length are placed by rank. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Written, give_back, only, slices
from .tokens import encoder, public_path

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: highest price of a configuration of at most c tokens; pick[c]: the index of its last length, -1 for slack."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            values = prices[:k] + best[c - lengths[:k]]
            if values[at := int(values.argmax())] > best[c] + 1e-12:
                best[c], pick[c] = values[at], at
    return best, pick


def _configuration(pick: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    held: dict[int, int] = defaultdict(int)
    while room > 0:
        if (at := int(pick[room])) < 0:
            room -= 1
        else:
            held[at] += 1
            room -= int(lengths[at])
    return held


def solve_fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, step: float, near: float = 0.05) -> dict[tuple, float]:
    """Multiplicative weights on min sum(x) with every length covered.

    In each round the dearest configuration and those nearly as dear, at most
    one for each length, are taken as far as the scarcest length in them allows;
    then the lengths that they cover become cheaper.
    """
    prices, load = lengths / capacity, np.zeros(len(lengths))
    x: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        best, pick = _knapsack(lengths, prices, capacity)
        worth = prices + best[capacity - lengths]
        taken = set()
        for at in np.nonzero(worth >= (1 - near) * worth.max())[0].tolist():
            held = _configuration(pick, lengths, capacity - int(lengths[at]))
            held[at] += 1
            taken.add(tuple(sorted(held.items())))
        gain = np.zeros(len(lengths))
        for held in taken:
            amount = min(demand[i] / c for i, c in held)
            x[held] += amount
            for i, c in held:
                gain[i] += amount * c / demand[i]
        load += gain
        prices = prices * np.exp(-step * gain / gain.max())
        prices = prices / prices.max()
    return {held: amount / max(load[i] for i, _ in held) for held, amount in x.items()}


def _best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit in decreasing order on counts: groups of equal sequences are split only where a count ends."""
    from bisect import bisect_left, insort

    groups: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, held: dict[int, int], n: int) -> None:
        if not groups[gap]:
            insort(gaps, gap)
        groups[gap].append((held, n))

    for at in range(len(lengths) - 1, -1, -1):
        size, left = int(lengths[at]), int(demand[at])
        while left:
            if (k := bisect_left(gaps, size)) == len(gaps):
                gap, held, n = capacity, {}, left
            else:
                gap = gaps[k]
                held, n = groups[gap].pop()
                if not groups[gap]:
                    gaps.pop(k)
            each = min(gap // size, left)
            used = min(n, left // each)
            if held and used < n:
                put(gap, held, n - used)
            left -= used * each
            put(gap - each * size, {**held, at: held.get(at, 0) + each}, used)
    return [g for found in groups.values() for g in found]


def plan_packing(histogram: dict[int, int], capacity: int, rounds: int = 80, step: float = 0.3, passes: int = 2) -> list[tuple[dict[int, int], int]]:
    """Configurations ({length: count}, copies) that hold exactly the pieces of the histogram."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), dtype=np.int64)
    demand = np.array([histogram[k] for k in lengths], dtype=np.int64)
    plan: dict[tuple, int] = defaultdict(int)
    for _ in range(passes):
        open_ = np.nonzero(demand)[0]
        if not len(open_):
            break
        x = solve_fractional(lengths[open_], demand[open_].astype(float), capacity, rounds, step)
        before = demand.sum()
        for held, amount in sorted(x.items(), key=lambda kv: (-kv[1], kv[0])):
            copies = min(int(amount), *(int(demand[open_[i]]) // c for i, c in held))
            if copies:
                plan[tuple((int(open_[i]), c) for i, c in held)] += copies
                for i, c in held:
                    demand[open_[i]] -= copies * c
        if demand.sum() > 0.9 * before:
            break
    for held, copies in _best_fit(lengths, demand, capacity):
        plan[tuple(sorted(held.items()))] += copies
    out = [({int(lengths[i]): c for i, c in held}, n) for held, n in sorted(plan.items())]
    if histogram.get(capacity):
        out.append(({capacity: 1}, histogram[capacity]))
    return out


_SPAN = 1 << 48


class _Places:
    """Per length, the intervals of ranks and the configuration that takes each."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows, sequence, taken = [], 0, defaultdict(int)
        for held, copies in plan:
            offset = 0
            for length, count in sorted(held.items(), reverse=True):
                rows.append((length * _SPAN + taken[length], sequence, count, offset))
                taken[length] += copies * count
                offset += length * count
            sequence += copies
        rows.sort()
        self.key, self.sequence, self.count, self.offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * _SPAN + rank
        at = np.searchsorted(self.key, key, "right") - 1
        copy, place = np.divmod(key - self.key[at], self.count[at])
        return self.sequence[at] + copy, self.offset[at] + place * length


def cut_pieces(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, capacity: int, slice_bytes: int) -> DataFrame:
    """doc_id and pieces with their ids (little-endian unsigned 32-bit), numbered by length within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = encoder(tokenizer, spaced), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", slice_bytes):
            out = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_many(batch.column(1).to_pylist()), strict=True):
                ids += end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n % capacity or min(n, capacity)) if not piece else capacity
                    for column, value in zip(out, (doc, piece, start, length, ids[4 * start : 4 * (start + length)], part, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            out.clear()
            give_back()  # else what allocators keep of each slice adds up to nearly as much as all that is in use
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 0,
    capacity: int = 2048,
    spaced: bool = True,
    rounds: int = 80,
    keep: tuple[str, ...] = ("ids",),
    slice_bytes: int = 2 * SLICE_BYTES,
) -> DataFrame:
    """Each piece with ``sequence_id`` and ``offset``; ``keep`` names ``ids`` and/or ``ids_crc32``.

    ``slice_bytes`` of text are encoded at a time: more cost memory and save lookups.
    """
    pieces = Written(cut_pieces(docs, tokenizer or public_path("byte_bpe_50k.json"), spaced, end_id, capacity, slice_bytes), "pieces").df
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _Places(plan_packing(histogram, capacity, rounds))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = [F.crc32("ids").alias(c) if c == "ids_crc32" else F.col(c) for c in keep]
    ranked = pieces.select("doc_id", "piece", "start", "length", *kept, "part", "rank").join(base, ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", *keep, "sequence_id", "offset"])

    kinds = {"ids": "ids binary", "ids_crc32": "ids_crc32 long"}
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    return ranked.mapInArrow(place, ", ".join(["doc_id long, piece int, start long, length long", *(kinds[c] for c in keep), "sequence_id long, offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length and ids in place; a group holds at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
