"""Quality rules: base counts, and divergence from language references.

Two histograms of a document, its character classes and its common words, are
compared with references by Jensen-Shannon distance. A reference is the summed
histogram of all documents of a language (column ``lang``) that pass the base
rules; over MOST_LANGUAGES languages are an error. A document is held against the
closest reference of each kind, whatever its own label. Short texts differ from any reference by chance, so texts under
``least_words`` are not judged by distance, and the limits have an allowance
that falls with the square root of the number of words.

Defined results: null and empty texts have no words and fail the base rules; an
empty table gives no rows; without any labelled document there is no reference
and the base rules decide alone. Repeated rows each get theirs, extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, only, slices

_SPACE = " \t\n\r\v\f"
_SYMBOLS = "#*$%&|<>"

#: References are collected, one row per language.
MOST_LANGUAGES = 1000

# Common words of the languages in the corpus.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which"
    " de la le et les des en un une du que est pour dans qui par sur au plus ne se il elle sont avec pas ce"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " el que y los se del las con no su al lo como más pero sus o si entre cuando muy sin sobre también me hasta hay donde quien"
).split()
WORD_SLOTS = {w: i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}

#: Character classes, by UTF-8 byte; a character beyond ASCII counts by its first byte.
CLASSES = ("space", "newline", "lower", "upper", "digit", "stop", "mark", "symbol", "bracket", "other", "beyond")


def _byte_classes() -> np.ndarray:
    kind = np.full(256, CLASSES.index("other"))
    for name, chars in (("space", " \t\r\v\f"), ("newline", "\n"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("stop", ".,;:"), ("mark", "!?\"'-"), ("symbol", "#*$%&|<>@=+~^_\\/`"), ("bracket", "()[]{}")):
        kind[[ord(c) for c in chars]] = CLASSES.index(name)
    kind[0xC0:] = CLASSES.index("beyond")
    kind[0x80:0xC0] = len(CLASSES)  # inner bytes of a character
    return kind


_KIND = _byte_classes()


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(code: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; code: a number per word, from 0."""
    if len(code) < 4:
        return 0
    key, n = code[:-2].astype(np.int64), int(code.max()) + 1
    for following in (code[1:-1], code[2:]):
        if n**3 >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * n + following
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(code), bool)
    for shift in range(3):
        hit[shift : shift + len(again)] |= again
    return int(hit.sum())


def base_counts(text: str, words: list[bytes]) -> Counts:
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    index: dict[bytes, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    spaces = sum(map(text.count, _SPACE))
    return Counts(len(words), len(text) - spaces, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(code))


def base_failed(c: Counts) -> bool:
    return c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words


def histograms(data: bytes, words: list[bytes]) -> np.ndarray:
    """Counts by character class, then by common word and of all other words."""
    classes = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    slots = np.zeros(len(WORD_SLOTS) + 1, np.int64)
    get, rest = _LOOKUP.get, len(WORD_SLOTS)
    found = np.fromiter((get(w, rest) for w in words), np.int64, len(words))
    slots += np.bincount(found, minlength=len(slots))
    return np.concatenate([classes, slots])


#: Common words as they occur: plain or capitalised, with or without a comma or full stop.
_LOOKUP = {(form + end).encode(): i for w, i in WORD_SLOTS.items() for form in (w, w.capitalize()) for end in ("", ",", ".")}


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances (0 to 1) of the histograms in the rows of p from those of q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    out = np.empty((len(p), len(q)))
    entropy = lambda x: -(x * np.log2(np.maximum(x, 1e-300))).sum(1)
    own, other = entropy(p), entropy(q)
    for j in range(len(q)):
        out[:, j] = entropy((p + q[j]) / 2) - (own + other[j]) / 2
    return np.sqrt(out.clip(0, 1))


def _measured(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list[list], list[Counts], np.ndarray]]:
    for batch in slices(batches, "text"):
        counts, histogram = [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            data = (text or "").encode("utf-8", "surrogatepass")
            words = data.split()
            counts.append(base_counts(text or "", words))
            histogram.append(histograms(data, words))
        yield [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], counts, np.array(histogram)


_BINS = len(CLASSES) + len(WORD_SLOTS) + 1


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed and the histograms (array of long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, langs), counts, histogram in _measured(batches, "doc_id", "lang"):
            columns = [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True))]
            columns += [pa.array([base_failed(c) for c in counts]), pa.FixedSizeListArray.from_arrays(pa.array(histogram.reshape(-1).astype(np.int32)), _BINS).cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *Counts._fields, "base_failed", "histogram"])

    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in Counts._fields) + ", base_failed boolean, histogram array<int>"
    asked = only(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    return asked.mapInArrow(run, schema)


def _summed(histograms: DataFrame) -> DataFrame:
    """lang, bin, n: the sums of (lang, histogram) over each task, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            langs, sums = list(held), np.array(list(held.values())).reshape(-1)
            held.clear()
            bins = np.tile(np.arange(_BINS, dtype=np.int32), len(langs))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(langs, object), _BINS), pa.string()), pa.array(bins), pa.array(sums)], names=["lang", "bin", "n"])

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code, rows = langs.indices.to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, _BINS)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang] = held.get(lang, 0) + rows[code == k].sum(0, dtype=np.int64)
            if len(held) > MOST_LANGUAGES:
                yield flush()
        if held:
            yield flush()

    return histograms.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def references(measured: DataFrame) -> dict[str, np.ndarray]:
    """The summed histogram of each language."""
    usable = measured.filter(F.col("lang").isNotNull() & ~F.col("base_failed")).select("lang", "histogram")
    rows = _summed(usable).limit(MOST_LANGUAGES * _BINS + 1).collect()
    if len(rows) > MOST_LANGUAGES * _BINS:
        raise ValueError(f"over {MOST_LANGUAGES} labels in lang")
    out: dict[str, np.ndarray] = {}
    for lang, at, n in rows:
        out.setdefault(lang, np.zeros(_BINS))[at] = n
    return dict(sorted(out.items()))


def judge(docs: DataFrame, class_limit: float = 0.24, word_limit: float = 0.27, allowance: float = 0.75, least_words: int = 50) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance and kept."""
    measured = Written(measure(docs), "quality-counts").df
    known = references(measured)
    reference = np.array(list(known.values())) if known else np.zeros((0, _BINS))
    split = len(CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            n, failed = column("n_words").to_numpy(), column("base_failed").to_numpy(zero_copy_only=False)
            histogram = column("histogram").flatten().to_numpy().reshape(-1, _BINS).astype(np.float64)
            if len(reference):
                by_class = jensen_shannon(histogram[:, :split], reference[:, :split]).min(1)
                by_word = jensen_shannon(histogram[:, split:], reference[:, split:]).min(1)
            else:
                by_class = by_word = np.zeros(len(n))
            slack = allowance / np.sqrt(np.maximum(n, 1))
            far = (n >= least_words) & ((by_class > class_limit + slack / 2) | (by_word > word_limit + slack))
            arrays = [column("doc_id"), *(column(c) for c in Counts._fields), column("base_failed"), pa.array(by_class), pa.array(by_word), pa.array(~failed & ~far)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *Counts._fields, "base_failed", "class_distance", "word_distance", "kept"])

    schema = ", ".join(chain(["doc_id long"], (f"{c} long" for c in Counts._fields), ["base_failed boolean, class_distance double, word_distance double, kept boolean"]))
    return measured.mapInArrow(run, schema)
