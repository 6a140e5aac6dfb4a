"""Language identification by a string kernel.

The kernel counts the byte n-grams (n from 1 to 3, lower case, letters and
blanks only) that two texts have in common, each present or not: the blended
spectrum kernel over presence, on the n-grams that landmarks have, normalised to
1 for a text with itself. Nystroem landmarks stand for the kernel's feature space, kernel ridge regression is
solved for one language against the rest on them, and since the kernel is linear
in the presence vector, scoring a batch is a product of its presence matrix with
the landmarks' n-grams and one with the coefficients.

Every language is learned, from about ``train_docs`` labelled documents of it
(those with the least hash of their id, in expectation that many; fewer of each
where there are over SAMPLE_DOCS / ``train_docs`` languages), with ``landmarks``
of them or one per language: a bounded sample, the same whatever the order of
rows. Over MOST_LANGUAGES labels are an error.

Defined results: ``und`` with score 0 for null text or text without a letter,
and for all texts if there is nothing to learn from; labels that are null are
not learned; ties go to the language that sorts first. Very long texts are read
whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices

# Byte n-gram lengths, and the alphabet that bytes are folded to.
_N = (1, 2, 3)
_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(1, 27)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_FOLD[0x80:] = 27 + np.arange(128) % 100  # bytes beyond ASCII, apart as far as the alphabet has room
_BASE = 128

#: Documents of all languages in the sample, as far as each language has LEAST_DOCS of its own.
SAMPLE_DOCS, LEAST_DOCS = 20_000, 20
MOST_LANGUAGES = 1000


def gram_codes(text: bytes) -> np.ndarray:
    """Code of every n-gram occurrence; a run of anything but letters is one blank, as are both ends."""
    folded = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    folded = folded[np.concatenate([[True], (folded[1:] != 0) | (folded[:-1] != 0)])].astype(np.int32)
    out = []
    for n in _N:
        if len(folded) >= n:
            code = folded[: len(folded) - n + 1].copy()
            for j in range(1, n):
                code = code * _BASE + folded[j : len(folded) - n + 1 + j]
            out.append(code + sum(_BASE**k for k in range(1, n)))
    return np.concatenate(out)


_SIZE = _BASE + _BASE**2 + _BASE**3
_BLOCK = 1 << 20


def gram_blocks(text: bytes) -> Iterator[np.ndarray]:
    """n-gram codes of a whole text, in blocks that overlap by the longest n-gram less one."""
    for at in range(0, max(len(text), 1), _BLOCK):
        yield gram_codes(text[max(0, at - max(_N) + 1) : at + _BLOCK])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model(NamedTuple):
    """Languages, n-gram codes of the landmarks, landmark rows over those codes, and one-versus-rest coefficients."""

    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    coefficients: np.ndarray
    bias: np.ndarray
    sharpness: float


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = 200, ridge: float = 1e-3, sharpness: float = 4.0) -> Model | None:
    """sets: distinct n-gram codes of each text. Landmarks are taken by turns from each language, in the given order."""
    languages = sorted(set(labels))
    if not languages:
        return None
    turn, ranked = dict.fromkeys(languages, 0), []
    for i, lang in enumerate(labels):
        ranked.append((turn[lang], i))
        turn[lang] += 1
    chosen = [i for _, i in sorted(ranked)[: max(landmarks, len(languages))]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))

    def rows(which: list[int]) -> np.ndarray:
        out = np.zeros((len(which), len(grams)), np.float32)
        for r, i in enumerate(which):
            at = np.searchsorted(grams, sets[i]).clip(0, len(grams) - 1)
            at = at[grams[at] == sets[i]]
            out[r, at] = 1 / np.sqrt(max(len(at), 1))
        return out

    marks = rows(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    usable = values > values.max() * 1e-6
    whiten = vectors[:, usable] / np.sqrt(values[usable])
    features = np.concatenate([(rows([*range(a, min(a + 512, len(sets)))]) @ marks.T) @ whiten for a in range(0, len(sets), 512)])
    goal = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = (goal > 0).mean(0)
    weight = 1 / share[np.argmax(goal, 1)]  # every language counts alike
    weight = (weight / weight.mean())[:, None]
    centre, mean = (features * weight).mean(0), (goal * weight).mean(0)
    centred = features - centre
    left = (centred * weight).T @ centred + ridge * len(sets) * np.eye(features.shape[1])
    solved = np.linalg.solve(left, (centred * weight).T @ (goal - mean))
    return Model(languages, grams, marks, (whiten @ solved).astype(np.float32), (mean - centre @ solved).astype(np.float32), sharpness)


class Scorer:
    """Labels and scores by batches: presence matrix x landmark rows x coefficients."""

    def __init__(self, model: Model, rows: int = 128):
        self._model, self._rows = model, rows
        self._slot = np.full(_SIZE, len(model.grams), np.int32)  # the last column takes n-grams that no landmark has
        self._slot[model.grams] = np.arange(len(model.grams))
        self._weights = model.landmarks.T @ model.coefficients

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model, n = self._model, len(self._model.grams)
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(asked), self._rows):
            own = asked[at : at + self._rows]
            present = np.zeros((len(own), n + 1), np.float32)
            for row, i in zip(present, own, strict=True):
                for codes in gram_blocks(texts[i].encode("utf-8", "surrogatepass")):
                    row[self._slot[codes]] = 1
            present = present[:, :n]
            length = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
            value = present @ self._weights / length + model.bias
            odds = np.exp(model.sharpness * (value - value.max(1, keepdims=True)))
            best = value.argmax(1)
            score = odds[np.arange(len(own)), best] / odds.sum(1)
            for r, i in enumerate(own):
                names[i], scores[i] = model.languages[best[r]], float(score[r])
        return names, scores


def labelled_sample(docs: DataFrame, train_docs: int) -> tuple[list[np.ndarray], list[str]]:
    """Distinct n-gram codes and labels of about ``train_docs`` documents per language, chosen by the hash of their ids."""
    usable = only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return [], []
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} labels in lang")
    train_docs = min(train_docs, max(LEAST_DOCS, SAMPLE_DOCS // len(counts)))
    parts = 1 << 60
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, int(min(1.0, train_docs / n) * parts)))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts))
    sample = usable.filter(place < limits[F.col("lang")]).dropDuplicates(["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes = [np.unique(np.concatenate([*map(np.unique, gram_blocks(t.encode("utf-8", "surrogatepass")))])) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([c.astype("<i4").tobytes() for c in codes], pa.binary()), batch.column(1), batch.column(2)], names=["codes", "lang", "place"])

    found = sample.select("text", "lang", place.alias("place")).mapInArrow(run, "codes binary, lang string, place long").toArrow()
    found = found.sort_by([("place", "ascending"), ("lang", "ascending"), ("codes", "ascending")])
    return [np.frombuffer(c, "<i4") for c in found["codes"].to_pylist()], found["lang"].to_pylist()


def identify(docs: DataFrame, labelled: DataFrame, train_docs: int = 400, landmarks: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred and score for every document, learned from ``labelled`` (doc_id, text, lang)."""
    model = fit(*labelled_sample(labelled, train_docs), landmarks=landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = docs.select(F.col("doc_id").cast("long"), *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in slices(batches, "text"):
            texts = batch.column(len(keep) + 1).to_pylist()
            names, scores = scorer.predict(texts) if scorer else (["und"] * len(texts), [0.0] * len(texts))
            columns = [*batch.columns[:-1], pa.array(names), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, "lang_pred", "score"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asked.schema.fields if f.name in keep)
    return asked.mapInArrow(run, f"doc_id long, {kept}lang_pred string, score double")
