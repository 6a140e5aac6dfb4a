"""Quality classifier by co-training.

Two views of a document are learned apart: its content (words and the make-up
of its characters) and its page metadata (source, language label, length and
line layout). In every round each view labels the documents of an unlabelled
pool of which it is most certain, and the other view learns from them. Both are
calibrated on labelled documents that neither has seen, and the calibrated
log-odds are combined to score every document of the corpus.

Learned from about ``train_docs`` labelled and ``pool_docs`` unlabelled documents
at most, chosen by the hash of doc_id: bounded samples whatever the corpus.
A document is good if its quality is 1 and it isn't toxic.

Defined results: null and empty texts have no content features and are scored
by the rest; null metadata counts as a value of its own; labels with a null are
not learned; of several labels of a document the worst counts; without labels
of both kinds every document is kept with score 1. Repeated rows each get their
score, extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices

_WORDS = re.compile(r"[^\W\d_]+")
_SEED = 104729


def code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def character_shares(text: str, words: list[str], distinct: int) -> list[float]:
    n = max(len(text), 1)
    marks = [sum(map(text.count, chars)) / n for chars in ("!?", "#*$%&<>", "|", "0123456789", ".,;:")]
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, words)) / max(len(words), 1)
    return [np.sqrt(m) for m in marks] + [letters / n, upper, distinct / max(len(words), 1), float(not words)]


def layout(text: str) -> list[float]:
    lines = text.split("\n")
    return [np.log1p(len(text)), np.log1p(len(lines)), np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines)]


class Features(NamedTuple):
    """Codes (distinct, presence) and numbers of one view."""

    codes: np.ndarray
    numbers: np.ndarray


def content_view(text: str | None) -> tuple[set[str], list[float]]:
    words = _WORDS.findall(text or "")
    distinct = set(map(str.lower, words))
    return distinct, character_shares(text or "", words, len(distinct))


def metadata_view(source: str | None, lang: str | None, text: str | None) -> tuple[set[str], list[float]]:
    return {f"source={source}", f"lang={lang}"}, layout(text or "")


class Rows:
    """Documents of one view over a vocabulary of codes."""

    def __init__(self, features: list[Features], vocabulary: np.ndarray):
        place, count = [], []
        for f in features:
            at = np.searchsorted(vocabulary, f.codes).clip(0, max(len(vocabulary) - 1, 0)) if len(vocabulary) else f.codes[:0].astype(np.int64)
            at = at[vocabulary[at] == f.codes] if len(vocabulary) else at
            place.append(at)
            count.append(len(at))
        self.place = np.concatenate(place) if place else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(count)), count)
        self.numbers = np.array([f.numbers for f in features])
        self.n = len(features)

    def dot(self, weights: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.n) + self.numbers @ dense


class View:
    """Logistic regression on the presence of codes and on scaled numbers, with a calibration of its log-odds."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary, self.slope, self.shift = vocabulary, 1.0, 0.0

    def fit(self, features: list[Features], good: np.ndarray, penalty: float = 1e-3, steps: int = 150, rate: float = 0.1) -> None:
        rows, n = Rows(features, self.vocabulary), len(self.vocabulary)
        self.centre, self.scale = rows.numbers.mean(0), rows.numbers.std(0) + 1e-6
        rows.numbers = (rows.numbers - self.centre) / self.scale
        k = rows.numbers.shape[1]
        weight = np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9)) / len(good)
        theta = np.zeros(n + k + 1)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):  # full-batch steps scaled by the gradients' moments
            odds = rows.dot(theta[:n], theta[n:-1]) + theta[-1]
            error = weight * (1 / (1 + np.exp(-odds.clip(-30, 30))) - good)
            gradient = np.concatenate([np.bincount(rows.place, error[rows.row], n), rows.numbers.T @ error, [error.sum()]])
            gradient[:-1] += penalty * theta[:-1]
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        self.weights, self.dense, self.bias = theta[:n], theta[n:-1], theta[-1]

    def raw(self, features: list[Features]) -> np.ndarray:
        rows = Rows(features, self.vocabulary)
        rows.numbers = (rows.numbers - self.centre) / self.scale
        return rows.dot(self.weights, self.dense) + self.bias

    def calibrate(self, features: list[Features], good: np.ndarray) -> None:
        self.slope, self.shift = fit_small(self.raw(features)[:, None], good, np.array([1.0, 0.0]))

    def log_odds(self, features: list[Features]) -> np.ndarray:
        return self.slope * self.raw(features) + self.shift


def fit_small(x: np.ndarray, good: np.ndarray, start: np.ndarray, pull: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression of few columns and a constant by Newton steps, drawn towards ``start``."""
    x, theta = np.column_stack([x.clip(-20, 20), np.ones(len(x))]), start.astype(float).copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ theta).clip(-30, 30)))
        gradient = x.T @ (p - good) + pull * (theta - start)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(theta))
        move = np.linalg.solve(hessian, gradient)
        theta -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return theta


class Model(NamedTuple):
    content: View
    metadata: View
    mix: np.ndarray

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.mix[0] * content + self.mix[1] * metadata + self.mix[2]).clip(-500, 500)))


def vocabulary(features: list[Features], good: np.ndarray, most: int, least: int = 4) -> np.ndarray:
    """Codes in ``least`` documents or more; if too many, those whose share of good documents is furthest from the whole's."""
    found, at = np.unique(np.concatenate([f.codes for f in features]), return_inverse=True)
    own = np.repeat(good.astype(float), [len(f.codes) for f in features])
    n, n_good = np.bincount(at, minlength=len(found)), np.bincount(at, own, len(found))
    usual = n >= least
    found, n, n_good = found[usual], n[usual], n_good[usual]
    surprise = np.abs(n_good - n * good.mean()) / np.sqrt(n)
    return np.sort(found[np.lexsort((found, -surprise))[:most]])


def cotrain(labelled: list[tuple[Features, Features]], good: np.ndarray, pool: list[tuple[Features, Features]], rounds: int = 3, certain: float = 0.97, share: float = 0.1, most_words: int = 20_000) -> Model | None:
    """Every fifth labelled document is kept back for the calibration."""
    if good.all() or not good.any():
        return None
    back = np.arange(len(good)) % 5 == 4
    if good[back].all() or not good[back].any() or good[~back].all() or not good[~back].any():
        back = np.zeros(len(good), bool)
    learn, judge = np.nonzero(~back)[0], np.nonzero(back)[0] if back.any() else np.arange(len(good))
    views = [View(vocabulary([labelled[i][v] for i in learn], good[learn], most_words, 4 if v == 0 else 1)) for v in (0, 1)]
    known = [[labelled[i][v] for i in learn] for v in (0, 1)]
    truth = [good[learn].copy() for _ in views]
    free = np.ones(len(pool), bool)
    for turn in range(rounds + 1):
        for v, view in enumerate(views):
            view.fit(known[v], truth[v])
            view.calibrate([labelled[i][v] for i in judge], good[judge])
        if turn == rounds or not free.any():
            break
        for v, view in enumerate(views):  # the surest of this view teach the other
            odds = view.log_odds([p[v] for p in pool])
            for sign in (1, -1):
                quota = int(share * len(pool) * (good.mean() if sign > 0 else 1 - good.mean()))
                sure = np.nonzero(free & (sign * odds >= np.log(certain / (1 - certain))))[0]
                sure = sure[np.argsort(-sign * odds[sure], kind="stable")[:quota]]
                free[sure] = False
                known[1 - v] += [pool[i][1 - v] for i in sure]
                truth[1 - v] = np.concatenate([truth[1 - v], np.full(len(sure), sign > 0)])
    odds = np.column_stack([view.log_odds([labelled[i][v] for i in judge]) for v, view in enumerate(views)])
    prior = np.log(good.mean() / (1 - good.mean()))
    return Model(*views, fit_small(odds, good[judge], np.array([1.0, 1.0, -prior])))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, source, lang, good = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "source", "lang", "good"))
            out = [[] for _ in range(4)]
            for t, s, la in zip(text, source, lang, strict=True):
                for v, (words, numbers) in enumerate((content_view(t), metadata_view(s, la, t))):
                    out[2 * v].append(np.unique(np.fromiter(map(code, words), np.uint32, len(words))).tobytes())
                    out[2 * v + 1].append(np.array(numbers).tobytes())
            place = batch.column(batch.schema.get_field_index("place"))
            yield pa.RecordBatch.from_arrays([place, pa.array(good, pa.bool_()), *(pa.array(c, pa.binary()) for c in out)], names=["place", "good", "c0", "n0", "c1", "n1"])

    return docs.mapInArrow(run, "place long, good boolean, c0 binary, n0 binary, c1 binary, n1 binary")


def sample(docs: DataFrame, labels: DataFrame, train_docs: int, pool_docs: int) -> DataFrame:
    """About ``train_docs`` labelled (good true or false) and ``pool_docs`` other documents (good null), each by a fraction of its own.

    Labels are sampled before they meet the documents, so what is broadcast and
    collected is bounded whatever the numbers of labels and documents. Where
    there are more labels than ``train_docs``, documents whose label was not
    drawn may be in the pool.
    """
    parts = 1 << 60
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(_SEED)), F.lit(parts))
    share = lambda wanted, n: F.lit(max(1, int(min(1.0, wanted / max(n, 1)) * parts)))
    given = only(labels, "doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    given = given.withColumn("place", place)
    drawn = given.filter(F.col("place") < share(train_docs, given.count())).select("doc_id", "good")
    asked = only(docs, "doc_id", "text", "source", "lang").filter(F.col("doc_id").isNotNull()).withColumn("place", place)
    asked = asked.join(F.broadcast(drawn), "doc_id", "left").filter(F.col("good").isNotNull() | (F.col("place") < share(pool_docs, docs.count())))
    return asked.dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 6000, pool_docs: int = 4000, rounds: int = 3) -> Model | None:
    """Fit on bounded samples of the labelled and the other documents."""
    rows = _features(sample(docs, labels, train_docs, pool_docs)).toArrow().sort_by("place")
    features = [tuple(Features(np.frombuffer(c, np.uint32), np.frombuffer(n)) for c, n in ((a, b), (d, e))) for a, b, d, e in zip(*(rows[c].to_pylist() for c in ("c0", "n0", "c1", "n1")), strict=True)]
    truth = rows["good"].to_pylist()
    known = [i for i, g in enumerate(truth) if g is not None][:train_docs]
    pool = [i for i, g in enumerate(truth) if g is None][:pool_docs]
    if not known:
        return None
    return cotrain([features[i] for i in known], np.array([truth[i] for i in known]), [features[i] for i in pool], rounds)


class _Weights(dict):
    """word -> its weight in a view; emptied when full."""

    def __init__(self, view: View, most: int = 300_000):
        super().__init__()
        self._view, self._most = view, most

    def __missing__(self, word: str) -> float:
        known, c = self._view.vocabulary, code(word)
        at = int(np.searchsorted(known, c))
        weight = float(self._view.weights[at]) if at < len(known) and known[at] == c else 0.0
        if len(self) >= self._most:
            self.clear()
        self[word] = weight
        return weight


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """All columns of docs (doc_id, text, source and lang among them), content_score, metadata_score, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = [_Weights(v) for v in (model.content, model.metadata)] if model else []
        for batch in slices(batches, "text"):
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            n = batch.num_rows
            if model:
                odds = []
                views = ([content_view(t) for t in column("text")], [metadata_view(*x) for x in zip(column("source"), column("lang"), column("text"), strict=True)])
                for view, known, features in zip((model.content, model.metadata), weights, views, strict=True):
                    of_words = np.array([sum(map(known.__getitem__, words)) for words, _ in features])
                    numbers = (np.array([x for _, x in features]) - view.centre) / view.scale
                    odds.append(view.slope * (of_words + numbers @ view.dense + view.bias) + view.shift)
                scores = [*(1 / (1 + np.exp(-o.clip(-500, 500))) for o in odds), model.score(*odds)]
            else:
                scores = [np.ones(n)] * 3
            arrays = [*batch.columns, *(pa.array(s) for s in scores), pa.array(scores[2] >= least)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "content_score", "metadata_score", "score", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, content_score double, metadata_score double, score double, kept boolean")
