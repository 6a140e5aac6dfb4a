"""URL filter: a weighted vocabulary found by Aho-Corasick, and allow and block rules by host and path.

A term counts only between boundaries (no ASCII letter or digit beside it, in
the lower-cased URL). A term of weight 1 or more is strict: one blocks a URL.
Others are soft: several distinct ones whose weights sum to 1 block it. The
production list gives soft terms 1 / LEAST_SOFT; ``read_weights`` reads another. A rule for a host and a path prefix decides before the vocabulary;
it holds for the host and its subdomains, and of several the longest wins (of
equally long ones the one with the longer host).

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule; the vocabulary still reads what is there. Empty tables give no
rows, repeated rows each get theirs, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

# The production vocabulary.
STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "camgirl", "camgirls", "milf", "escort", "escorts", "viagra", "cialis", "warez", "torrent", "keygen", "casino", "slots")
SOFT_TERMS = ("adult", "bet", "betting", "cheap", "coupon", "crack", "dating", "deal", "download", "forex", "free", "gambling", "hot", "loan", "nude", "pharmacy", "pills", "poker", "sex", "sexy", "stream", "win")
LEAST_SOFT = 2


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_and_path(url: str | None) -> tuple[str, str]:
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return _lower(host), path


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class RuleBook:
    """Finds the longest rule by looking up the host's suffixes."""

    def __init__(self, rules: Sequence[Rule]):
        self._by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: -len(r.path)):
            self._by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> Rule | None:
        best, suffix = None, host
        while suffix:
            fit = next((r for r in self._by_host.get(suffix, ()) if path.startswith(r.path)), None)
            if fit and (best is None or len(fit.host) + len(fit.path) > len(best.host) + len(best.path)):
                best = fit
            _, _, suffix = suffix.partition(".")
        return best


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def vocabulary_hits(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """The distinct strict and soft terms that stand between boundaries."""
    hits: tuple[set[str], set[str]] = (set(), set())
    if url and (strict or soft):
        text = _lower(url)
        for end, (term, is_strict) in _automaton(strict, soft).iter(text):
            start = end - len(term) + 1
            if (not start or text[start - 1] not in _INNER) and (end + 1 == len(text) or text[end + 1] not in _INNER):
                hits[not is_strict].add(term)
    return hits


#: The production list as weights.
WEIGHTS = dict.fromkeys(STRICT_TERMS, 1.0) | dict.fromkeys(SOFT_TERMS, 1 / LEAST_SOFT)


def read_weights(path: str) -> dict[str, float]:
    """Terms and weights of a file: a term, a tab and its weight a line; lower-cased, blank lines left out."""
    with open(path, encoding="utf-8") as lines:
        rows = [line.rstrip("\n").rpartition("\t") for line in lines if line.strip()]
    return {_lower(term.strip()): float(weight) for term, _, weight in rows}


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, weights: Mapping[str, float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft (distinct terms)."""
    weights = dict(WEIGHTS if weights is None else weights)
    rules, strict, soft = tuple(rules), tuple(t for t, w in weights.items() if w >= 1), tuple(t for t, w in weights.items() if w < 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = RuleBook(rules)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                rule = book.find(host, path)
                hard, mild = vocabulary_hits(url, strict, soft)
                heavy = len(mild) > 1 and sum(weights[t] for t in mild) >= 1 - 1e-9
                verdict = rule.verdict if rule else "block" if hard or heavy else "allow"
                out.append((host, path, rule and rule.host + rule.path, verdict, len(hard), len(mild)))
            columns = [[x[i] for x in out] for i in range(6)]
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    asked = only(pages, "page_id", "url").select(F.col("page_id").cast("long"), "url")
    return asked.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int")
