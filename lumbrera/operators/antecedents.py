"""Where evidence stands in a text, and actions whose evidence tells of an earlier act."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.titles import MONTHS, has, has_earlier_date, title_actions
from .spans import places, section_at

#: More places of a piece of evidence, or more ways to join its pieces, leave it unlocated; pieces stand at most so far apart.
MOST_PLACES, MOST_GAP = 128, 6000
#: Characters before and after a place that are read for its signals.
CONTEXT = 260

# Letters that are written alike, and wording over the folded text.
_ALIKE = str.maketrans({"\u00a0": " ", "«": '"', "»": '"', "“": '"', "”": '"', "’": "'", "–": "-", "—": "-"})
_DATE = r"[0-3]?\d\s+de\s+(?:" + "|".join(MONTHS) + r")\s+de\s+(?:19|20)\d{2}"
RETROSPECTIVE = (
    r"\b(?:habiendo\s+sido|hab[ií]a\s+sido|"
    r"fue(?:ron)?\s+(?:sometid[ao]s?|formulad[ao]s?|notificad[ao]s?|publicad[ao]s?|emitid[ao]s?|otorgad[ao]s?|declarad[ao]s?|dictad[ao]s?)|"
    r"se\s+(?:formul[oó]|notific[oó]|public[oó]|someti[oó]|emiti[oó]|dict[oó])|solicit[oó]|subsanad[ao]s?)\b"
)
EARLIER_RESOLUTION = rf"\b(?:por|mediante|concretad[ao]\s+mediante)\s+(?:la\s+)?resoluci[oó]n\s+de\s+{_DATE}\b"
EARLIER_PUBLICATION = rf"\bpublicaci[oó]n\s+(?:de\s+fecha\s+|el\s+)?{_DATE}\b[^.]{{0,180}}\bbolet[ií]n\s+oficial\b"
FACTS = r"\bantecedentes?(?:\s+de)?\s+hecho\b"
GROUNDS = r"\bfundamentos?\s+de\s+derecho\b"
OPERATIVE = (
    r"\b(?:resuelve|resuelvo|acuerda)\b"
    r"(?=\s*(?::|\.|la\b|el\b|formular\b|otorgar\b|conceder\b|declarar\b|autorizar\b|aprobar\b|someter\b|primero\b|[0-9]+\.))"
)


@lru_cache(maxsize=4096)
def _letter(c: str) -> str:
    return unicodedata.normalize("NFKC", c).translate(_ALIKE).casefold()


def folded(text: str) -> tuple[str, np.ndarray]:
    """Compatibility form without case, white space single, and the place in the text of each of its characters."""
    parts = [_letter(c) for c in text]
    whole = "".join(parts)
    place = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    blank = np.fromiter(map(str.isspace, whole), bool, len(whole))
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    if (last := np.nonzero(~blank)[0]).size:
        keep[last[-1] + 1 :] = False
    if len(keep):
        keep[0] &= not blank[0]
    return "".join(" " if b else c for c, b, k in zip(whole, blank, keep, strict=True) if k), place[keep]


def _starts(text: str, piece: str) -> list[int]:
    found = [m.start() for m in re.finditer(f"(?={re.escape(piece)})", text)] if piece else []
    return found if len(found) <= MOST_PLACES else []


def spans(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the pieces in this order, each at most MOST_GAP after the one before."""
    ways: Counter[tuple[int, int]] = Counter()
    for k, piece in enumerate(pieces):
        starts, before = _starts(text, piece), ways
        ways = Counter()
        for s in starts:
            if not k:
                ways[s, s + len(piece)] += 1
            for (first, end), n in before.items():
                if end <= s <= end + MOST_GAP:
                    ways[first, s + len(piece)] += n
        if not ways:
            return []
    return sorted(ways) if sum(ways.values()) <= MOST_PLACES else []


_LOCATED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("title", T.StringType()), T.StructField("evidence", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("at", "to", "start", "end")]))),
])


@F.pandas_udf(_LOCATED)
def located(title: pd.Series, text: pd.Series, evidence: pd.Series) -> pd.DataFrame:
    """The folded text, title and evidence, and the places of the evidence: in the folded text (at, to) and the text itself (start, end)."""
    rows, known = [], {}
    for head, body, told in zip(title, text, evidence, strict=True):
        if body not in known:
            known.clear()  # rows of one document come together
            known[body] = folded(body or "")
        whole, place = known[body]
        pieces = [folded(p)[0] for p in re.split(r"\s*\[\.\.\.\]\s*", told or "") if p.strip()]
        found = spans(whole, pieces) if pieces and all(pieces) else []
        rows.append((whole, folded(head or "")[0], folded(told or "")[0], [{"at": a, "to": b, "start": int(place[a]), "end": int(place[b - 1]) + 1} for a, b in found]))
    return pd.DataFrame(rows, columns=["text", "title", "evidence", "spans"])


def _signals(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))


def possible_antecedents(actions: DataFrame) -> DataFrame:
    """The actions (with title, text, day, evidence, action_type) whose evidence may tell of an earlier act, with why.

    Each place of the evidence needs a temporal and a contextual signal and must not stand in the operative block;
    evidence that isn't found, or is the title, tells nothing. The columns are kept; spans, temporal and contextual are added.
    """
    rows = actions.withColumn("__l", located("title", "text", "evidence"))
    rows = rows.withColumns({f"__{n}": places(F.col("__l.text"), f"(?U){p}") for n, p in (("facts", FACTS), ("grounds", GROUNDS), ("operative", OPERATIVE))}).withColumn("__acts", title_actions(F.col("title")))
    text, first = F.col("__l.text"), F.array_min("__operative")

    def judged(s: Column) -> Column:
        section = section_at(s["at"], F.col("__facts"), F.col("__grounds"), F.col("__operative"))
        begin = F.greatest(s["at"] - CONTEXT, F.lit(0))
        around = F.substr(text, begin + 1, s["to"] + CONTEXT - begin)
        dated = lambda pattern: F.exists(F.regexp_extract_all(around, F.lit(f"(?U)({pattern})"), F.lit(1)), lambda m: has_earlier_date(m, F.col("day")))
        temporal = _signals({
            "evidence_in_antecedentes": section == "facts",
            "earlier_date_linked_to_retrospective_wording": has_earlier_date(around, F.col("day")) & has(around, RETROSPECTIVE),
            "explicit_earlier_resolution": dated(EARLIER_RESOLUTION), "explicit_earlier_boe_publication": dated(EARLIER_PUBLICATION),
        })
        later = lambda xs: F.exists(xs, lambda x: x > s["at"])
        contextual = _signals({
            "evidence_before_operative_block": s["to"] <= first,
            "documentary_section_separation": (section == "facts") & (later("__grounds") | later("__operative")),
            "title_declares_different_current_act": first.isNull() & (F.size("__acts") > 0) & ~F.array_contains("__acts", F.col("action_type")),
        })
        return F.struct(s.alias("span"), section.alias("section"), temporal.alias("temporal"), contextual.alias("contextual"))

    rows = rows.withColumn("__j", F.transform("__l.spans", judged))
    sound = F.forall("__j", lambda j: (j["section"] != "operative") & (F.size(j["temporal"]) > 0) & (F.size(j["contextual"]) > 0))
    found = rows.filter((F.size("__j") > 0) & sound & (F.col("__l.evidence") != F.col("__l.title")))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform("__j", lambda j: j[c])))).alias(c)
    return found.select(*actions.columns, F.transform("__j", lambda j: F.struct(j["span"]["start"].alias("start"), j["span"]["end"].alias("end"), j["section"].alias("section"))).alias("spans"), every("temporal"), every("contextual"))
