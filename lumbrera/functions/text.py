"""Text functions as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII: (from, to) of those with one, and those with more."""
    single, multi = {}, {}
    for point in range(0x80, sys.maxunicode + 1):
        # Most planes have none; surrogates are no characters.
        if unicodedata.decomposition(chr(point)) and (ascii_ := unicodedata.normalize("NFKD", chr(point)).lower().encode("ascii", "ignore").decode()):
            (single if len(ascii_) == 1 else multi)[chr(point)] = ascii_
    return "".join(single), "".join(single.values()), multi


def _ranges(letters: Iterable[str]) -> str:
    """A character class of the letters, runs as ranges."""
    out: list[list[int]] = []
    for point in sorted(map(ord, letters)):
        if out and point == out[-1][1] + 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


@lru_cache(maxsize=1)
def _special() -> str:
    return _ranges(_folds()[2])


def normalize(text: Column) -> Column:
    """Lower case without accents; other non-ASCII characters vanish, runs of anything but letters and digits are one space; null is ''.

    Texts with a character that stands for several letters are taken apart letter by letter, all others are translated.
    """
    source, target, multi = _folds()
    lowered = F.lower(F.coalesce(text, F.lit("")))
    ascii_only = F.octet_length(lowered) == F.char_length(lowered)
    letters = "".join(multi)
    known = F.split(F.lit("\x1f".join(multi.values())), "\x1f")
    expanded = F.array_join(F.transform(F.split(lowered, ""), lambda c: F.when(c.rlike(_special()), F.get(known, F.instr(F.lit(letters), c) - 1)).otherwise(c)), "")
    folded = F.regexp_replace(F.translate(F.when(lowered.rlike(_special()), expanded).otherwise(lowered), source, target), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.when(ascii_only, lowered).otherwise(folded), "[^a-z0-9]+", " "))


def normalize_or_null(text: Column) -> Column:
    return F.nullif(normalize(text), F.lit(""))


def clean(text: Column, keep_lines: bool = False) -> Column:
    """White space collapsed; ``keep_lines``: per line, empty lines dropped, a trailing cell mark cut."""
    value = F.coalesce(text, F.lit(""))
    if not keep_lines:
        return F.trim(F.regexp_replace(value, r"\s+", " "))
    value = F.regexp_replace(F.regexp_replace(value, r"\r\n?", "\n"), r"[ \t\f\x0B\xA0]+", " ")
    value = F.regexp_replace(value, r" ?\n ?", "\n")
    value = F.regexp_replace(value, r"(?m)(?: ?\|)+ ?$", "")
    return F.regexp_replace(F.regexp_replace(value, r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct normalised words without stop words and blanks."""
    words = F.array_distinct(F.split(normalize(text), " "))
    return F.array_except(words, F.array(*[F.lit(w) for w in ("", *stop)]))


def overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's tokens that the candidate has; 0 if either has none."""
    n = F.size(query)
    return F.when((n > 0) & (F.size(candidate) > 0), F.size(F.array_intersect(query, candidate)) / n).otherwise(F.lit(0.0))


def contains_folded(text: Column, needle: str | Column) -> Column:
    return F.contains(normalize(text), normalize(F.lit(needle) if isinstance(needle, str) else needle))


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Whether one of the keywords is a literal part of the normalised text."""
    import re

    return normalize(text).rlike("|".join(re.escape(k) for k in keywords))


def without_leading(text: Column, words: Sequence[str]) -> Column:
    """The normalised text without leading descriptor words; whole if nothing else is left."""
    whole = normalize(text)
    rest = F.regexp_replace(whole, f"^(?:(?:{'|'.join(words)})(?: |$))+", "")
    return F.coalesce(F.nullif(rest, F.lit("")), whole)


def name_variants(name: Column) -> Column:
    """Sorted normalised variants: ``B, A`` also as ``A B`` if there is one comma; each cut at slashes too."""
    parts = F.split(name, ",")
    swapped = F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0)))))
    forms = F.array_compact(F.array(name, swapped))
    every = F.array_union(forms, F.flatten(F.transform(forms, lambda f: F.split(f, "/"))))
    return F.array_sort(F.array_except(F.array_distinct(F.transform(every, normalize)), F.array(F.lit(""))))


def padded_code(code: Column, width: int) -> Column:
    """Digits left-padded with zeros to the width, a trailing ``.0`` cut; null if it isn't such a code."""
    value = F.regexp_replace(F.trim(code), r"\.0$", "")
    return F.when(value.rlike(rf"^\d{{1,{width}}}$"), F.lpad(value, width, "0"))


def label(value: Column, known: dict[str, str]) -> Column:
    """The known label, else the value with spaces for underscores and a capital."""
    plain = F.replace(value, F.lit("_"), F.lit(" "))
    fallback = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substr(plain, F.lit(2))))
    if not known:
        return fallback
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(table[value], fallback)


def display_case(name: Column, acronyms: Sequence[str], lower_words: Sequence[str]) -> Column:
    """Acronyms and Roman numerals in capitals, generic words in lower case, other all-capital words capitalised; the first letter is a capital."""

    def word(w: Column) -> Column:
        up = F.upper(w)
        return (
            F.when(up.isin(*acronyms) | (up.rlike("^[IVX]+$") & (w == up)), up)
            .when(F.lower(w).isin(*lower_words), F.lower(w))
            .when((w == up) & (F.length(w) > 1), F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2)))))
            .otherwise(w)
        )

    joined = F.array_join(F.transform(F.split(clean(name), " "), word), " ")
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))


def single_power(text: Column) -> Column:
    """The one power stated, in MW with six decimals: local separators, kW and GW converted; null if there is none, several or a range."""
    number = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?)"
    value = F.coalesce(text, F.lit(""))
    pattern = rf"(?i){number}\s*(kw|mw|gw)"
    found = F.regexp_extract_all(value, F.lit(pattern), F.lit(1))
    unit = F.lower(F.regexp_extract(value, pattern, 2))
    raw = F.get(found, F.lit(0))
    grouped = raw.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    plain = F.when(grouped, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    mw = plain.cast("decimal(24,6)") * F.when(unit == "kw", F.lit("0.001").cast("decimal(6,3)")).when(unit == "gw", F.lit("1000.000").cast("decimal(7,3)")).otherwise(F.lit("1.000").cast("decimal(4,3)"))
    a_range = value.rlike(rf"(?i)\d\s*(?:-|a|y)\s*{number}\s*(?:kw|mw|gw)")
    return F.when((F.size(found) == 1) & ~a_range, mw.cast("decimal(38,6)"))


def cut_after(text: Column, heading: str, least: int = 1000) -> Column:
    """The text before the first match of ``heading`` that begins at ``least`` characters or later."""
    tail = F.substr(text, F.lit(least + 1))
    at = F.regexp_instr(tail, F.lit(heading))
    return F.when(at > 0, F.rtrim(F.substr(text, F.lit(1), F.lit(least) + at - 1))).otherwise(text)


def documentary(text: Column) -> Column:
    """Text for comparing evidence: unified quotes and dashes, words joined over line breaks, single spaces, lower case."""
    value = F.translate(F.coalesce(text, F.lit("")), "“”«»„‘’‚–—‐‑− ", "\"\"\"\"\"'''----- ")
    value = F.regexp_replace(value, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def evidence_segments(evidence: Column) -> Column:
    """Parts of an evidence quotation between ``[...]`` marks, as documentary text, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(evidence, F.lit("")), r"\[\.\.\.\]|\[…\]"), documentary), lambda s: s != "")


def evidence_supported(evidence: Column, text: Column) -> Column:
    """Whether there is evidence and the text has all of its segments."""
    segments, whole = evidence_segments(evidence), documentary(text)
    return (F.size(segments) > 0) & F.forall(segments, lambda s: F.contains(whole, s))
