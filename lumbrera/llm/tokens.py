"""Token ids of whole texts by a public tokenizer file, with repeated words encoded once per worker."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from itertools import pairwise, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from .common import kept_for_stage


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Classes of UTF-8 bytes.
_OTHER, _SPACE, _NEWLINE, _ODD, _LETTER, _MARK, _LEAD = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*b"\t\v\f\r\x1c\x1d\x1e\x1f"]] = _ODD
_CLASS[32], _CLASS[10] = _SPACE, _NEWLINE
_CLASS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _LETTER
_CLASS[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = _MARK
#: White space beyond ASCII, as Python and the vocabularies' patterns know it, and letters whose lower case depends on
#: their neighbours or is more than a letter: texts with them are encoded whole. The first bytes are looked up first.
_RARE = tuple(c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\u03a3\u0130" + "".join(map(chr, range(0x2000, 0x200B))))
_CLASS[[r[0] for r in _RARE]] = _LEAD
_ODD_CASE = "\u03a3\u0130"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of more bytes are not kept between batches.
_LONG = 64

#: Bytes of text that are cut and encoded at a time, one text at least: the arrays for it take some twenty times as much.
BLOCK_BYTES = 1 << 20


def _blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts in UTF-8, null as empty, in runs of about ``BLOCK_BYTES``."""
    block, held = [], 0
    for text in texts:
        block.append((text or "").encode())
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _rare_places(data: np.ndarray, cls: np.ndarray) -> np.ndarray:
    at = np.nonzero(cls == _LEAD)[0]
    if not len(at):
        return at
    wide = np.concatenate([data, np.zeros(2, np.uint8)])
    found = np.zeros(len(at), bool)
    for r in _RARE:
        same = wide[at] == r[0]
        for k in range(1, len(r)):
            same &= wide[at + k] == r[k]
        found |= same
    return at[found]


class Pieces:
    """A batch of texts cut at places where no piece of either vocabulary can go on.

    These are a lone space or newline between words, a mark after a Latin letter,
    and an ASCII letter after a mark that begins no contraction. Other texts stay whole.
    ``spaced``: a space belongs to the word after it; otherwise white space goes
    and A-Z are lower case.
    """

    def __init__(self, texts: list[bytes], spaced: bool):
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begin = ends - np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        cls = _CLASS[raw]
        white = (cls == _SPACE) | (cls == _NEWLINE)
        first = np.zeros(len(raw) + 1, bool)
        first[begin], first[ends] = True, True
        # Irregular: white space at an end of the text or twice, odd characters, and what may be a special token.
        edge = white & (first[:-1] | first[1:])
        edge[1:] |= white[1:] & white[:-1]
        edge[1:] |= (raw[1:] == 124) & (raw[:-1] == 60)
        places = np.concatenate([np.nonzero(edge | (cls == _ODD))[0], _rare_places(raw, cls)])
        odd = np.unique(np.searchsorted(ends, places, "right"))
        cut = first[:-1].copy()
        letter = cls == _LETTER
        latin = (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5)  # letters all but two
        latin &= (raw[:-1] > 0xC3) | ((raw[1:] != 0x97) & (raw[1:] != 0xB7))
        letter[1:] |= latin
        mark = cls == _MARK
        cut[1:] |= mark[1:] & letter[:-1]
        mark &= raw != 39
        cut[1:] |= mark[:-1] & (cls[1:] == _LETTER)
        if spaced:
            cut |= white
            cut[1:] |= cls[:-1] == _NEWLINE
        else:
            cut[1:] |= white[:-1]
            cut &= ~white
        for i in odd.tolist():
            cut[begin[i]], cut[begin[i] + 1 : ends[i]] = True, False
        start = np.nonzero(cut)[0]
        #: Pieces of each text.
        self.count = np.diff(np.searchsorted(start, np.append(begin, len(raw))))
        if not spaced:
            lower = _LOWER[raw]
            for i in odd.tolist():
                lower[begin[i] : ends[i]] = raw[begin[i] : ends[i]]
                white[begin[i] : ends[i]] = False
            start, raw = start - np.cumsum(white[np.maximum(start - 1, 0)] & (start > 0)), lower[~white]
        offsets = pa.py_buffer(np.append(start, len(raw)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        self.distinct, self.code = coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


class Encoder:
    """Ids of ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian unsigned 32-bit.

    A block is encoded by its distinct pieces; their ids are kept between
    batches, up to ``most`` pieces, of which those seen in several blocks stay.
    ``spaced``: byte-level vocabularies, where a word's leading space belongs to it.
    """

    def __init__(self, path: str, spaced: bool, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._spaced, self._most = Tokenizer.from_file(path), spaced, most
        self._slot: dict[str, int] = {}
        self._has_long = False
        self._ids, self._size, self._seen = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)
        # Byte-level vocabularies write a byte as a printable character: itself, or one from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self._shown = {b: 256 + i for i, b in enumerate(hidden) if b != 10}

    def whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _model_input(self, words: list[str]) -> list[str | None]:
        """How byte-pair merging gets each word of letters (after a space or not); null where the library must prepare it."""
        given, sure = "\n".join(words), True
        joined = given
        if not self._spaced and not given.isascii():  # letters still, if made lower case and composed
            joined = given.lower()
            sure = is_normalized("NFC", given) and is_normalized("NFC", joined) and not any(c in given for c in _ODD_CASE)
        if not sure and len(words) > 1:
            return [form for w in words for form in self._model_input([w])]
        shown = joined.replace(" ", chr(self._shown[32])) if joined.isascii() else joined.encode().decode("latin-1").translate(self._shown)
        shown = shown.split("\n")
        return [s if w.isalpha() or self._spaced else None for s, w in zip(shown, joined.split("\n"), strict=True)] if sure else [None]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        skip = int(self._spaced)
        letters = [w for w in words if len(w) < _LONG and (w.isalpha() or (w[0] == " " and w[skip:].isalpha()))]
        asked: dict[str, str | None] = {}
        for own in ([w for w in letters if w.isascii()], [w for w in letters if not w.isascii()]):
            asked.update(zip(own, self._model_input(own), strict=True) if own else ())
        ids, size, tokenize, get = [], [], self._tokenizer.model.tokenize, asked.get
        for w in words:
            own = [t.id for t in tokenize(form)] if (form := get(w)) else self.whole(w)
            ids += own
            size.append(len(own))
        return np.array(ids, "<u4"), np.array(size, np.int32)

    def _learn(self, distinct: list[str]) -> np.ndarray:
        """The slot of each piece; all have one afterwards."""
        slot = np.fromiter(map(self._slot.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.nonzero(slot < 0)[0]
        words = [distinct[i] for i in fresh.tolist()]
        self._has_long |= max(map(len, words), default=0) >= _LONG
        ids, size = self._encoded(words)
        slot[fresh] = len(self._size) + np.arange(len(fresh))
        self._ids, self._size = np.concatenate([self._ids, ids]), np.concatenate([self._size, size])
        self._seen = np.concatenate([self._seen, np.zeros(len(fresh), np.int32)])
        self._seen[slot] += 1
        self._slot.update(zip(words, slot[fresh].tolist(), strict=True))
        return slot

    def _forget(self) -> None:
        """Drop long pieces, and if there are too many others those seen least often."""
        if not self._has_long and len(self._slot) <= self._most:
            return
        self._has_long = False
        words, slot = list(self._slot), np.fromiter(self._slot.values(), np.int64, len(self._slot))
        stay = np.fromiter(map(len, words), np.int64, len(words)) < _LONG
        seen = self._seen[slot]
        if stay.sum() > self._most:
            enough = np.sort(seen[stay])[-(self._most // 2)]
            stay &= seen > max(enough, 1)
        start = np.cumsum(self._size, dtype=np.int64) - self._size
        kept = slot[stay]
        n = self._size[kept].astype(np.int64)
        self._ids = self._ids[np.arange(int(n.sum())) + np.repeat(start[kept] - np.cumsum(n) + n, n)]
        self._size, self._seen = self._size[kept], self._seen[kept] // 2
        self._slot = {words[i]: k for k, i in enumerate(np.nonzero(stay)[0].tolist())}

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none. Copies are encoded once."""
        known: dict[str | None, bytes] = dict.fromkeys(texts)
        collecting = gc.isenabled()
        gc.disable()  # many short-lived objects and no cycles
        try:
            encoded = (ids for block in _blocks(list(known)) for ids in self._encode_distinct(block))
            known.update(zip(known, encoded, strict=True))
            self._forget()
        finally:
            if collecting:
                gc.enable()
        return [known[t] for t in texts]

    def _encode_distinct(self, texts: list[bytes]) -> list[bytes]:
        if not any(texts):
            return [b""] * len(texts)
        pieces = Pieces(texts, self._spaced)
        slot = self._learn(pieces.distinct)
        size = self._size[slot]
        start = (np.cumsum(self._size, dtype=np.int64) - self._size)[slot]
        out, at, ids = [], 0, self._ids
        for count in np.array_split(pieces.count, max(1, len(pieces.code) >> 17)):  # bounded arrays for any batch
            own = pieces.code[at : at + int(count.sum())]
            at += len(own)
            n = size[own]
            ends = np.cumsum(n, dtype=np.int64)
            found = ids[np.arange(int(n.sum())) + np.repeat(start[own] - ends + n, n)]
            last = np.concatenate([[0], ends])[np.cumsum(count)].tolist()
            out += [found[a:b].tobytes() for a, b in pairwise([0, *last])]
        return out


def encoder(path: str, spaced: bool) -> Encoder:
    """One per Python worker and stage, so that tasks share what is known."""
    return kept_for_stage(Encoder, path, spaced)
