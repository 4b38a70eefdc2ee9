"""Token ids of public tokenizers by cached words.

A byte-pair tokenizer cuts a text into pieces by a fixed pattern and encodes each piece for
itself.  ``Encoder`` cuts at the same places, encodes every distinct piece once with the
tokenizers library (words by its model alone, without another search for cuts) and looks the
others up, which gives the same ids in a fraction of the time.  Its pattern covers texts of ASCII and Latin letters (up to U+017F); any other text
goes to the library whole, and so does a text with the string of an added token, which the
library finds before it cuts.  The cache is bounded, so memory does not grow with the text.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import ranges

CACHE = 600_000
#: Texts are cut in groups of about so many characters.
GROUP = 1 << 19

_LATIN = [chr(c) for c in range(0x21, 0x180) if not 0x7F <= c <= 0xA0 and c != 0x130]
_LETTERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
_PLAIN = re.compile("[\\t\\n\\r " + "".join(map(re.escape, _LATIN)) + "]*")
_S = "\\t\\n\\r "
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
#: By the pre-tokenizer of the file; fixed values of the public vocabularies.
_PATTERNS = {
    "spaces": f"{_SUFFIX}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_S}{_LETTERS}{_NUMBERS}]+|[{_S}]+(?![^{_S}])|[{_S}]+",
    "words": f"{_SUFFIX}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_S}{_LETTERS}{_NUMBERS}]+",
}


#: Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others for
#: the code points from 256 on, in their order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + n for n, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}


#: Kinds of the characters of plain texts.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.full(0x180, _OTHER, np.uint8)
_KIND[[ord(c) for c in "\t\n\r "]] = _SPACE
_KIND[[ord(c) for c in _LATIN if unicodedata.category(c)[0] == "L"]] = _LETTER
_KIND[[ord(c) for c in _LATIN if unicodedata.category(c)[0] == "N"]] = _NUMBER


def cuts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern "spaces" begin in the code points of plain texts, one text
    after another, and the end of the last.  ``ends``: of the texts that are not empty."""
    n, kind = len(points), _KIND[points]
    first = np.zeros(n + 1, bool)  # of a text
    first[0] = first[ends] = True
    run = first.copy()  # runs of one kind
    run[1:n] |= kind[1:] != kind[:-1]
    closes = run[1:] & ~first[1:]  # the last of a run, but not of its text
    # the last white space before something else begins a piece: alone, or, a space, with what follows
    last = closes & (kind == _SPACE)
    cut = run.copy()
    cut[:n] |= last
    cut[np.flatnonzero(last & (points == ord(" "))) + 1] = False
    # an apostrophe that begins a piece and stands alone takes the ending of a contraction
    at = np.flatnonzero((points == ord("'")) & cut[:n] & closes)
    at = at[kind[at + 1] == _LETTER]
    a, b = points[at + 1], np.where(first[at + 2], 0, points[np.minimum(at + 2, n - 1)])
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = np.zeros(len(at), bool)
    for x, y in ("re", "ve", "ll"):
        two |= (a == ord(x)) & (b == ord(y))
    cut[at[one | two] + 1] = False
    cut[at[one] + 2] = True
    cut[at[two] + 3] = True
    return np.flatnonzero(cut)


class _Numbers(dict):
    """Numbers pieces in the order of their first look-up; ``new`` collects unknown ones."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """``special``: strings of special tokens in a text become their ids, as the library does
    by default; otherwise they are ordinary text."""

    def __init__(self, path: str, cache: int = CACHE, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = self.tokenizer.normalizer is not None
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content} if special else ()
        self.added = sorted({t.lower() if self.lower else t for t in added})
        self.find = re.compile(_PATTERNS["words" if self.lower else "spaces"]).findall
        self.limit = cache
        self.known = _Numbers()
        self.first, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self) -> None:
        """Encodes the new pieces: words (with a space before them or not) by the model, others by
        the whole library."""
        new, self.known.new = self.known.new, []
        n = len(self.known) - len(new)
        while len(self.known) > len(self.first):
            self.first, self.size = np.concatenate([self.first] * 2), np.concatenate([self.size] * 2)
        by = 0 if self.lower else 1
        joint = [i for i, p in enumerate(new) if len(p) > by and p[by].isalpha() and (not by or p[0] == " ")]
        rest = sorted(set(range(len(new))).difference(joint)) if len(joint) < len(new) else []
        if joint:
            # of the bytes of ASCII words only a space stands for another
            mapped = "\n".join([new[i] for i in joint]).replace(" ", chr(_BYTES[32])).split("\n")
            for n_joint, i in enumerate(joint):
                if not new[i].isascii():
                    mapped[n_joint] = new[i].encode().decode("latin-1").translate(_BYTES)
            tokenize = self.tokenizer.model.tokenize
            ids = [[t.id for t in tokenize(p)] for p in mapped]
            if ids[0] != self.tokenizer.encode(new[joint[0]], add_special_tokens=False).ids:
                raise ValueError("the tokenizer cuts words in another way")
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._store(n + np.array(joint), np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        if rest:
            e = [x.ids for x in self.tokenizer.encode_batch([new[i] for i in rest], add_special_tokens=False)]
            self._store(n + np.array(rest), np.array([i for x in e for i in x], np.uint32), np.array([len(x) for x in e], np.int64))

    def _store(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.used:self.used + len(ids)] = ids
        self.size[at] = sizes
        self.first[at] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _forget(self) -> None:
        """Keeps the older half of the cache: words seen early are the frequent ones."""
        half = self.limit // 2
        self.known = _Numbers(islice(self.known.items(), half))
        size = self.size[:half].copy()
        self.flat = np.concatenate([self.flat[ranges(self.first[:half], size)], np.zeros(1 << 18, np.uint32)])
        self.first[:half] = np.cumsum(size) - size
        self.used = int(size.sum())

    def _by_match(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of every piece, pieces before each text and in all), piece by piece."""
        pieces, starts = [], [0]
        for t in texts:
            pieces += self.find(t.lower())
            starts.append(len(pieces))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)), np.array(starts)

    def _by_kind(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same: pieces are cut by the kinds of their characters, and every different one of
        the group is looked up once."""
        ends = np.cumsum([0, *map(len, texts)])
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-16-le"), "<u2")  # plain: two bytes each
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
        at = cuts(points, ends[ends > 0])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(2 * at), pa.py_buffer(points)])
        which = pieces.dictionary_encode().indices.to_numpy()  # numbered in the order of their first places
        places = np.flatnonzero(which > np.maximum.accumulate(np.concatenate([[-1], which[:-1]])))
        different = [text[a:b] for a, b in zip(at[places].tolist(), at[places + 1].tolist(), strict=True)]
        numbers = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))
        return numbers[which], np.searchsorted(at, ends)

    def _cached(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        all_ids, all_counts, lo = [], [], 0
        sizes = np.cumsum([len(t) for t in texts])
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + GROUP, "right")))
            if len(self.known) > self.limit:
                self._forget()
            at, starts = (self._by_match if self.lower else self._by_kind)(texts[lo:hi])
            if self.known.new:
                self._learn()
            size = self.size[at]
            all_ids.append(self.flat[ranges(self.first[at], size)])
            all_counts.append(np.diff(np.concatenate([[0], np.cumsum(size)])[starts]))
            lo = hi
        return np.concatenate(all_ids), np.concatenate(all_counts)

    def _has_added(self, text: str) -> bool:
        """Whether an added token's string is in the text, in any case if the library lowers it."""
        text = text.lower() if self.lower and self.added else text
        return any(t in text for t in self.added)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        plain = [_PLAIN.fullmatch(t) is not None and not self._has_added(t) for t in texts]
        if all(plain):
            return self._cached(texts)
        ids, counts = self._cached([t for t, p in zip(texts, plain, strict=True) if p])
        ends = np.cumsum(counts)
        whole = (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        own = (ids[e - c:e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True))
        parts = [next(own) if p else next(whole) for p in plain]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept for the life of the Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, special=True)
    return _ENCODERS[path]
