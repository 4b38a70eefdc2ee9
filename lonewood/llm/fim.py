"""Fill-in-middle rearrangement, with cuts located from the token counts of text chunks.

A text is a row of units, ``[A-Za-z]+|[^A-Za-z]`` over code points.  Its number of units n
fixes two cuts, drawn from a hash of the document's id.  Units are not listed to find them:

1. A rolling hash (Rabin-Karp over ``WINDOW`` bytes) cuts a text into chunks where its
   contents say so, so a passage that many documents share gives the same chunks in all.
2. Each chunk has a summary: units, whether it begins and ends inside a run of letters.  A
   task keeps summaries by content in a cache of ``CACHE_BYTES``; a lookup compares the whole
   chunk, so a hit is never another chunk's summary.
3. Summaries combine: units add up, less one where a run of letters goes over a border.  The
   sums give n and, by binary search, the chunk of each cut; only that chunk is scanned.

Every document is on its own: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import utf8, with_struct

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # of 100: the rest of the documents stays plain
SPM_BELOW = 20  # of 100 rearranged documents
WINDOW = 16
CHUNK_BITS = 9  # chunks of about 512 bytes
MAX_CHUNK = 8192
CACHE_BYTES = 32 << 20
STEP = 1 << 18

_BASE, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Letters to "a", continuation bytes of a code point to nothing, all else to a blank.
_KIND = bytes(97 if chr(b).isalpha() and b < 128 else 32 for b in range(256))
_CONTINUED = bytes(range(0x80, 0xC0))
_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*")

FIM = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """Places of ``raw`` (bytes) that end a chunk by the hash of the ``WINDOW`` bytes before."""
    found = []
    for lo in range(0, len(raw) - WINDOW + 1, STEP):
        h = raw[lo:lo + STEP + WINDOW - 1].astype(np.uint32)
        base, width = _BASE, 1
        while width < WINDOW:  # hashes of twice the width
            h = h[:-width] * base + h[width:]
            base, width = np.uint32(int(base) ** 2 & 0xFFFFFFFF), 2 * width
        h *= _MIX
        found.append(np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + lo + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def pieces(text: bytes, ends: list[int]) -> list[bytes]:
    """``text`` cut at ``ends`` (ascending, inside the text), never inside a code point nor
    with more than ``MAX_CHUNK`` bytes (and the rest of a code point) in a piece."""
    out, at = [], 0
    for end in [*ends, len(text)]:
        if end < len(text) and text[end] & 0xC0 == 0x80:
            continue
        while end - at > MAX_CHUNK:
            to = at + MAX_CHUNK
            while to < end and text[to] & 0xC0 == 0x80:
                to += 1
            out.append(text[at:to])
            at = to
        if end > at:
            out.append(text[at:end])
            at = end
    return out


def summarise(piece: bytes) -> tuple[int, bool, bool]:
    """(units, begins with a letter, ends with a letter) of whole code points."""
    kinds = piece.translate(_KIND, _CONTINUED)
    return kinds.count(b" ") + len(kinds.split()), kinds[:1] == b"a", kinds[-1:] == b"a"


class Summaries:
    """Summaries by content; emptied when the contents reach ``limit`` bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.known = limit, 0, {}

    def __call__(self, piece: bytes) -> tuple[int, bool, bool]:
        found = self.known.get(piece)
        if found is None:
            if self.size > self.limit:
                self.known.clear()
                self.size = 0
            found = self.known[piece] = summarise(piece)
            self.size += len(piece) + 200
        return found


class Units:
    """Units of a text from the summaries of its pieces."""

    def __init__(self, parts: list[bytes], summary):
        self.parts, self.ends, self.joined, self.places = parts, [], [], []
        n, at, letter = 0, 0, False
        for part in parts:
            units, first, last = summary(part)
            self.joined.append(letter and first)
            self.places.append(at)
            n += units - (letter and first)
            at += len(part)
            letter = last
            self.ends.append(n)
        self.n, self.size = n, at

    def start(self, unit: int) -> int:
        """Where the ``unit``-th unit (from 0) begins, in bytes; the text's end for the n-th."""
        if unit >= self.n:
            return self.size
        k = bisect_right(self.ends, unit)
        local = unit - (self.ends[k - 1] if k else 0) + self.joined[k]
        return self.places[k] + next(islice(_UNIT.finditer(self.parts[k]), local, None)).start()


def draws(key: str, seed: int) -> list[int]:
    digest = sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def rearranged(text: bytes, units: Units, h: list[int]) -> tuple[str, int | None, int | None, bytes]:
    """(form, prefix_chars, middle_chars, output)."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h[2] % 100 >= PLAIN_FROM or p in text or s in text or m in text:
        return "plain", None, None, text
    lo, hi = (units.start(u) for u in sorted((h[0] % (units.n + 1), h[1] % (units.n + 1))))
    first, middle, last = text[:lo], text[lo:hi], text[hi:]
    spm = h[3] % 100 < SPM_BELOW
    out = (s, last, p, first, m, middle) if spm else (p, first, s, last, m, middle)
    return "spm" if spm else "psm", len(first.decode()), len(middle.decode()), b"".join(out)


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, seed: int = 1) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and a struct ``fim``: n (units), form
    ("plain", "psm" or "spm"), prefix_chars and middle_chars (code points; null if plain) and
    output.  ``restored`` is the way back.

    Null and empty texts are plain, with n 0 and the output "".  A text with one of the
    markers is plain.  The draws depend on the id alone: repeated rows have equal results, and
    a null id draws as "".  A very long text is held whole, its chunks beside it.  Other
    columns may have any name but ``fim``.  An empty table gives an empty result."""
    kind = to_arrow_type(FIM)
    held = {}

    def body(texts: pa.Array, ids: pa.Array) -> pa.Array:
        summary = held.setdefault("summary", Summaries())
        raw, offs = utf8(texts)
        ends = chunk_ends(raw)
        data, rows = raw.tobytes(), []
        cuts = np.searchsorted(ends, np.stack([offs[:-1] + WINDOW, np.maximum(offs[1:], offs[:-1] + WINDOW)]))
        for key, lo, hi, a, b in zip(ids.to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), *cuts.tolist(), strict=True):
            one = data[lo:hi]
            units = Units(pieces(one, (ends[a:b] - lo).tolist()), summary)
            rows.append((units.n, *rearranged(one, units, draws(key or "", seed))))
        columns = zip(*rows, strict=True) if rows else [[]] * len(kind)
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    return with_struct(docs, keep, "fim", FIM, [F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`").cast("string")], body)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  A rearranged text has no marker of its own, and
    no marker begins as another one ends, so the first ones found are those put in."""
    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.position(F.lit(second), output, F.lit(len(first) + 1))
        b = F.position(F.lit(MIDDLE), output, a + F.lit(len(second)))
        n = F.length(output)
        return (F.substring(output, F.lit(len(first) + 1), a - F.lit(len(first) + 1)), F.substring(output, a + F.lit(len(second)), b - a - F.lit(len(second))),
                F.substring(output, b + F.lit(len(MIDDLE)), n))

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
