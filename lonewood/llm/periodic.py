"""Periodic runs of words by an online dynamic program over sparse diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at
least ``max(min_length, 2 * q)`` words long, that no neighbour extends.  Words are read once,
left to right.  Each word's earlier occurrences at distance q lengthen the match of the active
diagonal (lag) q by one; a diagonal without an occurrence at the next word has ended, and if
it is long enough its run is emitted at once.  Active diagonals are all that is kept.

Only occurrences that can become a run are looked at.  A run of lag q matches at least
``max(q, min_length - q)`` words in a row, so for the lags from L to 2 L - 1 (L = 8, 16, 32, ...) an
occurrence of a word counts with the L - 1 words before it: equal L-grams are found by sorting
exact numbers of them.  Inside a stretch of period p
the grams recur every p words; two of them from the same stretch differ by a multiple of p,
which is no smallest period, and are left out.  So "a a a ..." costs as little as prose.

Every document is on its own: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ranges, utf8, with_struct

MIN_LENGTH = 12
SHORT = 8  # lags below are compared directly

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
PERIODIC = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words to equal numbers, from 0."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _widened(h: np.ndarray, width: int, bound: int) -> tuple[np.ndarray, int]:
    """Numbers below ``bound`` of the ``width``-grams to those of twice the width, and their bound:
    equal for equal grams only."""
    if bound * bound >= 1 << 63:
        values, h = np.unique(h, return_inverse=True)
        bound = len(values)
    return h[:-width] * bound + h[width:], bound * bound


def _recurring(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that occur more than once, by value and place, and whether each
    begins a new value."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    use = np.zeros(len(h), bool)
    use[1:] |= same
    use[:-1] |= same
    new = np.ones(len(h), bool)
    new[1:] = ~same
    return order[use], new[use]


def occurrences(ids: np.ndarray, min_length: int = MIN_LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, lags, matched): words that an earlier occurrence matches at a lag, together
    with the ``matched - 1`` words before.  Every word of a diagonal that becomes a run is among
    them, but for its first ``matched - 1``."""
    n = len(ids)
    for q in range(1, min(SHORT, n)):
        need = max(q, min_length - q)
        equal = np.flatnonzero(ids[q:] == ids[:-q])
        if len(equal) < need:
            continue
        breaks = np.flatnonzero(np.diff(equal) != 1) + 1
        first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(equal)]])
        long = last - first >= need
        places = equal[ranges(first[long], (last - first)[long])] + q
        yield places, np.full(len(places), q), 1
    h, width, bound = ids, 1, int(ids.max(initial=0)) + 1
    while 2 * max(width, SHORT) <= n:  # two grams side by side
        h, bound = _widened(h, width, bound)
        width *= 2
        if width < SHORT:
            continue
        at, new = _recurring(h)
        if not len(at):
            return
        # chains of occurrences at most half a gram apart lie in one stretch of that period
        apart = np.diff(at, prepend=at[0])
        chain = np.maximum.accumulate(np.where(new | (apart > width // 2), np.arange(len(at)), 0))
        base = (np.cumsum(new) - 1) * (n + 1)
        key = base + at
        lo = np.searchsorted(key, base + np.maximum(at - 2 * width + 1, 0))
        hi = np.minimum(np.searchsorted(key, base + np.maximum(at - width, -1), "right"), chain)
        count = np.maximum(hi - lo, 0)
        place = np.repeat(at, count)
        yield place + width - 1, place - at[ranges(lo, count)], width


def _factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found = [x for x in occurrences(ids, min_length) if len(x[0])]
    if not found:
        return []
    places = np.concatenate([x[0] for x in found])
    lags = np.concatenate([x[1] for x in found])
    matched = np.concatenate([np.full(len(x[0]), x[2]) for x in found])
    order = np.argsort(places, kind="stable")
    runs: list[tuple[int, int, int]] = []

    def ended(q: int, begin: int, end: int) -> None:
        """The diagonal q matched the words from begin to end - 1."""
        if end - begin < max(q, min_length - q):
            return
        unit = ids[begin - q:begin]
        if not any(np.array_equal(unit[q // f:], unit[:q - q // f]) for f in _factors(q)):
            runs.append((begin - q, end - begin + q, q))

    active: dict[int, int] = {}  # lag: first word of its match
    now: dict[int, int] = {}
    at = -2
    for place, q, width in zip(places[order].tolist(), lags[order].tolist(), matched[order].tolist(), strict=True):
        if place != at:
            for lag, begin in active.items():
                if lag not in now:
                    ended(lag, begin, at)
            active, now = now, {}
            if place != at + 1:
                for lag, begin in active.items():
                    ended(lag, begin, at + 1)
                active = {}
            at = place
        now[q] = active.get(q, place - width + 1)
    for lag, begin in active.items():
        if lag not in now:
            ended(lag, begin, at)
    for lag, begin in now.items():
        ended(lag, begin, at + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and a struct ``periodic``: n_words, runs
    (array of start, length, period; words are numbered from 0) and collapsed, the text without
    the words that repeat a run's first period.

    Words are what lies between ASCII white space.  Null and empty texts have no words, no
    runs and the collapsed text "".  Repeated rows have equal results.  A very long text is
    held whole, as numbers of its words; two runs may share words, and equal starts are ordered by
    period.  Other columns may have any name but ``periodic``.  An empty table gives an empty
    result."""
    kind = to_arrow_type(PERIODIC)

    def body(texts: pa.Array) -> pa.Array:
        raw, offs = utf8(texts)
        data, n_words, counts, flat, short = raw.tobytes(), [], [0], [], []
        for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            words = data[lo:hi].split()
            runs = runs_of(numbered(words), min_length) if len(words) >= min_length else []
            n_words.append(len(words))
            flat += runs
            counts.append(len(flat))
            short.append(collapsed(words, runs))
        values = np.array(flat, np.int64).reshape(-1, 3)
        element = kind.field("runs").type.value_type
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in range(3)], fields=list(element))
        lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), structs, type=kind.field("runs").type)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), lists, pa.array(short, pa.string())], fields=list(kind))

    return with_struct(docs, keep, "periodic", PERIODIC, [F.coalesce(F.col(f"`{text}`"), F.lit(""))], body)
