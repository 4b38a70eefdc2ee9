"""Per-tree samples that can be merged: the psi rows of least key of every tree.

Every pair (row, tree) has a key in [0, 1), a pure function of seed, id and tree.  The psi
rows of least key are a uniform sample without replacement, of any population: the sample of
a union is the psi least of the parts' samples, so samples of batches, partitions or days
merge in any order, and the number of rows need not be known.

Keys are not drawn for all rows x trees.  Level j > 0 hits a pair with the probability
p_j = 15 / 16^(j+1) (the last level: 1 / 16^j) and gives it a key in [1 / 16^(j+1), 1 / 16^j);
level 0 hits every pair.  A pair's key is the least it is hit with.  A row's hits of a level
are a geometric walk over the trees, so "all pairs with a key below 1 / 16^j" costs one draw
per row and level from j on, next to the scan, and only hit rows leave it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.draws import u_col
from ..session import ship_package

LEVELS = 12  # the last level; its keys reach to 0


def hit_probability(level: int) -> float:
    return 1 / 16 ** level if level == LEVELS else 15 / 16 ** (level + 1)


def key_range(level: int) -> tuple[float, float]:
    """(least key, width) of a level."""
    return (0.0, 16.0 ** -level) if level == LEVELS else (16.0 ** -(level + 1), 15 * 16.0 ** -(level + 1))


def level_for(n: int, psi: int, margin: float = 8.0) -> int:
    """The highest level from which on ``n`` rows give a tree more than psi hits, but for a
    probability of about 1e-15."""
    need, level = psi + margin * math.sqrt(psi) + margin, 0
    while level < LEVELS and n >= need * 16 ** (level + 1):
        level += 1
    return level


def level_of(key: float) -> int:
    """The highest level from which on all keys up to ``key`` are drawn."""
    level = 0
    while level < LEVELS and key < 16.0 ** -(level + 1):
        level += 1
    return level


def _keys(n_trees: int, seed: int) -> Callable[[int, int], dict[int, float]]:
    """A function of id and level: the trees in which the row has a key below the level's
    upper end, with their keys."""
    md5, log, two52 = hashlib.md5, math.log, 4503599627370496.0
    ln1mp = {j: math.log1p(-hit_probability(j)) for j in range(1, LEVELS + 1)}

    def u(text: str) -> float:
        return (int.from_bytes(md5(text.encode()).digest()[:7], "big") >> 4) / two52

    def keys_of(i: int, level: int) -> dict[int, float]:
        keys: dict[int, float] = {}
        for j in range(max(1, level), LEVELS + 1):
            ln = ln1mp[j]
            low, width = key_range(j)
            tree, k = -1, 1
            while True:
                tree += 1 + math.floor(log(1.0 - u(f"{seed}:b:{j}:{i}:{k}")) / ln)
                if tree >= n_trees:
                    break
                keys[tree] = min(keys.get(tree, 1.0), low + width * u(f"{seed}:c:{j}:{i}:{tree}"))
                k += 1
        if level == 0:
            low, width = key_range(0)
            for tree in range(n_trees):
                if tree not in keys:  # keys of higher levels are less
                    keys[tree] = low + width * u(f"{seed}:c:0:{i}:{tree}")
        return keys

    return keys_of


def _walk(n_trees: int, seed: int, level: int, names: list[str], schema: pa.Schema):
    """Over hit rows: a row for every tree with a key below the level's upper end."""
    keys_of = _keys(n_trees, seed)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, trees, keys = [], [], []
            for r, i in enumerate(b.column("_id").to_pylist()):
                found = keys_of(i, level)
                rows += [r] * len(found)
                trees += found.keys()
                keys += found.values()
            take = pa.array(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in names], pa.array(trees, pa.int64()), pa.array(keys, pa.float64())], schema=schema)

    return run


def _hits(n_trees: int, seed: int, level: int) -> Column:
    """Whether level ``level`` > 0 hits the row in any tree."""
    first = F.floor(F.log(F.lit(1.0) - u_col(seed, "b", level, F.col("_id"), 1)) / F.lit(math.log1p(-hit_probability(level))))
    return first < n_trees


def keyed(points: DataFrame, n_trees: int, seed: int, level: int) -> DataFrame:
    """``points`` (``_id`` and features) once per tree in which they have a key below
    ``16 ** -level``, with ``_tree`` and ``_key``."""
    ship_package(points.sparkSession)
    if level:
        hit = F.lit(False)
        for j in range(level, LEVELS + 1):
            hit = hit | _hits(n_trees, seed, j)
        points = points.where(hit)
    out = T.StructType([*points.schema.fields, T.StructField("_tree", T.LongType(), False), T.StructField("_key", T.DoubleType(), False)])
    return points.mapInArrow(_walk(n_trees, seed, level, points.columns, to_arrow_schema(out)), out)


def least(keyed_rows: DataFrame, psi: int, parts: int | None = None) -> DataFrame:
    """The psi rows of least (key, id) of each tree."""
    w = Window.partitionBy("_tree").orderBy("_key", "_id")
    dealt = keyed_rows.repartition(parts, "_tree") if parts else keyed_rows
    return dealt.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi).drop("_rn")


def merged(samples: list[DataFrame], psi: int, parts: int | None = None) -> DataFrame:
    """The sample of all rows that ``samples`` were drawn from."""
    every = samples[0]
    for s in samples[1:]:
        every = every.unionByName(s)
    return least(every, psi, parts)


def bottom_samples(points: DataFrame, n_trees: int, psi: int, seed: int, level: int, parts: int | None = None) -> DataFrame:
    """A sample of ``points`` that ``merged`` can merge: of each tree the psi rows of least key,
    among those with a key below ``16 ** -level`` (with level 0 among all)."""
    return least(keyed(points, n_trees, seed, level), psi, parts)


def _rising_walk(n_trees: int, psi: int, seed: int, names: list[str], schema: pa.Schema):
    """Over the rows of a task with their levels: a row for every tree in which its key is
    among the psi least of the task so far.  Holds psi keys a tree, and no rows."""
    keys_of = _keys(n_trees, seed)

    def run(batches) -> Iterator[pa.RecordBatch]:
        least_keys: dict[int, list[float]] = {}  # of a tree, negated: a heap with the worst on top
        for b in batches:
            rows, trees, keys = [], [], []
            for r, (i, level) in enumerate(zip(b.column("_id").to_pylist(), b.column("_level").to_pylist(), strict=True)):
                for tree, key in keys_of(i, level).items():
                    heap = least_keys.setdefault(tree, [])
                    if len(heap) < psi:
                        heappush(heap, -key)
                    elif key <= -heap[0]:  # an equal key stays: the id decides later
                        heapreplace(heap, -key)
                    else:
                        continue
                    rows.append(r)
                    trees.append(tree)
                    keys.append(key)
            take = pa.array(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in names], pa.array(trees, pa.int64()), pa.array(keys, pa.float64())], schema=schema)

    return run


def one_pass_samples(points: DataFrame, n_trees: int, psi: int, seed: int, parts: int | None = None, highest: int = LEVELS, seen: Observation | None = None) -> DataFrame:
    """``bottom_samples`` of rows whose number nobody knows, in one pass over them.

    A row's level is that of the number of rows its task has seen before it.  Those have
    more than psi keys a tree below that level's upper end (but for a probability of about
    1e-15, see ``exact``), so a greater key can't be in the sample, and the row leaves the
    JVM only if it has a lesser one.  Python keeps the psi least keys of a tree per task and
    passes on about psi (1 + ln(rows / psi)) rows a tree at most.

    The sample depends on neither the partitions nor the order of rows, so tasks that run
    again give the same.  ``seen`` observes ``rows`` and ``longest``, the rows of the longest
    task; ``highest`` bounds the levels used."""
    ship_package(points.sparkSession)
    names = points.columns
    before = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = points.withColumn("_before", before)
    if seen is not None:
        numbered = numbered.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("_before") + 1, F.lit(0)).alias("longest"))
    starts = [math.ceil((psi + 8.0 * math.sqrt(psi) + 8.0) * 16 ** j) for j in range(1, highest + 1)]
    level = F.lit(0)
    for start in starts:
        level = level + (F.col("_before") >= F.lit(start)).cast("int")
    hit = F.col("_level") == 0
    for j in range(1, LEVELS + 1):
        hit = hit | ((F.col("_level") <= j) & _hits(n_trees, seed, j))
    survivors = numbered.withColumn("_level", level).where(hit).select(*names, "_level")
    out = T.StructType([*points.schema.fields, T.StructField("_tree", T.LongType(), False), T.StructField("_key", T.DoubleType(), False)])
    return least(survivors.mapInArrow(_rising_walk(n_trees, psi, seed, names, to_arrow_schema(out)), out), psi, parts)


def exact(worst: float, longest: int, psi: int, highest: int = LEVELS) -> bool:
    """Whether ``one_pass_samples`` of full trees passed over no row of the samples: rows were
    passed over for keys above the level of the longest task, so the greatest key kept
    (``worst``) must lie below that."""
    return level_of(worst) >= min(highest, level_for(longest, psi))
