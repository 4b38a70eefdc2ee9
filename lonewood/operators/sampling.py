"""Per-tree sub-samples without replacement, in one distributed pass.

For a population of N rows and TT trees, every tree needs a uniform psi-subset.
Hashing every (row, tree) pair costs N*TT draws; instead each row walks a geometric
skip sequence over the trees (Bernoulli(p) membership per tree, p slightly above psi/N):

    pos_1 = skip_1,  pos_k = pos_{k-1} + 1 + skip_k,  skip_k = floor(ln(1-u(seed,id,k)) / ln(1-p))

and is a candidate of every tree ``pos_k < TT``.  One draw per row decides whether
the row survives at all (pos_1 < TT); only survivors (about min(N, TT*p*N) rows, i.e.
bounded by TT*psi' when N is large) evaluate further hops.  Per tree, the psi
candidates with the smallest independent order draw u(seed||'o', id, tree) are kept:
conditional on >= psi candidates this is an exact uniform psi-subset.  A tree with
fewer candidates (probability ~1e-15 with the 8-sigma margin) is detected by the
caller, which retries with a doubled margin.

Nothing here depends on partition layout or row order: same seed, same sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import u_col


@dataclass
class Population:
    """One sampling population: all rows ('all') or one chunk group."""

    pop: int  # index used to look up per-population constants
    n: int  # rows in the population (after the NA policy)
    trees: int  # TT: number of trees sampled from it
    offset: int  # global number of its first tree

    def p(self, psi: int, margin: float) -> float:
        return min(1.0, (psi + margin * math.sqrt(psi) + margin) / self.n)

    def ln1mp(self, psi: int, margin: float) -> float:
        p = self.p(psi, margin)
        return float("-inf") if p >= 1.0 else math.log(1.0 - p)


def chunk_hash(points: DataFrame, k: int, seed: int, id_col: str = "_id") -> Column:
    """Group of a row under hash assignment: floor(u(seed,'g',id) * k)."""
    return F.floor(u_col(seed, "g", F.col(id_col)) * F.lit(float(k))).cast("int")


def chunk_contiguous(index_col: Column, n: int, k: int) -> Column:
    """Group of a row at global position i: least(floor(i / floor(N/k)), k-1)."""
    step = max(1, n // k)
    return F.least(F.floor(index_col / F.lit(step)), F.lit(k - 1)).cast("int")


def contiguous_bounds(points: DataFrame, k: int, id_col: str = "_id") -> list:
    """The k-1 ids that open chunks 1..k-1 (exact order statistics at ranks j * floor(N/k)),
    by distributed selection: a few aggregates of the id column for all of them together."""
    from .analysis import order_statistics

    return order_statistics(points, id_col, lambda n: [j * max(1, n // k) for j in range(1, k) if j * max(1, n // k) < n])


def group_by_bounds(id_col: Column, bounds: list) -> Column:
    """Chunk of an id = number of chunk-opening ids <= it."""
    arr = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    return F.when(id_col.isNotNull(), F.size(F.filter(arr, lambda b: b <= id_col))).cast("int")


def _pick(values: list, pop: Column) -> Column:
    """Per-population constant without a join: element of a literal array."""
    if len(values) == 1:
        return F.lit(values[0])
    return F.element_at(F.array(*[F.lit(v) for v in values]), pop + F.lit(1))


def _hop_fn(pops: list[Population], psi: int, seed: int, margin: float, pop_idx: int | None, arrow_schema,
            keep_names: list[str]):
    """mapInArrow body for survivors: hops 2, 3, ... until each row passes its last tree.

    Exact (no cap on hops): a row stops only when its position reaches TT.  All rows of
    a batch advance one hop per round with numpy; only the md5 draw and ``math.log``
    (the C library's, as in the SQL twin) are per element.  Work is bounded by the
    number of (row, tree) candidates, about TT * psi' per population.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    lq_all = np.array([pp.ln1mp(psi, margin) for pp in pops], dtype=np.float64)
    tt_all = np.array([int(pp.trees) for pp in pops], dtype=np.int64)
    off_all = np.array([int(pp.offset) for pp in pops], dtype=np.int64)
    pfx = f"{seed}:".encode()
    md5 = hashlib.md5
    log = math.log

    def fn(batches):
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            ids = b.column(b.schema.get_field_index("_id")).to_numpy().astype(np.int64)
            last = b.column(b.schema.get_field_index("_pos1")).to_numpy().astype(np.int64)
            pop = (b.column(pop_idx).to_numpy().astype(np.int64) if pop_idx is not None
                   else np.zeros(n, dtype=np.int64))
            lim, lnq, off = tt_all[pop], lq_all[pop], off_all[pop]
            rows, trees = [np.arange(n)], [last + off]  # first hop < TT by the JVM filter
            active = np.flatnonzero(last < lim - 1)
            k = 2
            while active.size:
                suffix = f":{k}".encode()
                # u = first 52 bits of md5("seed:id:k"); ln(1 - u) with the C library's log
                lg = np.array([log(1.0 - (int.from_bytes(md5(pfx + str(i).encode() + suffix)
                                                          .digest()[:7], "big") >> 4) / 4503599627370496.0)
                               for i in ids[active].tolist()], dtype=np.float64)
                new = last[active] + 1 + np.floor(lg / lnq[active]).astype(np.int64)
                inside = new < lim[active]
                rows.append(active[inside])
                trees.append(new[inside] + off[active[inside]])
                last[active] = new
                active = active[new < lim[active] - 1]
                k += 1
            take = pa.array(np.concatenate(rows))
            cols = [b.column(b.schema.get_field_index(nm)).take(take) for nm in keep_names]
            cols.append(pa.array(np.concatenate(trees)))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return fn


def candidates(points: DataFrame, pops: list[Population], psi: int, seed: int, margin: float,
               pop_col: str | None = None, rows_per_task: int = 32_768, least_tasks: int = 1) -> DataFrame:
    """Rows of ``points`` exploded to (tree, row) candidate pairs; adds ``_tree``.

    The first hop of every row is one JVM expression (codegen, pushed next to the scan):
    rows whose first hop is already past the last tree never leave the JVM.
    ``pop_col`` names the integer population column (chunk group); None = one population.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..session import ship_package

    ship_package(points.sparkSession)
    pop = F.col(pop_col) if pop_col else F.lit(0)
    ln1mp = _pick([pp.ln1mp(psi, margin) for pp in pops], pop)
    tt = _pick([int(pp.trees) for pp in pops], pop).cast("bigint")
    first = F.floor(F.log(F.lit(1.0) - u_col(seed, F.col("_id"), 1)) / ln1mp).cast("bigint")
    survivors = points.withColumn("_pos1", first).where(F.col("_pos1") < tt)
    # survivors (about min(N, TT * psi') rows, TT * psi' hops) go round-robin over tasks by
    # their expected number -- not by id, so even a (forbidden) hot duplicate id cannot pile up
    hops = sum(pp.trees * pp.p(psi, margin) * pp.n for pp in pops)
    survivors = survivors.repartition(max(1, least_tasks, math.ceil(hops / rows_per_task)))
    keep = [f for f in points.schema.fields]
    out_schema = T.StructType(keep + [T.StructField("_tree", T.LongType(), False)])
    pop_idx = survivors.columns.index(pop_col) if pop_col else None
    fn = _hop_fn(pops, psi, seed, margin, pop_idx, to_arrow_schema(out_schema), [f.name for f in keep])
    return survivors.mapInArrow(fn, out_schema)


def trim_to_psi(cands: DataFrame, psi: int, seed: int, n_parts: int) -> DataFrame:
    """Keep the psi candidates of each tree with the smallest order draw.

    ``repartition(n_parts, _tree)`` is the only shuffle of training; the window and
    the grouped-map growth that follows both reuse that hash partitioning.
    """
    order = u_col(f"{seed}o", F.col("_id"), F.col("_tree"))
    w = Window.partitionBy("_tree").orderBy(F.col("_o"), F.col("_id"))
    return (cands.withColumn("_o", order)
            .repartition(n_parts, "_tree")
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= psi)
            .drop("_o", "_rn"))
