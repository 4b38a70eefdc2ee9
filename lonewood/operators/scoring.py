"""Batch scoring: every row descends every tree of a broadcast, packed model.

The node table is packed once on the driver into flat arrays over all nodes of a
block of trees (compact child indexes, leaves loop to themselves), broadcast, and
each Arrow batch of rows descends all trees of the block together with numpy:

    node <- where(x[feature[node]] < threshold[node], left[node], right[node])   (limit steps)
    h    <- value[node] = depth + c(size)

No shuffle, no row ever leaves its partition.  The broadcast is bounded by the model
(T * (2*psi - 1) nodes), never by the data; large models are several tree blocks whose
sums are added column-wise.  Blocks of models too large for the memory of a worker are files
that Spark ships to every executor once and its workers map (``MappedTrees``).
"""

from __future__ import annotations

import mmap
import pickle
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles

from ..functions.draws import c_factor_py

# rows x trees handled by one numpy step: the int64 work arrays of a step stay in a core's own
# cache (128 KB each)
CELLS_PER_STEP = 16_384


def c_table(max_n: int) -> np.ndarray:
    return np.array([c_factor_py(n) for n in range(max_n + 1)], dtype=np.float64)


# dense heap layout up to this depth limit (2^(limit+1) - 1 slots per tree)
DENSE_MAX_LIMIT = 12
# rows per numpy step: 64 trees of them are a step's cells
ROWS_PER_STEP = 256


@dataclass
class PackedTrees:
    """Flat arrays for a block of trees.

    dense (limit <= DENSE_MAX_LIMIT): per tree ``M = 2^(limit+1) - 1`` heap slots of
    (feature, threshold); a leaf above the last level is completed downwards (threshold
    +inf, both subtrees carry its value), so descent is ``node = 2 node + 1 + (x >= t)``
    for exactly ``limit`` steps with no child lookups, and the ``2^limit`` bottom slots
    hold (value, leaf heap number, leaf depth).
    compact: one slot per real node with child indexes, leaves looping to themselves.
    """

    tree_ids: np.ndarray  # global tree number of each packed tree
    groups: np.ndarray  # group of each packed tree
    limit: int
    dense: bool
    feature: np.ndarray  # int64 per slot (0 where unused)
    threshold: np.ndarray  # float64 per slot (+inf on leaves / unused)
    leaf_value: np.ndarray  # float64 depth + c(size), per leaf slot
    leaf_heap: np.ndarray | None  # compact: int64 heap number per slot (dense: derived)
    leaf_depth: np.ndarray  # depth of the real leaf, per leaf slot
    root: np.ndarray | None = None  # compact: root slot of each tree
    left: np.ndarray | None = None  # compact: child slots
    right: np.ndarray | None = None

    @property
    def n_slots(self) -> int:
        return int(self.feature.shape[0])

    def heap_of(self, slot: np.ndarray) -> np.ndarray:
        """Heap number of the real leaf behind leaf slots returned by ``descend``."""
        if not self.dense:
            return self.leaf_heap[slot]
        nb = 1 << self.limit
        bottom = (slot % nb) + (nb - 1)  # heap number of the bottom slot
        shift = (self.limit - self.leaf_depth[slot]).astype(np.int64)
        return np.right_shift(bottom + 1, shift) - 1


def to_file(pk: PackedTrees) -> bytes:
    """A block as a file: sizes, the object, then its arrays, each at a multiple of 64 bytes."""
    arrays: list[pickle.PickleBuffer] = []
    head = pickle.dumps(pk, protocol=5, buffer_callback=arrays.append)
    raws = [a.raw() for a in arrays]
    out = bytearray(struct.pack(f"<{2 + len(raws)}q", len(raws), len(head), *[len(r) for r in raws]))
    for part in (head, *raws):
        out += bytes(-len(out) % 64)
        out += part
    return bytes(out)


def from_file(path: str) -> PackedTrees:
    """The block of ``to_file``, its arrays mapped from the file: their pages are shared by all
    processes that map it, and the system drops them when memory is short."""
    with open(path, "rb") as f:
        view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    n, head = struct.unpack_from("<2q", view)
    sizes = (head, *struct.unpack_from(f"<{n}q", view, 16))
    at, parts = 16 + 8 * n, []
    for size in sizes:
        at += -at % 64
        parts.append(view[at:at + size])
        at += size
    return pickle.loads(parts[0], buffers=parts[1:])


@dataclass
class MappedTrees:
    """A block in a file that Spark has shipped (``SparkContext.addFile``), with the interface of a
    broadcast variable.  A worker holds no block between batches."""

    name: str

    @property
    def value(self) -> PackedTrees:
        return from_file(SparkFiles.get(self.name))

    def unpersist(self) -> None:
        """Shipped files stay until the application ends."""


def bytes_per_tree(limit: int, n_nodes: int) -> int:
    """Packed size of one tree (dense when limit <= DENSE_MAX_LIMIT)."""
    if limit <= DENSE_MAX_LIMIT:
        return ((1 << (limit + 1)) - 1) * 12 + (1 << limit) * 9
    return n_nodes * 45


def pack(nodes, limit: int) -> PackedTrees:
    """Pack a pandas node table (one block of trees)."""
    nodes = nodes.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
    tree = nodes["tree"].to_numpy(np.int64)
    heap = nodes["node"].to_numpy(np.int64)
    is_leaf = nodes["is_leaf"].to_numpy(bool)
    size = nodes["size"].to_numpy(np.int64)
    depth = nodes["depth"].to_numpy(np.int64)
    feat = nodes["feature"].fillna(0).to_numpy(np.int64)
    thr = nodes["threshold"].to_numpy(np.float64, na_value=np.nan)
    ct = c_table(int(size.max()) if len(nodes) else 1)
    value = depth.astype(np.float64) + ct[size]
    uniq, first = np.unique(tree, return_index=True)
    groups = nodes["group"].to_numpy(np.int64)[first]
    tpos = np.searchsorted(uniq, tree)  # position of each node's tree in the block
    if limit <= DENSE_MAX_LIMIT:
        M, NB = (1 << (limit + 1)) - 1, 1 << limit
        nt = uniq.shape[0]
        f_d = np.zeros(nt * M, dtype=np.int32)
        t_d = np.full(nt * M, np.inf)
        inner = ~is_leaf
        f_d[tpos[inner] * M + heap[inner]] = feat[inner]
        t_d[tpos[inner] * M + heap[inner]] = thr[inner]
        # every leaf covers 2^(limit - depth) consecutive bottom slots
        lf = np.flatnonzero(is_leaf)
        span = np.left_shift(1, limit - depth[lf])
        start = (heap[lf] + 1) * span - 1 - (NB - 1) + tpos[lf] * NB
        idx = np.repeat(start - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(int(span.sum()))
        lv = np.zeros(nt * NB)
        ld = np.zeros(nt * NB, dtype=np.int8)
        lv[idx] = np.repeat(value[lf], span)
        ld[idx] = np.repeat(depth[lf], span)
        return PackedTrees(uniq, groups, int(limit), True, f_d, t_d, lv, None, ld)
    # compact layout: slot = row of the sorted node table.  Heap numbers fill 63 bits at deep
    # limits, so a node's key is its tree's place and its number's place among all numbers
    n = len(nodes)
    numbers = np.unique(heap)
    key = tpos * len(numbers) + np.searchsorted(numbers, heap)

    def lookup(t, h):
        at = np.minimum(np.searchsorted(numbers, h), len(numbers) - 1)
        want = t * len(numbers) + at
        pos = np.minimum(np.searchsorted(key, want), n - 1)
        return np.where((numbers[at] == h) & (key[pos] == want), pos, -1)

    idx = np.arange(n)
    inner = np.where(is_leaf, 0, heap)  # a leaf's children would not fit
    left = np.where(is_leaf, idx, lookup(tpos, 2 * inner + 1))
    right = np.where(is_leaf, idx, lookup(tpos, 2 * inner + 2))
    if (left < 0).any() or (right < 0).any():
        raise ValueError("node table is not closed: an internal node misses a child")
    thr_c = np.where(is_leaf, np.inf, thr)
    roots = lookup(np.arange(len(uniq)), np.zeros_like(uniq))
    return PackedTrees(uniq, groups, int(limit), False, np.where(is_leaf, 0, feat), thr_c,
                       np.where(is_leaf, value, 0.0), heap, depth.astype(np.int32), roots.astype(np.int64),
                       left.astype(np.int64), right.astype(np.int64))


def descend(X: np.ndarray, pk: PackedTrees, t0: int, t1: int) -> np.ndarray:
    """Leaf slot of every row of X (B, d) in trees t0..t1-1 of the block -> (B, t1 - t0)."""
    B, d = X.shape
    xflat = X.ravel()
    rowbase = (np.arange(B, dtype=np.int64) * d)[:, None]
    if pk.dense:
        M, NB = (1 << (pk.limit + 1)) - 1, 1 << pk.limit
        base = (np.arange(t0, t1, dtype=np.int64) * M)[None, :]
        node = np.zeros((B, t1 - t0), dtype=np.int64)
        for _ in range(pk.limit):
            slot = base + node
            x = xflat[rowbase + pk.feature[slot]]
            node = node * 2 + 2 - (x < pk.threshold[slot])
        return (np.arange(t0, t1, dtype=np.int64) * NB)[None, :] + node - (NB - 1)
    node = np.broadcast_to(pk.root[t0:t1][None, :], (B, t1 - t0)).astype(np.int64)
    for _ in range(pk.limit):
        x = xflat[rowbase + pk.feature[node]]
        node = np.where(x < pk.threshold[node], pk.left[node], pk.right[node])
    return node


def tree_chunks(n_rows: int, n_trees: int):
    step = max(1, min(n_trees, CELLS_PER_STEP // max(1, n_rows)))
    for t0 in range(0, n_trees, step):
        yield t0, min(n_trees, t0 + step)


def row_chunks(n_rows: int):
    for r0 in range(0, n_rows, ROWS_PER_STEP):
        yield r0, min(n_rows, r0 + ROWS_PER_STEP)


def matrix_from_batch(batch: pa.RecordBatch, d: int) -> np.ndarray:
    cols = []
    for i in range(d):
        a = batch.column(batch.schema.get_field_index(f"_x{i}"))
        cols.append(a.to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
    if not cols:
        return np.zeros((batch.num_rows, 0))
    return np.ascontiguousarray(np.column_stack(cols))


def path_sums(X: np.ndarray, pk: PackedTrees, t0: int = 0, t1: int | None = None) -> np.ndarray:
    """Sum of path lengths over the trees t0..t1-1 of the block, for every row.

    Tree chunks outside, row chunks inside: one chunk of the model stays in cache while
    every row of the batch descends it."""
    out = np.zeros(X.shape[0])
    t1 = pk.tree_ids.shape[0] if t1 is None else t1
    step = max(1, CELLS_PER_STEP // ROWS_PER_STEP)
    for a in range(t0, t1, step):
        b = min(t1, a + step)
        for r0, r1 in row_chunks(X.shape[0]):
            out[r0:r1] += pk.leaf_value[descend(X[r0:r1], pk, a, b)].sum(axis=1)
    return out


def forest_sums(X: np.ndarray, pk: PackedTrees, trees: float, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Over the whole forests of the block: sum of path lengths, sum of forest scores."""
    paths, scores = np.zeros(X.shape[0]), np.zeros(X.shape[0])
    cuts = np.flatnonzero(np.r_[True, pk.groups[1:] != pk.groups[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h = path_sums(X, pk, a, b)
        paths += h
        scores += np.power(2.0, -(h / trees) / c)
    return paths, scores


def local_sums(X: np.ndarray, pk: PackedTrees, g: np.ndarray) -> np.ndarray:
    """Sum of path lengths over the trees of each row's own group only."""
    out = np.zeros(X.shape[0])
    for gi in np.unique(g):
        t0, t1 = (int(np.searchsorted(pk.groups, gi, side)) for side in ("left", "right"))
        if t1 > t0:
            rows = np.flatnonzero(g == gi)
            out[rows] = path_sums(X[rows], pk, t0, t1)
    return out


def block_split(trees: list[tuple[int, int, int]], max_bytes: int) -> list[tuple[list, bool]]:
    """Cuts trees (group, tree, bytes), in order, into blocks of at most ``max_bytes`` (one
    tree at least): (trees of the block, whether it holds whole groups)."""
    groups: list[list] = []
    for t in trees:
        if not groups or groups[-1][0][0] != t[0]:
            groups.append([])
        groups[-1].append(t)
    out: list[tuple[list, bool]] = []
    room = 0
    for g in groups:
        size = sum(t[2] for t in g)
        if size > max_bytes:
            part, n = [], 0
            for t in g:
                if part and n + t[2] > max_bytes:
                    out.append((part, False))
                    part, n = [], 0
                part.append(t)
                n += t[2]
            out.append((part, False))
            room = 0
        elif out and out[-1][1] and size <= room:
            out[-1][0].extend(g)
            room -= size
        else:
            out.append((list(g), True))
            room = max_bytes - size
    return out
