"""SQL text for the DuckDB oracle: an independent, level-wise twin of the engine.

The engine grows trees in a grouped map and scores in numpy; this module expresses the
same definitions as plain SQL over the driver's tables (WITH clauses only, no
procedural code): skip-sampling with a running-sum window, one unrolled
group-by/join step per tree level for growth, and one join per level for scoring.
Both sides share only the keyed draws of ``functions.draws``.

Used for the correctness gate (``oracle_sql()``) and by the tests.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..functions.draws import c_factor_py, c_factor_sql, sql_double, sql_str, u_sql
from ..operators.sketch import LEVELS, hit_probability, key_range


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


@dataclass
class PointsSQL:
    """A point table in SQL: ``id`` and ``x DOUBLE[]`` (+ validity)."""

    table: str
    id_expr: str
    feature_exprs: list[str] | None = None  # numeric expressions, or
    array_expr: str | None = None  # one array expression
    dim: int = 0

    @property
    def d(self) -> int:
        return self.dim if self.array_expr else len(self.feature_exprs)

    def x_expr(self) -> str:
        if self.array_expr:
            return f"CASE WHEN len({self.array_expr}) = {self.dim} THEN CAST({self.array_expr} AS DOUBLE[]) END"
        return "[" + ", ".join(_d(e) for e in self.feature_exprs) + "]"

    def all_rows(self) -> str:
        return f"SELECT CAST({self.id_expr} AS BIGINT) AS id, {self.x_expr()} AS x FROM {self.table}"

    def valid_rows(self) -> str:
        """NA policy 'drop': every feature present and not NaN."""
        return (f"SELECT id, x FROM ({self.all_rows()}) WHERE x IS NOT NULL AND "
                f"len(list_filter(x, lambda v: NOT (v IS NULL OR isnan(v)))) = {self.d}")


@dataclass
class ForestSQL:
    """CTE generator for one forest spec; ``p`` prefixes every CTE name."""

    pts: PointsSQL
    n_trees: int
    psi: int
    seed: int
    groups: int = 1
    assign: str = "all"
    limit: int | None = None
    margin: float = 8.0
    p: str = "f"

    @property
    def L(self) -> int:
        return int(math.ceil(math.log2(self.psi))) if self.limit is None else int(self.limit)

    @property
    def total(self) -> int:
        return self.groups * self.n_trees

    @property
    def c_psi(self) -> float:
        return c_factor_py(self.psi)

    # ------------------------------------------------------------ sampling
    def group_expr(self, id_ref: str = "id") -> str:
        """Chunk of a scored row (id column ``id_ref``) under the forest's assignment."""
        k = self.groups
        if self.assign == "hash":
            return f"CAST(floor({u_sql(str(self.seed), sql_str('g'), id_ref)} * {float(k)!r}) AS INTEGER)"
        if self.assign == "contiguous":
            # ids opening chunks 1..k-1: training ranks j * floor(N/k)
            bounds = (f"SELECT id FROM {self.p}_ix WHERE i > 0 AND i % greatest(1, n // {k}) = 0 "
                      f"AND i // greatest(1, n // {k}) <= {k - 1}")
            return f"CAST((SELECT count(*) FROM ({bounds}) b WHERE b.id <= {id_ref}) AS INTEGER)"
        raise ValueError(self.assign)

    def sample_ctes(self) -> list[tuple[str, str]]:
        p, s, psi, T = self.p, self.seed, self.psi, self.n_trees
        m = float(self.margin)
        out = []
        if self.assign == "all":
            out.append((f"{p}_pts", f"SELECT id, x, 0 AS pop FROM ({self.pts.valid_rows()})"))
            tt, off = f"{self.total}", "0"
        elif self.assign == "hash":
            out.append((f"{p}_pts", f"SELECT id, x, {self.group_expr()} AS pop FROM ({self.pts.valid_rows()})"))
            tt, off = f"{T}", f"pop * {T}"
        elif self.assign == "contiguous":
            k = self.groups
            out.append((f"{p}_ix", f"SELECT id, x, row_number() OVER (ORDER BY id) - 1 AS i, "
                                   f"count(*) OVER () AS n FROM ({self.pts.valid_rows()})"))
            out.append((f"{p}_pts", f"SELECT id, x, CAST(least(floor(i / greatest(1, n // {k})), {k - 1}) AS INTEGER) "
                                    f"AS pop FROM {p}_ix"))
            tt, off = f"{T}", f"pop * {T}"
        else:
            raise ValueError(self.assign)
        pe = f"least(1.0, ({_d(psi)} + {m!r} * sqrt({_d(psi)}) + {m!r}) / {_d('n')})"
        out.append((f"{p}_par", f"SELECT pop, n, {tt} AS tt, {off} AS off, {pe} AS pr FROM "
                                f"(SELECT pop, count(*) AS n FROM {p}_pts GROUP BY pop)"))
        out.append((f"{p}_par2", f"SELECT *, CASE WHEN pr >= 1.0 THEN NULL ELSE ln(1.0 - pr) END AS lq FROM {p}_par"))

        def skip(k: str) -> str:
            return f"CASE WHEN q.lq IS NULL THEN 0 ELSE CAST(floor(ln(1.0 - {u_sql(str(s), 'q.id', k)}) / q.lq) AS BIGINT) END"

        out.append((f"{p}_surv", f"SELECT * FROM (SELECT q.id, q.x, q.pop, q.tt, q.off, q.lq, {skip('1')} AS s1 "
                                 f"FROM (SELECT a.*, b.tt, b.off, b.lq FROM {p}_pts a JOIN {p}_par2 b USING (pop)) q) "
                                 f"WHERE s1 < tt"))
        out.append((f"{p}_hop", f"SELECT q.id, r.k, CASE WHEN r.k = 1 THEN q.s1 ELSE {skip('r.k')} END AS sk, q.tt, q.off "
                                f"FROM {p}_surv q JOIN (SELECT range AS k FROM range(1, {self.total + 1})) r ON r.k <= q.tt"))
        out.append((f"{p}_pos", f"SELECT id, off, tt, sum(sk + 1) OVER (PARTITION BY id ORDER BY k) - 1 AS pos FROM {p}_hop"))
        out.append((f"{p}_cand", f"SELECT c.id, s.x, c.pos + c.off AS tree FROM {p}_pos c JOIN {p}_surv s USING (id) "
                                 f"WHERE c.pos < c.tt"))
        order = u_sql(sql_str(f"{s}o"), "id", "tree")
        out.append((f"{p}_sample", f"SELECT tree, id, x FROM (SELECT *, row_number() OVER (PARTITION BY tree "
                                   f"ORDER BY {order}, id) AS rn FROM {p}_cand) WHERE rn <= {psi}"))
        return out

    # ------------------------------------------------------------ growth
    def growth_ctes(self) -> list[tuple[str, str]]:
        p, s, d, L = self.p, self.seed, self.pts.d, self.L
        out = self.sample_ctes()
        out.append((f"{p}_l0", f"SELECT tree, id, x, CAST(0 AS BIGINT) AS node FROM {p}_sample"))
        node_parts = []
        for e in range(L + 1):
            out.append((f"{p}_n{e}", f"SELECT tree, node, count(*) AS size FROM {p}_l{e} GROUP BY tree, node"))
            if e < L:
                qd = u_sql(str(s), sql_str("s"), "tree", "node")
                out.append((f"{p}_sq{e}", f"SELECT tree, node, CAST(floor({qd} * {float(d)!r}) AS INTEGER) AS q "
                                          f"FROM {p}_n{e} WHERE size > 1"))
                out.append((f"{p}_mm{e}", f"SELECT l.tree, l.node, min(l.x[s.q + 1]) AS lo, max(l.x[s.q + 1]) AS hi "
                                          f"FROM {p}_l{e} l JOIN {p}_sq{e} s USING (tree, node) GROUP BY l.tree, l.node"))
                pd_ = u_sql(str(s), sql_str("s"), "tree", "node", second=True)
                out.append((f"{p}_sp{e}", f"SELECT s.tree, s.node, s.q, m.lo + {pd_} * (m.hi - m.lo) AS thr "
                                          f"FROM {p}_sq{e} s JOIN {p}_mm{e} m USING (tree, node)"))
                out.append((f"{p}_l{e + 1}", f"SELECT l.tree, l.id, l.x, CASE WHEN l.x[s.q + 1] < s.thr "
                                             f"THEN 2 * l.node + 1 ELSE 2 * l.node + 2 END AS node "
                                             f"FROM {p}_l{e} l JOIN {p}_sp{e} s USING (tree, node)"))
                node_parts.append(
                    f"SELECT n.tree, n.node, {e} AS depth, n.size, s.q AS feature, s.thr AS threshold, "
                    f"(s.thr IS NULL) AS is_leaf FROM {p}_n{e} n LEFT JOIN {p}_sp{e} s USING (tree, node)")
            else:
                node_parts.append(f"SELECT tree, node, {e} AS depth, size, CAST(NULL AS INTEGER) AS feature, "
                                  f"CAST(NULL AS DOUBLE) AS threshold, TRUE AS is_leaf FROM {p}_n{e}")
            if e > 0:
                # children of level e-1 splits that received no rows: empty leaves
                for k in (1, 2):
                    node_parts.append(
                        f"SELECT s.tree, 2 * s.node + {k} AS node, {e} AS depth, CAST(0 AS BIGINT) AS size, "
                        f"CAST(NULL AS INTEGER) AS feature, CAST(NULL AS DOUBLE) AS threshold, TRUE AS is_leaf "
                        f"FROM {p}_sp{e - 1} s ANTI JOIN {p}_n{e} n ON n.tree = s.tree AND n.node = 2 * s.node + {k}")
        out.append((f"{p}_nodes", "SELECT CAST(tree // " + str(self.n_trees) + " AS INTEGER) AS \"group\", "
                                  "CAST(tree AS INTEGER) AS tree, CAST(node AS BIGINT) AS node, "
                                  "CAST(depth AS INTEGER) AS depth, CAST(size AS BIGINT) AS size, "
                                  "CAST(feature AS INTEGER) AS feature, threshold, is_leaf FROM ("
                                  + " UNION ALL ".join(node_parts) + ")"))
        return out

    # ------------------------------------------------------------ scoring
    def path_ctes(self, score_pts: str, local: bool = False) -> list[tuple[str, str]]:
        """``{p}_h``: (id, tree, path_length, leaf) for every row of ``score_pts`` (id, x[, pop])."""
        p, L = self.p, self.L
        out = self.growth_ctes()
        if local:
            out.append((f"{p}_s0", f"SELECT q.id, q.x, t.tree, CAST(0 AS BIGINT) AS node FROM ({score_pts}) q "
                                   f"JOIN (SELECT DISTINCT tree, \"group\" FROM {p}_nodes) t ON t.\"group\" = q.pop"))
        else:
            out.append((f"{p}_s0", f"SELECT q.id, q.x, t.tree, CAST(0 AS BIGINT) AS node FROM ({score_pts}) q "
                                   f"JOIN (SELECT DISTINCT tree FROM {p}_nodes) t ON TRUE"))
        fins = []
        for e in range(L + 1):
            out.append((f"{p}_j{e}", f"SELECT s.id, s.x, s.tree, s.node, n.is_leaf, n.feature, n.threshold, "
                                     f"n.depth, n.size FROM {p}_s{e} s JOIN {p}_nodes n USING (tree, node)"))
            fins.append(f"SELECT id, tree, depth + {c_factor_sql('size')} AS path_length, node AS leaf, depth AS leaf_depth "
                        f"FROM {p}_j{e} WHERE is_leaf")
            if e < L:
                out.append((f"{p}_s{e + 1}", f"SELECT id, x, tree, CASE WHEN x[feature + 1] < threshold "
                                             f"THEN 2 * node + 1 ELSE 2 * node + 2 END AS node "
                                             f"FROM {p}_j{e} WHERE NOT is_leaf"))
        out.append((f"{p}_h", " UNION ALL ".join(fins)))
        return out

    def score_select(self, combine: str = "forest") -> str:
        """Per-id (id, path_mean, score) over ``{p}_h``."""
        p, c = self.p, repr(self.c_psi)
        if combine == "forest":
            return (f"SELECT id, sum(path_length) / {float(self.total)!r} AS path_mean, "
                    f"pow(2.0, -(sum(path_length) / {float(self.total)!r}) / {c}) AS score FROM {p}_h GROUP BY id")
        if combine == "mean_of_forests":
            T = float(self.n_trees)
            return (f"SELECT id, sum(hs) / {float(self.total)!r} AS path_mean, avg(pow(2.0, -(hs / {T!r}) / {c})) AS score "
                    f"FROM (SELECT id, tree // {self.n_trees} AS g, sum(path_length) AS hs FROM {p}_h GROUP BY id, g) "
                    f"GROUP BY id")
        if combine == "local":
            T = float(self.n_trees)
            return (f"SELECT id, sum(path_length) / {T!r} AS path_mean, pow(2.0, -(sum(path_length) / {T!r}) / {c}) "
                    f"AS score FROM {p}_h GROUP BY id")
        raise ValueError(combine)


@dataclass
class BottomSQL(ForestSQL):
    """A forest on mergeable samples: per tree the psi rows of least key (``operators.sketch``),
    by its own choice of level."""

    def sample_ctes(self) -> list[tuple[str, str]]:
        p, s, psi, T = self.p, str(self.seed), self.psi, self.total
        need = psi + 8 * math.sqrt(psi) + 8
        level = " + ".join(f"CAST(n >= {need * 16 ** (j + 1)!r} AS INTEGER)" for j in range(1, LEVELS))  # one below what rows ask for
        out = [(f"{p}_pts", f"SELECT id, x, 0 AS pop FROM ({self.pts.valid_rows()})"),
               (f"{p}_lv", f"SELECT {level} AS lv FROM (SELECT count(*) AS n FROM {p}_pts)")]
        consts = ", ".join(f"({j}, {math.log1p(-hit_probability(j))!r}::DOUBLE, {key_range(j)[0]!r}::DOUBLE, {key_range(j)[1]!r}::DOUBLE)" for j in range(1, LEVELS + 1))
        out.append((f"{p}_js", f"SELECT * FROM (VALUES {consts}) t(j, lq, low, width) WHERE j >= (SELECT lv FROM {p}_lv)"))
        out.append((f"{p}_hit", f"SELECT * FROM (SELECT q.id, c.*, CAST(floor(ln(1.0 - {u_sql(s, sql_str('b'), 'c.j', 'q.id', '1')}) / c.lq) AS BIGINT) AS s1 "
                                f"FROM {p}_pts q, {p}_js c) WHERE s1 < {T}"))
        hop = u_sql(s, sql_str("b"), "h.j", "h.id", "r.k")
        out.append((f"{p}_hop", f"SELECT h.*, r.k, CASE WHEN r.k = 1 THEN h.s1 ELSE CAST(floor(ln(1.0 - {hop}) / h.lq) AS BIGINT) END AS sk "
                                f"FROM {p}_hit h JOIN (SELECT range AS k FROM range(1, {T + 1})) r ON r.k <= {T} - h.s1"))
        out.append((f"{p}_pos", f"SELECT id, j, low, width, sum(sk + 1) OVER (PARTITION BY id, j ORDER BY k) - 1 AS tree FROM {p}_hop"))
        key = f"low + width * {u_sql(s, sql_str('c'), 'j', 'id', 'CAST(tree AS BIGINT)')}"
        low, width = key_range(0)
        every = f"{low!r}::DOUBLE + {width!r}::DOUBLE * {u_sql(s, sql_str('c'), '0', 'id', 'tree')}"
        out.append((f"{p}_keys", f"SELECT id, CAST(tree AS BIGINT) AS tree, {key} AS key FROM {p}_pos WHERE tree < {T} UNION ALL "
                                 f"SELECT id, tree, {every} FROM {p}_pts, (SELECT range AS tree FROM range({T})) WHERE (SELECT lv FROM {p}_lv) = 0"))
        out.append((f"{p}_least", f"SELECT id, tree, min(key) AS key FROM {p}_keys GROUP BY id, tree"))
        out.append((f"{p}_sample", f"SELECT l.tree, l.id, q.x FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY key, id) AS rn FROM {p}_least) l "
                                   f"JOIN {p}_pts q USING (id) WHERE l.rn <= {psi}"))
        return out


def with_sql(ctes: list[tuple[str, str]], final: str) -> str:
    seen = {}
    for name, body in ctes:
        if name in seen and seen[name] != body:
            raise ValueError(f"CTE {name} defined twice differently")
        seen[name] = body
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in seen.items()) + "\n" + final


__all__ = ["PointsSQL", "ForestSQL", "BottomSQL", "with_sql", "sql_double"]
