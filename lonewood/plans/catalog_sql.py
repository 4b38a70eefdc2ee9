"""DuckDB SQL twins of the registered queries (see ``catalog``)."""

from __future__ import annotations

from ..functions.draws import c_factor_py, c_factor_sql, sql_str, u_sql
from ..functions.paths import branch_numbers_sql, branch_string_sql, node_at_path_sql
from .catalog import (CUST, LINE_KEYS, LINE_NEW, M_CUST, M_EMB, M_EVT, M_EVT_F, M_LINE, M_ORD, M_ORD_B, M_ORD_C, M_ORD_CC, M_ORD_K,
                      M_ORD_R, M_PART, ORD, RK, R, Spec)
from .oracle import BottomSQL, with_sql


def rr(e: str, n: int = R) -> str:
    return f"round({e}, {n})"


def nodes_sql(spec: Spec, final: str, p: str = "f") -> str:
    return with_sql(spec.sql(p).growth_ctes(), final)


def _bottom(spec: Spec) -> BottomSQL:
    return BottomSQL(spec.scen.psql(), spec.n_trees, spec.psi, spec.seed)


def _scores_ctes(spec: Spec, combine: str = "forest", p: str = "f", data=None):
    """CTEs ending in ``{p}_sc`` (id, path_mean, score) for the rows of ``data``."""
    fs = spec.sql(p)
    scen = data or spec.scen
    pts = scen.psql().all_rows()
    if combine == "local":
        pts = f"SELECT q.id, q.x, {fs.group_expr('q.id')} AS pop FROM ({pts}) q"
    ctes = fs.path_ctes(pts, local=(combine == "local"))
    ctes.append((f"{p}_sc", fs.score_select(combine)))
    return ctes


def scores_sql(spec: Spec, combine: str = "forest") -> str:
    return with_sql(_scores_ctes(spec, combine), f"SELECT id, {rr('path_mean')} AS path_mean, {rr('score')} AS score "
                                                  f"FROM f_sc")


def paths_sql(spec: Spec, final: str) -> str:
    fs = spec.sql("f")
    return with_sql(fs.path_ctes(spec.scen.psql().all_rows()), final)


def _forest_stats_sql(spec: Spec, by_group: bool) -> str:
    fs = spec.sql("f")
    sel_g = 'CAST("group" AS BIGINT) AS "group", ' if by_group else ""
    grp = f'GROUP BY "group"' if by_group else ""
    agg = (f"SELECT {sel_g}CAST(count(DISTINCT tree) AS BIGINT) AS n_trees, count(*) AS n_nodes, "
           f"count(*) FILTER (WHERE is_leaf) AS n_leaves, "
           f"CAST(sum(CASE WHEN is_leaf THEN size ELSE 0 END) AS BIGINT) AS leaf_size_sum, "
           f"CAST(max(depth) AS BIGINT) AS max_depth FROM f_nodes {grp}")
    if by_group and spec.assign == "all":
        rows = f'SELECT CAST(range AS BIGINT) AS "group", (SELECT count(*) FROM f_pts) AS n_rows FROM range({spec.groups})'
    elif by_group:
        rows = 'SELECT CAST(pop AS BIGINT) AS "group", count(*) AS n_rows FROM f_pts GROUP BY pop'
    if by_group:
        final = (f"SELECT a.*, c.n_rows, CAST({spec.psi} AS BIGINT) AS psi, CAST({fs.L} AS BIGINT) AS depth_limit, "
                 f"{rr(repr(c_factor_py(spec.psi)))} AS c_psi FROM ({agg}) a JOIN ({rows}) c USING (\"group\")")
    else:
        final = (f"SELECT a.*, (SELECT count(*) FROM f_pts) AS n_rows, CAST({spec.psi} AS BIGINT) AS psi, "
                 f"CAST({fs.L} AS BIGINT) AS depth_limit, {rr(repr(c_factor_py(spec.psi)))} AS c_psi FROM ({agg}) a")
    return with_sql(fs.growth_ctes(), final)


NODES_OUT = ('CAST("group" AS BIGINT) AS "group", CAST(tree AS BIGINT) AS tree, node, CAST(depth AS BIGINT) AS depth, '
             'size, CAST(coalesce(feature, -1) AS BIGINT) AS feature, threshold, is_leaf')


def _ranked(spec: Spec, p: str, combine: str = "forest", data=None):
    ctes = _scores_ctes(spec, combine, p, data)
    ctes.append((f"{p}_rk", f"SELECT id, score, round(score, {RK}) AS rscore FROM {p}_sc"))
    return ctes


def _aligned(run: Spec, combine: str = "forest"):
    ctes = _ranked(M_ORD_B, "b") + _ranked(run, "u", combine)
    ctes.append(("al", "SELECT b.id, b.rscore AS benchmark, u.rscore AS run FROM b_rk b JOIN u_rk u USING (id)"))
    return ctes


def _rel_diff(name: str = "al") -> str:
    pct = "(100.0 * (run - benchmark) / benchmark)"
    return f"SELECT id, benchmark, run, {pct} * {pct} AS rel_diff_sq, abs({pct}) AS abs_pct_diff FROM {name}"


def hist_fixed_sql(ctes, src: str, col: str, bins: int = 19, lo: float = 0.0, hi: float = 1.0) -> str:
    width = (hi - lo) / bins
    b = f"CAST(least(floor(({col} - {lo!r}) / {hi - lo!r} * {float(bins)!r}), {bins - 1}) AS INTEGER)"
    ctes = ctes + [
        ("hin", f"SELECT {b} AS bin FROM {src} WHERE {col} >= {lo!r} AND {col} <= {hi!r}"),
        ("hc", "SELECT bin, count(*) AS count FROM hin GROUP BY bin"),
        ("ht", "SELECT count(*) AS total FROM hin"),
    ]
    final = (f"SELECT CAST(r.bin AS BIGINT) AS bin, {rr(f'{lo!r} + r.bin * {width!r}')} AS edge_lo, "
             f"{rr(f'{lo!r} + (r.bin + 1) * {width!r}')} AS edge_hi, CAST(coalesce(hc.count, 0) AS BIGINT) AS count, "
             f"{rr(f'CASE WHEN ht.total > 0 THEN coalesce(hc.count, 0) / (ht.total * {width!r}) ELSE 0.0 END')} "
             f"AS density FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) r "
             f"LEFT JOIN hc USING (bin), ht")
    return with_sql(ctes, final)


def fd_sql(limit: int | None = 50) -> str:
    bins = "ceil((hi - lo) / w)" if limit is None else f"least({limit}, ceil((hi - lo) / w))"
    ctes = _ranked(M_ORD, "f")
    ctes += [
        ("st", "SELECT count(*) AS n, min(rscore) AS lo, max(rscore) AS hi FROM f_rk"),
        ("rk", "SELECT rscore AS v, row_number() OVER (ORDER BY rscore, id) - 1 AS i FROM f_rk"),
        ("qp", "SELECT (n - 1) * 0.25 AS h25, (n - 1) * 0.75 AS h75 FROM st"),
        ("qv", "SELECT (SELECT v FROM rk WHERE i = CAST(floor(h25) AS BIGINT)) AS a25, "
               "(SELECT v FROM rk WHERE i = CAST(ceil(h25) AS BIGINT)) AS b25, "
               "(SELECT v FROM rk WHERE i = CAST(floor(h75) AS BIGINT)) AS a75, "
               "(SELECT v FROM rk WHERE i = CAST(ceil(h75) AS BIGINT)) AS b75, h25, h75 FROM qp"),
        ("qq", "SELECT a25 + (h25 - floor(h25)) * (b25 - a25) AS q25, a75 + (h75 - floor(h75)) * (b75 - a75) AS q75 FROM qv"),
        ("fw", "SELECT st.*, 2.0 * (q75 - q25) / pow(CAST(n AS DOUBLE), 1.0 / 3.0) AS w FROM st, qq"),
        ("nb", "SELECT n, lo, hi, CAST(CASE WHEN hi - lo <= 0 THEN 1 WHEN w <= 0 THEN "
               f"{limit or 50} ELSE greatest(1, {bins}) END AS BIGINT) AS nb FROM fw"),
        ("hb", "SELECT CAST(least(floor((f_rk.rscore - nb.lo) / (CASE WHEN nb.hi - nb.lo > 0 THEN nb.hi - nb.lo ELSE 1.0 END)"
               " * CAST(nb.nb AS DOUBLE)), nb.nb - 1) AS BIGINT) AS bin FROM f_rk, nb"),
        ("hc", "SELECT bin, count(*) AS count FROM hb GROUP BY bin"),
    ]
    width = "(CASE WHEN nb.hi - nb.lo > 0 THEN (nb.hi - nb.lo) / nb.nb ELSE 1.0 END)"
    final = (f"SELECT nb.bin, {rr(f'nb.lo + nb.bin * {width}')} AS edge_lo, "
             f"{rr(f'nb.lo + (nb.bin + 1) * {width}')} AS edge_hi, CAST(coalesce(hc.count, 0) AS BIGINT) AS count, "
             f"{rr(f'coalesce(hc.count, 0) / (nb.n * {width})')} AS density "
             f"FROM (SELECT *, unnest(range(nb)) AS bin FROM nb) nb LEFT JOIN hc USING (bin)")
    return with_sql(ctes, final)


def kde_sql(grid: int = 100, cut: float = 3.0) -> str:
    ctes = _ranked(M_ORD, "f")
    ctes += [
        ("st", f"SELECT count(rscore) AS n, stddev_samp(rscore) * pow(CAST(count(rscore) AS DOUBLE), -1.0 / 5.0) AS h, "
               f"min(rscore) AS lo, max(rscore) AS hi FROM f_rk"),
        ("gd", f"SELECT CAST(range AS INTEGER) AS gi, (st.lo - {cut!r} * st.h) + range * "
               f"((st.hi + {cut!r} * st.h) - (st.lo - {cut!r} * st.h)) / {grid - 1} AS gx FROM range({grid}), st"),
        ("kd", "SELECT gd.gi, gd.gx, sum(exp(-0.5 * ((gd.gx - f_rk.rscore) / st.h) * ((gd.gx - f_rk.rscore) / st.h))) "
               "AS ks FROM gd, f_rk, st GROUP BY gd.gi, gd.gx"),
    ]
    final = (f"SELECT CAST(gi AS BIGINT) AS grid_index, {rr('gx')} AS x, "
             f"{rr('ks / (st.n * st.h * sqrt(2.0 * pi()))')} AS density FROM kd, st")
    return with_sql(ctes, final)


def kde_binned_sql(grid: int = 100, cut: float = 3.0, cells: int = 2048) -> str:
    ctes = _ranked(M_ORD, "f")
    ctes += [
        ("st", f"SELECT count(rscore) AS n, stddev_samp(rscore) * pow(CAST(count(rscore) AS DOUBLE), -1.0 / 5.0) AS h, "
               f"min(rscore) AS lo, max(rscore) AS hi, (max(rscore) - min(rscore)) / {cells - 1} AS step FROM f_rk"),
        ("pl", "SELECT (rscore - lo) / step AS place FROM f_rk, st"),
        ("ce", f"SELECT CAST(least(floor(place), {cells - 2}) AS BIGINT) AS cell, place FROM pl"),
        ("we", "SELECT cell, sum(w) AS w FROM (SELECT cell, 1 - (place - cell) AS w FROM ce "
               "UNION ALL SELECT cell + 1 AS cell, place - cell AS w FROM ce) GROUP BY cell"),
        ("gd", f"SELECT CAST(range AS INTEGER) AS gi, (st.lo - {cut!r} * st.h) + range * "
               f"((st.hi + {cut!r} * st.h) - (st.lo - {cut!r} * st.h)) / {grid - 1} AS gx FROM range({grid}), st"),
        ("kd", "SELECT gi, gx, sum(w * exp(-0.5 * pow((gx - (st.lo + we.cell * st.step)) / st.h, 2))) AS ks FROM gd, we, st GROUP BY gi, gx"),
    ]
    final = (f"SELECT CAST(gi AS BIGINT) AS grid_index, {rr('gx')} AS x, "
             f"{rr('ks / (st.n * st.h * sqrt(2.0 * pi()))')} AS density FROM kd, st")
    return with_sql(ctes, final)


def position_sql() -> str:
    ctes = _ranked(M_ORD, "t") + _ranked(M_ORD, "q", data=LINE_NEW)
    n_train = "(SELECT count(*) FROM t_rk)"
    final = (f"SELECT q.rscore AS score, (SELECT count(*) FROM t_rk t WHERE t.rscore <= q.rscore) AS n_train_le, "
             f"{rr(f'CAST((SELECT count(*) FROM t_rk t WHERE t.rscore <= q.rscore) AS DOUBLE) / {n_train}')} AS frac_train_le, "
             f"CAST(least(floor(q.rscore * 19.0), 18) AS BIGINT) AS bin FROM q_rk q")
    return with_sql(ctes, final)


def _cust_branches() -> list:
    fs = M_CUST.sql("f")
    ctes = fs.growth_ctes()
    ctes.append(("br", f"SELECT tree, node AS leaf, size, depth, {branch_string_sql('node', 'depth')} AS branch "
                       f"FROM f_nodes WHERE is_leaf"))
    ctes.append(("bn", f"SELECT tree, leaf, {branch_numbers_sql('branch', 0)} AS numbers FROM br"))
    ctes.append(("vx", "SELECT DISTINCT tree, unnest(numbers) AS node FROM bn"))
    return ctes


LINE_ORDER = ", ".join(LINE_KEYS)

ORACLE: dict[str, str] = {
    "csv_points_scan": "SELECT CAST(c_acctbal AS DOUBLE) AS x0, CAST(c_nationkey AS DOUBLE) AS x1 FROM customer",
    "text_points_parse": "SELECT CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part",
    "point_literal_parse": ("SELECT CAST(c_custkey AS BIGINT) AS id, CAST(2 AS BIGINT) AS n_values, "
                            "CAST(c_acctbal AS DOUBLE) AS x0, CAST(c_nationkey AS DOUBLE) AS x1 FROM customer"),
    "assemble_features": ("SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(2 AS BIGINT) AS n_values, "
                          "CAST(o_totalprice AS DOUBLE) AS x0, CAST(dayofyear(o_orderdate) AS DOUBLE) AS x1 FROM orders"),
    "model_roundtrip": nodes_sql(M_ORD, "SELECT CAST(tree AS BIGINT) AS tree, count(*) AS n_nodes, "
                                        "CAST(sum(size) AS BIGINT) AS size_sum, "
                                        "CAST(sum(CAST(floor(threshold * 1000) AS BIGINT)) AS BIGINT) AS threshold_sum, "
                                        "CAST(sum(CAST(feature AS BIGINT) * node) AS BIGINT) AS feature_sum, "
                                        f"CAST({M_ORD.psi} AS BIGINT) AS psi, CAST({M_ORD.sql('f').L} AS BIGINT) AS depth_limit, "
                                        "(SELECT count(*) FROM orders) AS n_rows, "
                                        f"CAST({M_ORD.seed} AS BIGINT) AS seed, CAST({len(ORD.feats)} AS BIGINT) AS n_features "
                                        "FROM f_nodes GROUP BY tree"),
    "bundle_scores_roundtrip": scores_sql(M_CUST),
    "split_children": nodes_sql(M_ORD, (
        "SELECT CAST(tree AS BIGINT) AS tree, k AS node, max(size) FILTER (s = 0) AS size, "
        "CAST(max(feature) FILTER (s = 0) AS BIGINT) AS feature, max(threshold) FILTER (s = 0) AS threshold, "
        "max(size) FILTER (s = 1 AND node % 2 = 1) AS left_size, max(size) FILTER (s = 1 AND node % 2 = 0) AS right_size "
        "FROM (SELECT *, CASE WHEN s = 0 THEN node ELSE (node - 1) // 2 END AS k FROM f_nodes, (VALUES (0), (1)) v(s) "
        "WHERE s = 0 OR node > 0) GROUP BY tree, k HAVING NOT bool_and(is_leaf) FILTER (s = 0)")),
    "chunk_hash": (f"SELECT CAST(o_orderkey AS BIGINT) AS id, "
                   f"CAST(floor({u_sql('11', sql_str('g'), 'o_orderkey')} * 4.0) AS BIGINT) AS \"group\" FROM orders"),
    "chunk_contiguous": ("SELECT id, CAST(least(floor(i / greatest(1, n // 4)), 3) AS BIGINT) AS \"group\" FROM "
                         "(SELECT CAST(o_orderkey AS BIGINT) AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, "
                         "count(*) OVER () AS n FROM orders)"),
    "label_layers": with_sql(_ranked(M_ORD, "f"), (
        "SELECT id, round(score, 6) AS score, CASE WHEN id IN (SELECT id FROM f_rk ORDER BY rscore ASC, id ASC LIMIT 10) "
        "THEN 'bottom' WHEN id IN (SELECT id FROM f_rk ORDER BY rscore DESC, id ASC LIMIT 10) THEN 'top' "
        "ELSE 'other' END AS layer FROM f_rk")),
    "tree_samples": with_sql(M_ORD.sql("f").sample_ctes(), "SELECT CAST(tree AS BIGINT) AS tree, id FROM f_sample"),
    "root_splits": with_sql(M_ORD.sql("f").growth_ctes(), (
        "SELECT CAST(n.tree AS BIGINT) AS tree, CAST(n.feature AS BIGINT) AS feature, n.threshold, "
        "min(s.x[n.feature + 1]) AS lo, max(s.x[n.feature + 1]) AS hi, count(*) AS n FROM f_sample s "
        "JOIN f_nodes n ON n.tree = s.tree AND n.node = 0 GROUP BY n.tree, n.feature, n.threshold")),
    "tree_nodes": nodes_sql(M_ORD, f"SELECT {NODES_OUT} FROM f_nodes"),
    "fit_forest_stats": _forest_stats_sql(M_ORD, False),
    "fit_k_full": _forest_stats_sql(M_ORD_K, True),
    "fit_k_chunks": _forest_stats_sql(M_ORD_C, True),
    "fit_k_contiguous": _forest_stats_sql(M_ORD_CC, True),
    "path_lengths": paths_sql(M_CUST, f"SELECT id, CAST(tree AS BIGINT) AS tree, {rr('path_length')} AS path_length, "
                                      f"leaf FROM f_h"),
    "path_trace": paths_sql(M_CUST, f"SELECT id, CAST(tree AS BIGINT) AS tree, "
                                    f"{branch_string_sql('leaf', 'leaf_depth')} AS branch FROM f_h"),
    "score_forest": scores_sql(M_ORD),
    "score_per_tree": paths_sql(M_CUST, f"SELECT id, CAST(tree AS BIGINT) AS tree, "
                                        f"{rr(f'pow(2.0, -path_length / {c_factor_py(M_CUST.psi)!r})')} AS score FROM f_h"),
    "score_mean_of_forests": scores_sql(M_ORD_C, "mean_of_forests"),
    "score_k_full": scores_sql(M_ORD_K, "mean_of_forests"),
    "score_product": paths_sql(M_CUST, f"SELECT id, {rr(f'product(pow(2.0, -path_length / {float(M_CUST.n_trees)!r} / {c_factor_py(M_CUST.psi)!r}))')} "
                                       f"AS score FROM f_h GROUP BY id"),
    "score_by_tree_agg": paths_sql(M_CUST, f"SELECT id, {rr('avg(path_length)')} AS path_mean, "
                                           f"{rr(f'pow(2.0, -avg(path_length) / {c_factor_py(M_CUST.psi)!r})')} AS score "
                                           f"FROM f_h GROUP BY id"),
    "score_local": scores_sql(M_ORD_C, "local"),
    "score_local_contiguous": scores_sql(M_ORD_CC, "local"),
    "score_point": scores_sql(M_CUST),
    "score_table": with_sql(_scores_ctes(M_PART), (
        f"SELECT CAST(p.p_retailprice AS DOUBLE) AS x0, CAST(p.p_size AS DOUBLE) AS x1, {rr('s.score')} AS score "
        f"FROM part p JOIN f_sc s ON s.id = p.p_partkey")),
    "score_embeddings": scores_sql(M_EMB),
    "score_events": scores_sql(M_EVT),
    "score_lineitem": scores_sql(M_LINE),
    "tree_nodes_by_level": nodes_sql(M_ORD, f"SELECT {NODES_OUT} FROM f_nodes"),
    "saved_runs_aligned": with_sql(_aligned(M_ORD_R), "SELECT id, benchmark, run FROM al"),
    "series_total": ("SELECT nationkey, round(c.balance + s.balance, 2) AS balance FROM "
                     "(SELECT CAST(c_nationkey AS BIGINT) AS nationkey, sum(c_acctbal) AS balance FROM customer GROUP BY 1) c JOIN "
                     "(SELECT CAST(s_nationkey AS BIGINT) AS nationkey, sum(s_acctbal) AS balance FROM supplier GROUP BY 1) s USING (nationkey)"),
    "hist_scores_fd_rule": fd_sql(None),
    "hist_point_tree_scores": with_sql(
        M_CUST.sql("f").path_ctes(CUST.psql().all_rows()) + [
            ("pts_s", f"SELECT id, CAST(least(floor(round(pow(2.0, -path_length / {c_factor_py(M_CUST.psi)!r}), {RK}) * 19.0), 18) AS BIGINT) AS bin FROM f_h"),
            ("pc", "SELECT id, bin, count(*) AS count FROM pts_s GROUP BY id, bin"),
            ("pt", "SELECT id, sum(count) AS total FROM pc GROUP BY id")],
        f"SELECT t.id, r.bin, CAST(coalesce(pc.count, 0) AS BIGINT) AS count, {rr('coalesce(pc.count, 0) / (t.total * (1.0 / 19))')} AS density "
        f"FROM pt t CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range(19)) r LEFT JOIN pc ON pc.id = t.id AND pc.bin = r.bin"),
    "stream_score_events": scores_sql(M_EVT),
    "merged_samples": with_sql(_bottom(M_ORD).sample_ctes(), "SELECT tree, id FROM f_sample"),
    "tree_nodes_one_pass": with_sql(_bottom(M_ORD).growth_ctes(), f"SELECT {NODES_OUT} FROM f_nodes"),
    "stream_refit_events": with_sql(_bottom(M_EVT_F).growth_ctes(), f"SELECT {NODES_OUT} FROM f_nodes"),
    "stream_refit_scores": with_sql([*_bottom(M_EVT_F).path_ctes(M_EVT_F.scen.psql().all_rows()), ("f_sc", _bottom(M_EVT_F).score_select())],
                                    f"SELECT id, {rr('path_mean')} AS path_mean, {rr('score')} AS score FROM f_sc"),
    "fit_score_save": with_sql(_ranked(M_CUST, "f"), "SELECT id, round(score, 6) AS score FROM f_rk "
                                                     "ORDER BY rscore DESC, id ASC LIMIT 10"),
    "c_factor": f"SELECT n, {rr(c_factor_sql('n'))} AS c FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part)",
    "node_at_path": nodes_sql(M_ORD, f"SELECT CAST(tree AS BIGINT) AS tree, node, CAST(depth AS BIGINT) AS depth, size, "
                                     f"is_leaf FROM f_nodes WHERE node = {node_at_path_sql(repr('LR'))} AND depth = 2"),
    "leaf_branches": with_sql(_cust_branches(), "SELECT CAST(tree AS BIGINT) AS tree, leaf, size, branch FROM br"),
    "branch_numbers": with_sql(_cust_branches(), "SELECT CAST(tree AS BIGINT) AS tree, leaf, "
                                                 "array_to_string(numbers, ',') AS numbers FROM bn"),
    "tree_vertices": with_sql(_cust_branches(), "SELECT CAST(tree AS BIGINT) AS tree, node, "
                                                "'t' || CAST(tree AS VARCHAR) || ':' || CAST(node AS VARCHAR) AS name FROM vx"),
    "tree_edges": with_sql(_cust_branches(), (
        "SELECT DISTINCT CAST(tree AS BIGINT) AS tree, numbers[i] AS parent, numbers[i + 1] AS child, "
        "CASE WHEN numbers[i + 1] = numbers[i] * 2 + 1 THEN 'L' ELSE 'R' END AS side "
        "FROM (SELECT tree, numbers, unnest(range(1, len(numbers))) AS i FROM bn WHERE len(numbers) > 1)")),
    "tree_max_node": with_sql(_cust_branches(), "SELECT CAST(tree AS BIGINT) AS tree, max(node) AS max_node, "
                                                "count(*) AS n_vertices FROM vx GROUP BY tree"),
    "tree_stats": nodes_sql(M_ORD, (
        'SELECT CAST("group" AS BIGINT) AS "group", CAST(tree AS BIGINT) AS tree, count(*) AS n_nodes, '
        "count(*) FILTER (WHERE is_leaf) AS n_leaves, count(*) FILTER (WHERE is_leaf AND size = 0) AS n_empty_leaves, "
        "CAST(sum(CASE WHEN is_leaf THEN size ELSE 0 END) AS BIGINT) AS leaf_size_sum, CAST(max(depth) AS BIGINT) "
        "AS max_depth, CAST(max(CASE WHEN node = 0 THEN size END) AS BIGINT) AS root_size FROM f_nodes "
        'GROUP BY "group", tree')),
    "score_rel_diff": with_sql(_aligned(M_ORD_R), (
        f"SELECT id, benchmark, run, {rr('rel_diff_sq')} AS rel_diff_sq, "
        f"{rr('abs_pct_diff')} AS abs_pct_diff FROM ({_rel_diff()})")),
    "mean_var_pop": (f"SELECT event_type, count(value) AS n, {rr('avg(value)')} AS mean, {rr('var_pop(value)')} AS var_pop "
                     f"FROM events GROUP BY event_type"),
    "hist_tree_scores": hist_fixed_sql(
        M_CUST.sql("f").path_ctes(CUST.psql().all_rows()) + [
            ("pts_s", f"SELECT round(pow(2.0, -path_length / {c_factor_py(M_CUST.psi)!r}), {RK}) AS s FROM f_h")],
        "pts_s", "s", 19, 0.0, 1.0),
    "hist_scores_fd": fd_sql(),
    "kde_scores": kde_sql(),
    "score_e_metric": with_sql(_aligned(M_ORD_R), (
        f"SELECT count(*) AS n, {rr('100.0 * sqrt(sum(((run - benchmark) / benchmark) * ((run - benchmark) / benchmark))) / count(*)')} "
        f"AS e_metric FROM al")),
    "max_abs_pct_diff": with_sql(
        _aligned(M_ORD_R) + _ranked(M_ORD_C, "c", "mean_of_forests") + [
            ("al2", "SELECT b.id, b.rscore AS benchmark, c.rscore AS run FROM b_rk b JOIN c_rk c USING (id)"),
            ("d1", _rel_diff("al")), ("d2", _rel_diff("al2")),
            ("u", "SELECT 'serial_seed2' AS series, rel_diff_sq FROM d1 UNION ALL "
                  "SELECT 'chunks4' AS series, rel_diff_sq FROM d2")],
        f"SELECT series, {rr('sqrt(max(rel_diff_sq))')} AS max_abs_pct_diff FROM u GROUP BY series "
        f"UNION ALL SELECT '*' AS series, {rr('sqrt(max(rel_diff_sq))')} AS max_abs_pct_diff FROM u"),
    "score_position": position_sql(),
    "score_position_saved": position_sql(),
    "kde_scores_binned": kde_binned_sql(),
    "score_quartiles_sketch": with_sql(_ranked(M_ORD, "f"), (
        f"SELECT CAST(q AS DOUBLE) AS q, (SELECT count(*) FROM f_rk) AS n, {rr('v')} AS quantile, true AS within_error FROM (VALUES "
        + ", ".join(f"({q}, (SELECT quantile_cont(rscore, {q}) FROM f_rk))" for q in (0.25, 0.5, 0.75)) + ") t(q, v)")),
    "csv_row_ids": ("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, CAST(c_custkey AS DOUBLE) AS x0, "
                    "CAST(c_acctbal AS DOUBLE) AS x1 FROM customer"),
    "top_anomalies": with_sql(_ranked(M_ORD, "f"), "SELECT id, round(score, 6) AS score FROM f_rk "
                                                   "ORDER BY rscore DESC, id ASC LIMIT 10"),
    "bottom_normals": with_sql(_ranked(M_ORD, "f"), "SELECT id, round(score, 6) AS score FROM f_rk "
                                                    "ORDER BY rscore ASC, id ASC LIMIT 10"),
    "scores_by_benchmark_rank": with_sql(_aligned(M_ORD_R), (
        "SELECT row_number() OVER (ORDER BY benchmark, id) - 1 AS rank, id, benchmark, run FROM al")),
    "global_row_index": (f"SELECT row_number() OVER (ORDER BY {LINE_ORDER}) - 1 AS row_index, l_orderkey, l_linenumber, "
                         f"l_partkey, l_extendedprice FROM lineitem"),
}
