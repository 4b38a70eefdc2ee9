"""Heap-number arithmetic on tree paths, as JVM Column expressions.

Node numbers follow the heap rule: root r, left child 2r+1, right child 2r+2.  So
``node + 1`` written in binary is a leading 1 followed by the path bits (L = 0, R = 1),
and branches, ancestors and lookups are pure integer maths -- no joins, no UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def branch_of(node, depth) -> Column:
    """array<string> of 'L'/'R' decisions from the root to ``node`` (empty for the root)."""
    node, depth = _c(node).cast("bigint"), _c(depth).cast("int")
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
        lambda i: F.when(F.call_function("shiftright", node + F.lit(1), depth - i).bitwiseAND(F.lit(1)) == 0, F.lit("L"))
        .otherwise(F.lit("R")),
    )
    return F.when(depth <= 0, F.array().cast("array<string>")).otherwise(steps)


def branch_string(node, depth) -> Column:
    return F.array_join(branch_of(node, depth), "")


def node_at_path(path) -> Column:
    """Heap number reached by following the letters of ``path``; other letters are ignored."""
    chars = F.split(_c(path), "")
    return F.aggregate(
        chars, F.lit(0).cast("bigint"),
        lambda acc, ch: F.when(ch == "L", acc * 2 + 1).when(ch == "R", acc * 2 + 2).otherwise(acc),
    )


def branch_numbers(branch, init_root=0) -> Column:
    """Node numbers along a branch string, starting at ``init_root`` (ancestors incl. root)."""
    chars = F.split(_c(branch), "")
    start = F.array(F.lit(int(init_root)).cast("bigint")) if not isinstance(init_root, Column) else F.array(
        init_root.cast("bigint"))
    return F.aggregate(
        chars, start,
        lambda acc, ch: F.when(ch == "L", F.concat(acc, F.array(F.element_at(acc, -1) * 2 + 1)))
        .when(ch == "R", F.concat(acc, F.array(F.element_at(acc, -1) * 2 + 2)))
        .otherwise(acc),
    )




def branch_string_sql(node: str, depth: str) -> str:
    return (f"array_to_string(list_transform(range(1, {depth} + 1), lambda i: CASE WHEN "
            f"(({node} + 1) >> ({depth} - i)) & 1 = 0 THEN 'L' ELSE 'R' END), '')")


def node_at_path_sql(path: str) -> str:
    return (f"list_reduce(string_split({path}, ''), lambda acc, ch: CASE WHEN ch = 'L' THEN acc * 2 + 1 "
            f"WHEN ch = 'R' THEN acc * 2 + 2 ELSE acc END, CAST(0 AS BIGINT))")


def branch_numbers_sql(branch: str, init_root: int = 0) -> str:
    return (f"list_reduce(string_split({branch}, ''), lambda acc, ch: CASE WHEN ch = 'L' THEN "
            f"list_append(acc, acc[-1] * 2 + 1) WHEN ch = 'R' THEN list_append(acc, acc[-1] * 2 + 2) ELSE acc END, "
            f"[CAST({int(init_root)} AS BIGINT)])")
