"""Seeded, portable uniform draws and the path-length normaliser.

Every random choice in the engine is a pure function of integer/string keys:

    u(k1, k2, ...) = int(md5("k1:k2:...")[:13 hex digits], 16) / 2**52   in [0, 1)

and where a choice needs two draws, the next 13 digits of the same digest are the second.

The same value is produced by the Spark Column form (JVM md5, whole-stage codegen),
the Python form (hashlib, used inside grouped-map tasks) and the SQL text form
(DuckDB oracle).  Keys are only ever integers or short strings, never doubles, so
text formatting cannot differ between engines.  Because draws depend on keys and
not on row order or partition layout, every stage is retry-safe: a lost executor
recomputes exactly the same sample, tree and score.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the normaliser constant as used by the method's reference formula
EULER_GAMMA = 0.5772156649

_TWO_52 = 4503599627370496.0


def u_py(*parts) -> float:
    """Python draw; parts are ints or strings.  (First 13 hex digits = first 52 bits.)"""
    key = ":".join(str(p) for p in parts).encode()
    return (int.from_bytes(hashlib.md5(key).digest()[:7], "big") >> 4) / _TWO_52


def two_u_py(*parts) -> tuple[float, float]:
    """Both draws of one digest."""
    d = hashlib.md5(":".join(str(p) for p in parts).encode()).digest()
    return (int.from_bytes(d[:7], "big") >> 4) / _TWO_52, (int.from_bytes(d[:13], "big") & ((1 << 52) - 1)) / _TWO_52


def u_col(*parts, second: bool = False) -> Column:
    """Spark Column draw; parts are Columns (integral) or python str/int literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    cols = [c.cast("string") for c in cols]
    hexpart = F.substring(F.md5(F.concat_ws(":", *cols)), 14 if second else 1, 13)
    return F.conv(hexpart, 16, 10).cast("bigint") / F.lit(_TWO_52)


def u_sql(*parts: str, second: bool = False) -> str:
    """DuckDB SQL text draw; parts are SQL expressions (integral) or quoted literals."""
    return (
        "(CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + f")), {14 if second else 1}, 13) AS BIGINT)"
        " / CAST(4503599627370496.0 AS DOUBLE))"
    )


def sql_str(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def sql_double(x: float) -> str:
    """Exact double literal for SQL text."""
    if math.isinf(x) or math.isnan(x):
        return f"CAST('{x}' AS DOUBLE)"
    return f"CAST('{float(x)!r}' AS DOUBLE)"


# ---------------------------------------------------------------- c(n)
def c_factor_py(n) -> float:
    """Average unsuccessful-search path length of a BST with n keys; 0 for n <= 1."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def c_factor(n: Column) -> Column:
    """Column form of c(n); guarded so ln is never evaluated at n <= 1."""
    nd = n.cast("double")
    safe = F.when(nd > 1, nd).otherwise(F.lit(2.0))
    val = F.lit(2.0) * (F.log(safe - F.lit(1.0)) + F.lit(EULER_GAMMA)) - F.lit(2.0) * (safe - F.lit(1.0)) / safe
    return F.when(nd > 1, val).otherwise(F.lit(0.0))


def c_factor_sql(n: str) -> str:
    return (
        f"(CASE WHEN CAST({n} AS DOUBLE) > 1 THEN 2.0 * (ln(CAST({n} AS DOUBLE) - 1.0) + {EULER_GAMMA!r})"
        f" - 2.0 * (CAST({n} AS DOUBLE) - 1.0) / CAST({n} AS DOUBLE) ELSE 0.0 END)"
    )
