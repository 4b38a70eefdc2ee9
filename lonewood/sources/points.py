"""Point tables: turning user DataFrames into the engine's canonical frame.

Canonical frame columns: ``_id bigint`` (unique), then ``_x0 .. _x{d-1} double``.
Features come either from a list of numeric columns or from one array column
(e.g. ``embedding array<float>``), which is expanded to ``d`` double columns so every
downstream stage (Arrow batches, numpy matrices, SQL oracle lists) sees the same shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class FeatureSpec:
    """How features are read from a user table; stored in the model meta."""

    columns: list[str] = field(default_factory=list)  # numeric columns, or
    array_col: str | None = None  # one array column ...
    dim: int = 0  # ... of this length

    @property
    def d(self) -> int:
        return self.dim if self.array_col else len(self.columns)

    def names(self) -> list[str]:
        if self.array_col:
            return [f"{self.array_col}[{i}]" for i in range(self.dim)]
        return list(self.columns)

    def exprs(self) -> list[Column]:
        if self.array_col:
            arr = F.col(self.array_col)
            n_ok = F.size(arr) == F.lit(self.dim)
            # a ragged or NULL array yields NULL features, handled by the NA policy; the
            # element is cast, not the array (casting the array per feature costs d x)
            return [F.when(n_ok, arr[i].cast("double")).alias(f"_x{i}") for i in range(self.dim)]
        return [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.columns)]

    def valid_expr(self) -> Column:
        """True when every feature of the row is present and not NaN (on the raw columns,
        so one array predicate instead of d per-element tests)."""
        if self.array_col:
            arr = F.col(self.array_col)
            return (F.size(arr) == F.lit(self.dim)) & ~F.exists(arr, lambda v: v.isNull() | F.isnan(v))
        cond = F.lit(True)
        for c in self.columns:
            v = F.col(c).cast("double")
            cond = cond & v.isNotNull() & ~F.isnan(v)
        return cond

    def to_meta(self) -> dict:
        return {"columns": self.columns, "array_col": self.array_col, "dim": self.dim}

    @staticmethod
    def from_meta(m: dict) -> "FeatureSpec":
        return FeatureSpec(list(m.get("columns") or []), m.get("array_col"), int(m.get("dim") or 0))


def resolve_features(df: DataFrame, features=None, feature_col: str | None = None, dim: int | None = None) -> FeatureSpec:
    """Validate the feature declaration against ``df``'s schema."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    if feature_col is not None:
        dt = schema.get(feature_col)
        if not isinstance(dt, T.ArrayType) or not isinstance(dt.elementType, NUMERIC):
            raise TypeError(f"{feature_col!r} must be an array of numbers, got {dt}")
        if dim is None:
            # one tiny action: the length of the first non-null array
            row = df.where(F.col(feature_col).isNotNull()).select(F.size(feature_col).alias("n")).first()
            if row is None:
                raise ValueError(f"{feature_col!r} has no non-null values")
            dim = int(row["n"])
        if dim < 1:
            raise ValueError("feature dimension must be >= 1")
        return FeatureSpec([], feature_col, int(dim))
    if not features:
        raise ValueError("declare features=[...] or feature_col=...")
    for c in features:
        if c not in schema:
            raise KeyError(f"feature column {c!r} not in {sorted(schema)}")
        if not isinstance(schema[c], NUMERIC):
            raise TypeError(f"feature column {c!r} must be numeric, got {schema[c]}")
    return FeatureSpec(list(features), None, 0)


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def read_parquet_wallclock(spark, path: str) -> DataFrame:
    """Read Parquet with its naive (not UTC-adjusted) timestamps as TIMESTAMP_NTZ.

    Spark maps such columns to TIMESTAMP_NTZ by default, but a session with
    ``spark.sql.parquet.inferTimestampNTZ.enabled=false`` reads them as instants in the
    session time zone, which shifts derived features (day of year, hour).  An explicit
    read schema keeps the file's wall-clock meaning whatever the session says."""
    df = spark.read.parquet(path)
    if not any(isinstance(f.dataType, T.TimestampType) for f in df.schema.fields):
        return df
    fixed = T.StructType([T.StructField(f.name, T.TimestampNTZType(), f.nullable)
                          if isinstance(f.dataType, T.TimestampType) else f for f in df.schema.fields])
    return spark.read.schema(fixed).parquet(path)


def canonical(df: DataFrame, spec: FeatureSpec, id_col: str, keep: list[str] | None = None) -> DataFrame:
    """Project ``df`` to ``_id, [keep...], _x0.._x{d-1}`` (column pruning reaches the scan)."""
    dt = {f.name: f.dataType for f in df.schema.fields}.get(id_col)
    if dt is None:
        raise KeyError(f"id column {id_col!r} not in {df.columns}")
    if not isinstance(dt, INTEGRAL):
        raise TypeError(f"id column {id_col!r} must be an integer type, got {dt}; a table without one can "
                        "use lonewood.operators.ordering.global_row_index to derive it")
    extra = [F.col(c) for c in (keep or [])]
    return df.select(F.col(id_col).cast("bigint").alias("_id"), *extra, *spec.exprs())


def apply_na(df: DataFrame, spec: FeatureSpec, na: str, id_col: str) -> DataFrame:
    """NA policy on the raw table (before projection, so the predicates reach the scan).  Rows
    without an id cannot be drawn: they are dropped, or an error under 'fail'."""
    has_id = F.col(id_col).isNotNull()
    if na == "drop":
        return df.where(has_id & spec.valid_expr())
    if na == "keep":
        return df.where(has_id)
    if na == "fail":
        bad = F.when(~spec.valid_expr(), F.raise_error(F.lit("NULL or NaN feature in training data"))).when(
            ~has_id, F.raise_error(F.lit("NULL id in training data")))
        return df.where(bad.isNull())
    raise ValueError("na must be 'drop', 'fail' or 'keep'")
