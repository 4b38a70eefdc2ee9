"""Readers for the inputs the method is fed with: headerless numeric CSV, free text
with leading numeric fields, and "(x, y, ...)" point literals.

All parsing is JVM-side (``split``/``try_cast``): a bad cell becomes NULL instead of
failing the job (ANSI mode is on by default in Spark 4), and the NA policy of ``fit``
decides what happens to such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_points_csv(spark: SparkSession, path: str, n_features: int | None = None,
                    names: list[str] | None = None, id_col: str = "id", strict: bool = False) -> DataFrame:
    """Headerless, comma-separated numeric file -> ``id`` + double columns.

    Unparsable cells (a header line, text) become NULL, missing cells too, surplus cells are
    left out; with ``strict`` any such row is an error when it is read.  Rows carry no
    key in the file, so ``id`` is the row's place (from 0) in the file, or in all files
    in the order of their paths: see ``with_positions``.
    """
    if names is None:
        if n_features is None:
            raise ValueError("give names= or n_features=")
        names = [f"x{i}" for i in range(n_features)]
    schema = T.StructType([T.StructField(n, T.DoubleType(), True) for n in names])
    df = spark.read.schema(schema).option("header", "false").option("mode", "FAILFAST" if strict else "PERMISSIVE").option(
        "enforceSchema", "true").csv(path)
    return with_positions(df, id_col).select(id_col, *names)


def with_positions(scan: DataFrame, id_col: str) -> DataFrame:
    """The rows of a file scan with their place among all rows, by file path and then by place
    in the file, whatever the split size, the cluster or the order of tasks.

    Rows of a split come in order in one task, so a row's place is its number in the split plus
    the rows of the splits before.  A first pass over the files counts those without parsing
    columns; its table has a row a split and is joined.  Should the splits of the two passes
    differ (executors came or went between them), the read fails rather than give wrong ids."""
    where = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_mid"))
    splits = where.groupBy("_file", "_from").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    up_to_split = Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    up_to_file = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.select("_file", F.coalesce(F.sum("_rows").over(up_to_file), F.lit(0)).alias("_files_before"))
    splits = splits.withColumn("_splits_before", F.coalesce(F.sum("_n").over(up_to_split), F.lit(0))).join(files, "_file")
    local = F.col("_mid") - F.col("_first")
    place = F.when((local >= 0) & (local < F.col("_n")), F.col("_files_before") + F.col("_splits_before") + local).otherwise(
        F.raise_error("the splits of the files changed while they were read").cast("bigint"))
    return where.join(splits, ["_file", "_from"], "left").select(place.alias(id_col), *[F.col(f"`{c}`") for c in scan.columns])


def parse_text_points(lines: DataFrame, value_col: str = "value", n_fields: int = 2,
                      names: list[str] | None = None) -> DataFrame:
    """Text lines -> the first ``n_fields`` comma-separated fields as doubles.

    Trailing newlines / carriage returns are stripped, empty lines dropped; a field that
    does not parse is NULL.
    """
    names = names or ["x", "y"][:n_fields] + [f"x{i}" for i in range(2, n_fields)]
    line = F.regexp_replace(F.col(value_col), r"[\r\n]+$", "")
    parts = F.split(line, ",")
    cols = [F.expr(f"try_cast(trim(try_element_at(_parts, {i + 1})) AS DOUBLE)").alias(n) for i, n in enumerate(names)]
    return lines.withColumn("_line", line).where(F.length("_line") > 0).withColumn("_parts", parts).select(
        *[c for c in lines.columns if c != value_col], *cols)


def read_text_points(spark: SparkSession, path: str, n_fields: int = 2) -> DataFrame:
    return parse_text_points(spark.read.text(path), "value", n_fields)


def parse_point_literal(col) -> Column:
    """S3: "(x, y, ...)" -> array<double>; any run of brackets/blanks at either end is
    stripped, blanks around numbers are allowed, a bad element is NULL."""
    c = col if isinstance(col, Column) else F.col(col)
    inner = F.regexp_replace(F.trim(c), r"^[()\s]+|[()\s]+$", "")
    return F.transform(F.split(inner, ","), lambda v: F.trim(v).try_cast("double"))


def point_columns(col, names: list[str]) -> list[Column]:
    """The columns ``names`` from a point literal; a literal with another number of values, or
    a value that is no number, is an error."""
    text = col if isinstance(col, Column) else F.col(col)
    arr = parse_point_literal(text)
    bad = (F.size(arr) != len(names)) | F.exists(arr, lambda v: v.isNull()) | arr.isNull()
    message = F.concat(F.lit(f"not a point of {len(names)} numbers: "), F.coalesce(text, F.lit("NULL")))
    checked = F.when(bad, F.raise_error(message).cast("array<double>")).otherwise(arr)
    return [F.get(checked, i).alias(n) for i, n in enumerate(names)]


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Numeric columns -> one array<double> column (the N x d matrix row)."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in features]))
