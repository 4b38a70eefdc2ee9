"""Model bundles: ``{path}/nodes``, ``{path}/meta``, ``{path}/data``, ``{path}/scores``
as Parquet in a shared folder.  ``save_model`` and ``save_bundle`` write a new version under
the path (``versions``), so a reader never meets half a bundle.  Nothing passes through the driver except the model's
own node table when it is packed for scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import ForestModel, fit, load_model
from ..session import new_path
from . import versions
from .ranks import Ranks, load_ranks, save_ranks


@dataclass
class Bundle:
    model: ForestModel
    data: DataFrame
    scores: DataFrame
    path: str
    ranks: Ranks | None = None


def save_model(model: ForestModel, path: str) -> ForestModel:
    """Write the node and meta tables as a new version of ``path`` and return the model
    re-read.  Until the version is committed readers have the old one."""
    _write(model, versions.new_folder(path), path)
    return load_model(model.spark, path)


def _write(model: ForestModel, folder: str, path: str, ranks: DataFrame | None = None, **tables: DataFrame) -> None:
    if ranks is not None:
        save_ranks(ranks, f"{folder}/ranks")
    model.nodes.write.parquet(f"{folder}/nodes")
    model.meta_df().write.parquet(f"{folder}/meta")
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    versions.commit(model.spark, path, folder)


def save_bundle(model: ForestModel, data: DataFrame, scores: DataFrame, path: str, ranks: bool = False) -> Bundle:
    """Model + training data + their scores as one new version of ``path``; with ``ranks``
    the scores' rank directory too, so that new points find their places without the scores."""
    _write(model, versions.new_folder(path), path, ranks=scores if ranks else None, data=data, scores=scores)
    return load_bundle(model.spark, path)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    path = versions.resolve(spark, path)
    model = load_model(spark, path)
    ranks = load_ranks(spark, f"{path}/ranks") if versions.exists(spark, f"{path}/ranks/directory") else None
    return Bundle(model, spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/scores"), path, ranks)


def fit_score_save(df: DataFrame, path: str | None = None, combine: str = "forest", id_col: str = "id",
                   **fit_args) -> Bundle:
    """Train, score the training rows with the *saved* model, persist everything.

    The data is written first, so training and scoring read the same snapshot and the
    scores always come from the trees that were saved.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "bundles")
    df.write.mode("overwrite").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    model = fit(data, id_col=id_col, path=path, **fit_args)
    scores = model.score(data, combine=combine, id_col=id_col)
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    return load_bundle(spark, path)


def score_points(bundle: Bundle, points: DataFrame, combine: str = "forest", id_col: str = "id") -> DataFrame:
    """Score new rows (a parsed literal, an uploaded table) with a saved model."""
    return bundle.model.score(points, combine=combine, id_col=id_col)


def score_literals(bundle: Bundle, df: DataFrame, col: str, combine: str = "forest", id_col: str = "id") -> DataFrame:
    """The rows of ``df`` (id, point literal in ``col``) as points, scored by the saved
    model: id, the parsed values, path_mean, score.  A literal that is no point of the
    model's dimension is an error."""
    from .readers import point_columns

    spec = bundle.model.spec
    if spec.array_col:
        values = point_columns(F.col(col), [f"v{i}" for i in range(spec.dim)])
        pts = df.select(id_col, F.array(*values).alias(spec.array_col))
    else:
        pts = df.select(id_col, *point_columns(F.col(col), spec.columns))
    return bundle.model.score(pts, combine=combine, id_col=id_col)


def score_literal(bundle: Bundle, text: str, combine: str = "forest") -> DataFrame:
    """R10 for one point given as text, e.g. ``"(3.3, 3.3)"`` (id 0), with its place among the
    training scores: the number and share of them that are not above its own."""
    lit = bundle.model.spark.createDataFrame([(0, text)], "id bigint, s string")
    one = score_literals(bundle, lit, "s", combine)
    if bundle.ranks:
        return one.join(F.broadcast(bundle.ranks.place(one).select("id", "n_train_le", "frac_train_le")), "id")
    train = bundle.scores.select(F.col("score").alias("_t"))
    # one new score: a count with a broadcast of one row, not a sort of the training scores
    place = train.join(F.broadcast(one.select(F.col("score").alias("_s"))), F.col("_t") <= F.col("_s"), "left_semi").agg(F.count("*").alias("n_train_le"))
    total = bundle.scores.agg(F.count("*").alias("_n"))
    return one.join(F.broadcast(place)).join(F.broadcast(total)).withColumn("frac_train_le", F.col("n_train_le") / F.greatest("_n", F.lit(1))).drop("_n")


__all__ = ["Bundle", "save_model", "save_bundle", "load_bundle", "fit_score_save", "score_points", "score_literal", "score_literals"]
