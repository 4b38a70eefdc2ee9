"""Forests that follow a stream: each micro-batch gives a new version of the model.

A version holds the samples of all trees, with their keys, and the trees grown from them.
Samples merge (``operators.sketch``): the samples of the rows so far and of the new batch
give those of all rows, so a batch costs its own scan and a shuffle of the samples, and no
earlier row is read again.  The last version equals a fit over all rows at once.

``foreachBatch`` may run a batch again after a failure.  A version's manifest entry names its
batch, so a batch that has its version is skipped: every row counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.forest import ForestModel, default_limit, grow_samples, load_model, prepare, sample_partitions
from ..operators.sketch import bottom_samples, level_for, level_of, merged
from ..session import new_path, ship_package
from ..sources import versions


@dataclass(frozen=True)
class Refit:
    """What a model that is kept up to date is made of."""

    path: str
    features: tuple = ()
    feature_col: str | None = None
    id_col: str = "id"
    n_trees: int = 100
    psi: int = 256
    limit: int | None = None
    seed: int = 0
    na: str = "drop"
    dim: int | None = None

    def update(self, batch: DataFrame, batch_id: int | None = None) -> dict:
        """Adds the rows of ``batch`` and commits a new version; returns its manifest entry.
        With fewer than psi rows so far a version has samples (all rows), but no trees.  A
        batch without rows, and one that has its version already, changes nothing."""
        spark = batch.sparkSession
        ship_package(spark)
        last = versions.latest(spark, self.path)
        if last and batch_id is not None and last["batch"] is not None and batch_id <= last["batch"]:
            return last
        spec, points = prepare(batch, list(self.features) or None, self.feature_col, self.id_col, self.na, self.dim)
        n = points.count()
        if last and not n:
            return last
        known, level = None, level_for(n, self.psi)
        if last:
            known = spark.read.parquet(f"{self.path}/{last['folder']}/samples")
            # keys above the worst one kept cannot come in
            level = level_of(last["worst"]) if last["rows"] >= self.psi else 0
        total = (last["rows"] if last else 0) + n
        parts = sample_partitions(spark, self.n_trees, self.psi, spec.d)
        while True:
            folder = versions.new_folder(self.path)
            new = bottom_samples(points, self.n_trees, self.psi, self.seed, level, parts)
            sample = merged([known, new], self.psi, parts) if known is not None else new
            sample.write.parquet(f"{folder}/samples")
            sample = spark.read.parquet(f"{folder}/samples")
            per_tree = sample.groupBy("_tree").agg(F.count("*").alias("n"), F.max("_key").alias("worst"))
            found = per_tree.agg(F.count("*").alias("trees"), F.min("n").alias("least"), F.max("worst").alias("worst")).first()
            if total == 0 or (found["trees"] == self.n_trees and found["least"] == min(total, self.psi)):
                break
            if level == 0:
                raise ValueError("an id occurs more than once")
            level -= 1
        if total >= self.psi:
            limit = default_limit(self.psi) if self.limit is None else int(self.limit)
            nodes = grow_samples(sample, spec.d, limit, self.seed, self.n_trees, parts)
            nodes.write.parquet(f"{folder}/nodes")
            model = ForestModel(spark, folder, spark.read.parquet(f"{folder}/nodes"), spec, 1, self.n_trees, self.psi, limit, self.seed, "all", 0.0, {0: total})
            model.meta_df().write.parquet(f"{folder}/meta")
        return versions.commit(spark, self.path, folder, after=last["version"] if last else 0, batch=batch_id, rows=total, worst=found["worst"], trees=total >= self.psi)

    def model(self, spark: SparkSession) -> ForestModel:
        """The last version's forest."""
        last = versions.latest(spark, self.path)
        if not last or not last["trees"]:
            raise ValueError(f"fewer than psi={self.psi} rows have come so far")
        return load_model(spark, self.path)


def refit_stream(stream: DataFrame, refit: Refit, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Updates ``refit`` with every micro-batch of ``stream``."""
    if not stream.isStreaming:
        raise ValueError("refit_stream expects a streaming DataFrame (spark.readStream...)")
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(lambda batch, number: refit.update(batch, number) and None)
    writer = writer.option("checkpointLocation", checkpoint or new_path(spark, "stream-checkpoints"))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
