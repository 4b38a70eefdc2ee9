"""Scoring streams with a saved model.

Scoring is stateless and row-local (``mapInArrow`` over each micro-batch with the
broadcast model), so a streaming DataFrame goes through exactly the same plan as a
batch one: no state store, no watermark, append output mode.  A file-stream replay
with ``trigger(availableNow=True)`` therefore produces the batch scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.forest import ForestModel
from ..session import new_path, partitions_for


def score_stream(model: ForestModel, stream: DataFrame, combine: str = "forest", id_col: str | None = None,
                 group_col: str | None = None) -> DataFrame:
    """Streaming DataFrame with ``path_mean`` and ``score`` appended to every row."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame (spark.readStream...)")
    return model.score(stream, combine=combine, group_col=group_col, id_col=id_col)


def write_scores(scored: DataFrame, path: str, checkpoint: str | None = None,
                 available_now: bool = True, query_name: str | None = None) -> StreamingQuery:
    """Append the scored stream to Parquet files; the checkpoint lives in the shared folder."""
    spark = scored.sparkSession
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or new_path(spark, "stream-checkpoints")))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(path)


def replay_as_stream(spark: SparkSession, df: DataFrame, n_files: int | None = None, max_files_per_trigger: int = 1) -> DataFrame:
    """Write ``df`` as Parquet files (``n_files``, by default as many as its size asks for) and
    open them as a file stream (tests, back-fills): ``max_files_per_trigger`` files become
    one micro-batch."""
    src = new_path(spark, "stream-sources")
    df.repartition(n_files or partitions_for(df)).write.parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(src)
