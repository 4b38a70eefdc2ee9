"""Training-data pipeline over ``documents``: five stages, each one operator of
``lonewood.llm`` with its production parameters.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that stay, with the columns of ``docs`` (the last one returns the packed pieces).
``run`` applies them to the table, writing each stage's result as Parquet under
``spark.checkpoint.dir`` and reading it again for the next one.

Null and empty texts have no words, so the first stage rejects them.  Repeated rows are
near-duplicates of each other: one stays, and of rows of one least id any one.  Very long
texts pass like others, held whole by one task at a time.  Other columns may have any name
and pass unchanged, but n_chars, which follows the text.  An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonewood.llm.catalog import tokenizer
from lonewood.llm.common import staged, table
from lonewood.llm.packing import pack_documents
from lonewood.llm.postings import decontaminate
from lonewood.llm.quality import quality_rules
from lonewood.llm.simhash import simhash_groups
from lonewood.llm.suffixes import remove_repeats


def carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole rows of ``docs`` as one column ``row``, beside the named columns: what a stage
    adds can't clash with a column of the table."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def rows_of(stage: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, those in ``changed`` with new values."""
    return stage.select(*[(changed[c] if c in changed else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Copies of a text, which only the next stage removes, count once
    in the references they are judged by."""
    return rows_of(quality_rules(carried(docs, "text", "lang"), distinct=True).where("quality.kept"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays."""
    return rows_of(simhash_groups(carried(docs, "doc_id", "text"), keep=["row"]).where("simhash.first"), docs)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")  # the text goes once
    return rows_of(remove_repeats(docs.select(row, "doc_id", "text")), docs, text=F.col("text"), n_chars=F.length("text"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    found = decontaminate(carried(docs, "text"), table(spark, sf_dir, "benchmark"), keep=["row"])
    return rows_of(found.where("not leak.contaminated"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' tokens with their places in the training sequences."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"), keep=["doc_id"])


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passages_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
