"""Registered queries of this subpackage: one per operator, with production parameters, over
its whole table.  Their SQL twins are in ``catalog_sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_sql import ORACLE as ORACLE
from .chat import chat_turns
from .common import let, table
from .fim import fill_in_middle, restored
from .html import extract_text
from .minhash import minhash_groups
from .packing import pack_documents
from .periodic import periodic_runs
from .postings import decontaminate
from .quality import quality_rules
from .simhash import simhash_groups
from .suffixes import remove_repeats
from .tokenfile import read_tokens, write_tokens
from .toxicity import THRESHOLD, held_out, toxicity, train
from .warc import read_warc, write_warc


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "quality.*")
    return d.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_groups(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("doc_id", "simhash.fingerprint", "simhash.component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "dedup.*")


def op2_postings_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return d.select("doc_id", *[f"leak.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep=["doc_id"])


def op8_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op1_chat_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chat_turns(table(spark, sf_dir, "conversations"))
    return t.select(F.col("conv").cast("long").alias("conv_id"), "turn", "piece", "role", "n_lines", F.length("rendered").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op3_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"))).drop("url")


def op9_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    return d.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"),
                    F.size("toxicity.offending").alias("n_offending"))


def with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """The contract's texts: in a tenth of the documents the words from a place on repeat."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", with_periodic_tail(F.col("text"), F.col("doc_id")).alias("text"))
    r = periodic_runs(d, keep=["doc_id"]).select("doc_id", "periodic.*")
    top = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return (r.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = minhash_groups(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("doc_id", "minhash.n_shingles", "minhash.component_id", (F.col("doc_id") == F.col("minhash.component_id")).alias("kept"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "fim.*")
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {
    "op11_periodic_runs": op11_periodic_runs,
    "op12_minhash_components": op12_minhash_components,
    "op13_fill_in_middle": op13_fill_in_middle,
    "op1_chat_viterbi": op1_chat_viterbi,
    "op9_noisy_or_toxicity": op9_noisy_or_toxicity,
    "op3_template_removal": op3_template_removal,
    "op5_warc_roundtrip": op5_warc_roundtrip,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op8_seekable_tokens": op8_seekable_tokens,
    "op2_postings_decontamination": op2_postings_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op6_simhash_pivots": op6_simhash_pivots,
    "op7_quality_divergence": op7_quality_divergence,
}
