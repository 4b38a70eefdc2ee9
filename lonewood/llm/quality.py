"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms of a document are compared with a reference of its language by
Jensen-Shannon distance (square root of the divergence, base 2, so 0 to 1):

* character classes: a-z, A-Z, 0-9, white space, other ASCII, beyond ASCII;
* common words: the ``n_common`` most frequent words of the language among those of at
  most ``MAX_COMMON_CHARS`` characters, and all other words.

References are sums over the different texts of the language (``lang``; null is a language
of its own), so copies of one text have the weight of one; without ``distinct`` they are
sums over all documents.  A distance counts only for documents long enough to estimate it
(``min_chars``, ``min_words``): short texts get the benefit of the doubt.

How far a text can be from the common words depends on the language: the ceiling is the
distance of a text with none of them.  A document of n words may be as far as
``word_share`` of its language's ceiling, and ``word_margin / sqrt(n)`` more, because a few
words are far from any reference by chance alone.  So where the most common words make up
little of a language, its short texts are not judged by them at all.  A language of few
texts is its own reference; one of a single text never fails it.

Null and empty texts have no words: all counts 0, both distances null, base_failed true,
kept false.  Repeated rows are judged each for itself; columns of the input other than
the named ones are not touched and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, staged

N_COMMON = 24
MAX_COMMON_CHARS = 8
MIN_CHARS = 200
MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.29
WORD_SHARE = 0.7
WORD_MARGIN = 0.77
WINDOW = 5
SLOTS = 256  # a power of two

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def _slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _count_of(text: Column, chars: str) -> Column:
    """Occurrences of the single characters ``chars``."""
    n = F.lit(0).cast("long")
    for c in chars:
        n = n + _length(text) - _length(F.replace(text, F.lit(c), F.lit("")))
    return n


def characters(text: Column) -> Column:
    """Struct of ``classes`` (counts of a-z, A-Z, 0-9, white space, other ASCII, beyond
    ASCII) and ``symbols``.  Each step looks only at what the earlier ones have left."""
    def step(rest: Column, what: str, then) -> Column:
        return let(F.regexp_replace(rest, what, ""), lambda left: then(left, _length(rest) - _length(left)))

    return let(text, lambda t: step(t, "[a-z]+", lambda a, lower: step(a, "[ \\t-\\r]+", lambda b, space: step(
        b, "[^\\x00-\\x7F]+", lambda c, beyond: step(c, "[A-Z]+", lambda d, upper: step(d, "[0-9]+", lambda e, digit: F.struct(
            F.array(lower, upper, digit, space, _length(e), beyond).alias("classes"), _count_of(e, SYMBOLS).alias("symbols"))))))))


def repeated_words(w: Column) -> Column:
    """Words that lie in a ``WINDOW``-word window found at least twice in the array ``w``."""
    def joint(a: Column, b: Column, k: int) -> Column:
        """Hashes of ``a[i]`` and ``b[i + k]``, for every i; those beyond the end mean nothing."""
        return F.zip_with(a, F.slice(b, k + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))

    def windows(h: Column, k: int) -> Column:
        """Hashes of ``k`` words from each on: of two halves, and the last word of an odd number."""
        if k == 1:
            return h
        even = let(windows(h, k // 2), lambda x: joint(x, x, k // 2))
        return joint(even, h, k - 1) if k % 2 else even

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.slice(windows(h, WINDOW), 1, F.size(w) - WINDOW + 1))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.when(j > 0, F.get(s, j - 1)["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(pairs, lambda s: let(positions(s), covered)))

    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null if one is all 0."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def share(a: Column) -> Column:
        return let(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2.0 * x / (x + y))).otherwise(0.0 * x)

    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, y) + part(y, x)) / 2)
    return let(total(terms), lambda d: F.sqrt(F.when(d < 0, 0.0).otherwise(d)))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", n_common: int = N_COMMON, distinct: bool = True) -> DataFrame:
    """One row per language: ``ref_lang``, ``ref_classes`` (summed character classes),
    ``ref_words`` (most frequent words, ties by the word), ``ref_counts`` (their counts and
    that of all other words) and ``ref_ceiling`` (the distance of a text without them).
    ``distinct``: equal texts of a language count once."""
    d = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("ref_lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    by_text = d.select("ref_lang", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"), characters(F.col("t"))["classes"].alias("c"))
    if distinct:
        # grouping keys only: every task drops its copies before the exchange.  The classes need
        # no text there, and of long words the counts need no more than that they are there.
        long_words = r"[^\x20\x09-\x0D]{%d,}" % (MAX_COMMON_CHARS + 1)
        by_text = by_text.distinct()
        d = d.select("ref_lang", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"),
                     F.regexp_replace("t", long_words, "0" * (MAX_COMMON_CHARS + 1)).alias("t")).distinct()
    classes = by_text.groupBy("ref_lang").agg(
        F.array(*[F.sum(F.col("c")[i]).cast("double") for i in range(6)]).alias("ref_classes"))
    counts = d.select("ref_lang", F.explode(F.split("t", SPACE)).alias("w")).where("w != ''").groupBy(
        "ref_lang", F.when(F.length("w") <= MAX_COMMON_CHARS, F.col("w")).alias("w")).agg(F.count("*").alias("n"))
    counts = staged(counts, "quality")  # read twice below
    # row_number() <= n becomes a group limit: each task keeps n words a language before the
    # exchange, so a hot language sends n rows from each task
    ranked = counts.where("w is not null").withColumn("r", F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= n_common)
    top = ranked.groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    every = counts.groupBy("ref_lang").agg(F.sum("n").alias("all"))
    words = top.join(every, "ref_lang").select("ref_lang", F.col("top.w").alias("ref_words"), F.concat(
        F.transform("top.n", lambda x: x.cast("double")),
        F.array(F.col("all") - F.aggregate("top.n", F.lit(0).cast("long"), lambda a, x: a + x)).cast("array<double>")).alias("ref_counts"))
    without = F.transform("ref_counts", lambda x, i: F.when(i == F.size("ref_words"), 1.0).otherwise(0.0))
    return classes.join(words.withColumn("ref_ceiling", js_distance(without, F.col("ref_counts"))), "ref_lang", "left")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", references: DataFrame | None = None,
                  n_common: int = N_COMMON, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
                  max_class_distance: float = MAX_CLASS_DISTANCE, word_share: float = WORD_SHARE, word_margin: float = WORD_MARGIN,
                  distinct: bool = True) -> DataFrame:
    """``docs`` with one more column ``quality``: a struct of n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept.
    ``distinct``: copies of a text count once in the references.  Given ``references`` have
    the columns of ``language_references``; documents of a language that they lack have null
    distances and are judged by the base rules alone."""
    refs = staged(references if references is not None else language_references(docs, text, lang, n_common, distinct), "quality")
    # a word is compared with the common words of its own slot, a few at most
    refs = refs.withColumn("ref_slots", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter("ref_words", lambda x: _slot(x) == i)))
    own = list(docs.columns)
    t = F.coalesce(F.col("__d")[text], F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__d")).join(
        refs, F.coalesce(F.col("__d")[lang], F.lit("")) == F.col("ref_lang"), "left")

    def histogram(w: Column) -> Column:
        """Counts of the language's common words in ``w``, then of all other words."""
        listed = let(F.filter(w, lambda x: F.array_contains(F.get(F.col("ref_slots"), _slot(x)), x)), lambda hits: F.transform(
            F.col("ref_words"), lambda r: (F.size(hits) - F.size(F.array_remove(hits, r))).cast("double")))
        return let(listed, lambda c: F.concat(c, F.array(F.size(w) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
                        histogram(w).alias("histogram"))

    def verdict(m: Column) -> Column:
        """From the measures of a document to its struct."""
        n, r = m["words"]["n_words"], m["words"]["n_repeat_words"]
        near = F.struct(
            F.when(m["n"] >= min_chars, js_distance(m["characters"]["classes"].cast("array<double>"), F.col("ref_classes"))).alias("classes"),
            F.when(n >= min_words, js_distance(m["words"]["histogram"], F.col("ref_counts"))).alias("words"))
        failed = (n < 10) | (100 * r > 20 * n)
        far = word_share * F.col("ref_ceiling") + word_margin / F.sqrt(n)
        return let(near, lambda d: F.struct(
            n.alias("n_words"), (m["n"] - m["characters"]["classes"][3]).alias("word_chars"), m["characters"]["symbols"].alias("n_symbols"),
            m["repeated_lines"].alias("n_dup_lines"), r.alias("n_repeat_words"), failed.alias("base_failed"),
            d["classes"].alias("class_distance"), d["words"].alias("word_distance"),
            (~failed & F.coalesce(d["classes"] <= max_class_distance, F.lit(True)) & F.coalesce(d["words"] <= far, F.lit(True))).alias("kept")))

    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    measures = F.struct(let(words_of(t), by_words).alias("words"), characters(t).alias("characters"), _length(t).alias("n"),
                        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("repeated_lines"))
    # one expression from text to struct: a filter on a field, which the optimizer moves below
    # the projection, copies it once and not once for every field
    return d.select(*[F.col("__d")[c].alias(c) for c in own], let(measures, verdict).alias("quality"))
