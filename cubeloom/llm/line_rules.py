"""Quality rules on lines and words: cross-document line frequency within a host.

Everything is DataFrame work; no Python runs on the executors.

A document's *host* is its ``source``.  Lines are normalised (lower case, one
space for white space, no space at the ends) and hashed.  For every host the
distinct documents that have a line are counted (``distinct_texts``: exact copies
count once); a line above the limits (``min_docs`` documents and ``max_share``
of the host's documents) is removed, and a document is rejected if the
removed lines hold more than ``max_removed`` of its words.

Base figures come from the text alone, by array functions within its row: no
rows are made per word.

Scale: the texts are read once; figures and line hashes are written, and all
else works on them.  Copies of a text in a host become one row with their number
(a partial aggregation), which gives one row per distinct line; a common line meets
in the partial count of ``(host, line)``.  The lines above the limits are at most
``lines per document / max_share`` a host; all joins are between written tables
without a hint, so Spark broadcasts by measured size and splits a skewed key otherwise.

Defined cases: a null text has no words (all figures 0, ``base_failed``); a
null source is a host of its own; ids may be null or repeat (one row each);
an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch

_SPACES = r"[\x20\x09-\x0D]+"
_A_WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def base_figures(df: DataFrame) -> DataFrame:
    """*df* (with a ``text`` that isn't null) with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    words = F.col("__words")
    n = F.size(words)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_A_WORD))
    step = df.withColumn("__words", words_of(F.col("text"))).withColumn("__lines", lines)
    step = step.withColumn(
        "__windows",
        F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    )
    # Only texts with a repeated window pay for the sort: equal windows are then neighbours.
    repeated = F.size("__windows") > F.size(F.array_distinct("__windows"))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__placed", F.when(repeated, placed))
    at = F.col("__placed")
    twice = F.filter(at, lambda x, k: (x["h"] == F.get(at, k - 1)["h"]) | (x["h"] == F.get(at, k + 1)["h"]))
    step = step.withColumn("__starts", F.when(at.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    starts = F.col("__starts")
    covered = F.aggregate(
        F.transform(starts, lambda p, k: F.least(F.coalesce(F.get(starts, k + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return step.select(
        *df.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_hashes(text: Column) -> Column:
    """The lines of a text that have a word: hash of the normalised line, and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_A_WORD))
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), _SPACES, " "))
    return F.transform(lines, lambda x: F.struct(F.unhex(F.md5(normal(x).cast("binary"))).alias("line_key"), F.size(words_of(x)).cast("long").alias("words")))


def removed_words(texts: DataFrame, min_docs: int, max_share: float, distinct_texts: bool) -> DataFrame:
    """Words in lines above the limits by ``host, digest``, of ``host, digest, copies, lines``; texts without such lines have no row."""
    lines = texts.select("host", "digest", "copies", F.explode("lines").alias("line")).select("host", "digest", "copies", "line.*")
    found = lines.groupBy("host", "digest", "line_key").agg(F.sum("words").alias("words"), F.max("copies").alias("copies"))
    number = F.count("*") if distinct_texts else F.sum("copies")
    sizes = texts.groupBy("host").agg(number.alias("host_docs"))
    counted = found.groupBy("host", "line_key").agg(number.alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    common = counted.join(sizes, "host").filter(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line_key")
    return found.join(common, ["host", "line_key"], "left_semi").groupBy("host", "digest").agg(F.sum("words").alias("removed_words"))


def apply_rules(documents: DataFrame, min_docs: int = 20, max_share: float = 0.05, max_removed: float = 0.5, distinct_texts: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, the base figures, ``base_failed``, ``removed_words`` and ``kept``."""
    scratch = Scratch(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        line_hashes(text).alias("lines"),
        text.alias("text"),
    )
    figures = scratch.write(base_figures(docs).drop("text"), "lines-figures")
    texts = scratch.write(figures.groupBy("host", "digest").agg(F.count("*").alias("copies"), F.first("lines").alias("lines")), "lines-texts")
    removed = scratch.write(removed_words(texts, min_docs, max_share, distinct_texts), "lines-removed")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.coalesce(F.col("removed_words"), F.lit(0)) > max_removed * F.col("n_words")
    judged = figures.drop("lines").join(removed, ["host", "digest"], "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        (~failed & ~depleted).alias("kept"),
    )
    return scratch.finish(judged, "lines")
