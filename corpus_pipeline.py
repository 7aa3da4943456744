"""Corpus pipeline: from raw documents to the tokens of clean, unique, uncontaminated ones.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; all but the last return the columns of ``documents``.

1. ``quality``: the factorisation machine, fitted on the labelled rows; rejected documents go.
2. ``near_duplicates``: word-shingle sets (five words, similarity 0.8) joined
   by parity sketches; the smallest document of each group stays.
3. ``substring_dedup``: words of repeated windows go; ``n_chars`` follows the text.
4. ``decontamination``: documents that hold a passage of the benchmark go.
5. ``tokens``: byte-level BPE of each text, and the digest of its decoding.

Null texts are empty texts and stay what they are where nothing is removed.
Stages 2 and 4 tell documents by id and text: different texts with one id, or
with a null id, are documents of their own; of rows that repeat both, stage 2
keeps one.  Texts without words are no near duplicates and all stay.  An empty
table gives an empty table; further columns are carried to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import bpe, jaccard_join, positional_index, quality, substring_dedup
from cubeloom.llm.common import Scratch, free_name, shared_dir, table
from cubeloom.llm.queries import byte_bpe_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """*docs* with a key for every id and text, so that different texts with one id, or none, are documents of their own; and its name."""
    key = free_name(docs, "document_key")
    return docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text"))), key


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; all without words."""
    keyed, key = _keyed(docs)
    groups = jaccard_join.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), shingle=5, percent=80)
    linked = groups.filter("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct()
    placed = keyed.select("doc_id", F.col(key).alias("key")).join(linked, "key").select("key", "component_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key").alias("place"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first")).select("component_id", F.col("first.key").alias("kept_key"))
    others = placed.select("key", "component_id").distinct().join(first, "component_id").filter(F.col("key") != F.col("kept_key")).select(F.col("key").alias(key))
    # Few documents go: written first, so that Spark knows the size and needn't shuffle the texts for a small list.
    gone = Scratch(spark).write(others, "pipeline-gone")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.filter(~wordless).join(gone, key, "left_anti")
    repeated = keyed.groupBy(key).count().filter("count > 1").select(key)
    if not repeated.isEmpty():  # of rows that repeat an id and a text, the one whose further columns come first as JSON
        rest, least = free_name(keyed, "further_columns"), free_name(keyed, "least_columns")
        others = F.to_json(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text"))))
        smallest = keyed.select(key, others.alias(rest)).groupBy(key).agg(F.min(rest).alias(least))
        kept = kept.withColumn(rest, others).join(smallest, key).filter(F.col(rest) == F.col(least)).dropDuplicates([key])
    return kept.select(*_quoted(docs)).unionByName(keyed.filter(wordless).select(*_quoted(docs)))


def _quoted(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a smaller document has in a repeated window."""
    key, cut_text = free_name(docs, "text_key"), free_name(docs, "cut_text")
    found = substring_dedup.deduplicate(docs.select("doc_id", "text")).filter("n_removed > 0")
    cut = found.select("doc_id", F.col("text_key").alias(key), F.col("text").alias(cut_text)).dropDuplicates(["doc_id", key])
    joined = docs.withColumn(key, F.xxhash64("text")).join(cut, ["doc_id", key], "left")
    changed = F.col(cut_text).isNotNull()
    return joined.select(
        *(
            F.when(changed, F.col(cut_text)).otherwise(F.col("text")).alias("text")
            if c == "text"
            else F.when(changed, F.length(cut_text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        )
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed, key = _keyed(docs)
    found = positional_index.find_contamination(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = Scratch(spark).write(found.filter("n_hit > 0").select(F.col("doc_id").alias(key)).distinct(), "pipeline-hit")  # its size is known then
    return keyed.join(hit, key, "left_anti").select(*_quoted(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return bpe.round_trip_digests(docs, byte_bpe_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The classifier, the similarity join and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
