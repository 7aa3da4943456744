"""Reference sets of sequences: volumes, a k-mer index, fetching by accession.

A set is a table ``name, seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators.clusters import kmers
from cubeloom.operators.filters import accession_forms, without_listed
from cubeloom.session import with_running


def volumes(sequences: DataFrame, letters: int = 10_000_000_000, min_length: int = 0, max_length: int | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """``volume, name, seq``: sequences within the limits, none of them in *negatives*, in volumes of about *letters* by order of names.

    A sequence belongs to the volume in which it begins.
    """
    kept = sequences.filter(F.length("seq") >= min_length)
    if max_length is not None:
        kept = kept.filter(F.length("seq") <= max_length)
    if negatives is not None:
        kept = without_listed(kept, negatives)
    running = with_running(kept, [F.col("name"), F.col("seq")], F.length("seq").cast("long"), "end")
    volume = F.floor((F.col("end") - F.length("seq")) / F.lit(letters)).cast("long")
    return running.select(volume.alias("volume"), "name", "seq")


def kmer_index(sequences: DataFrame, k: int, buckets: int = 64) -> DataFrame:
    """``bucket, kmer, name``: each sequence under its distinct k-mers, dealt into *buckets* by k-mer (to be written by bucket)."""
    listed = sequences.select("name", F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    return listed.select(F.pmod(F.crc32(F.col("kmer").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"), "kmer", "name")


def fetched(sequences: DataFrame, accessions: DataFrame, min_length: int = 0) -> DataFrame:
    """Sequences that the first column of *accessions* names in one of their forms, long enough."""
    listed = accessions.select(F.col(accessions.columns[0]).alias("form")).distinct()
    hit = sequences.select("name", F.explode(accession_forms(F.col("name"))).alias("form")).join(listed, "form", "left_semi").select("name").distinct()
    return sequences.join(hit, "name", "left_semi").filter(F.length("seq") >= min_length)


def accessions_with_taxa(sequences: DataFrame, acc_taxid: DataFrame) -> DataFrame:
    """``acc, taxid`` of the sequences' accessions that have a node."""
    forms = sequences.select(F.explode(accession_forms(F.col("name"))).alias("acc")).distinct()
    return acc_taxid.join(forms, "acc", "left_semi").select("acc", "taxid")
