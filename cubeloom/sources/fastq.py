"""FASTQ files: one to four files in step, mates, imports, submission tables.

Files are streamed by the source of :mod:`cubeloom.sources.records`: compressed
ones as a whole, plain ones in ranges that are numbered by a count of their records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.session import shared_dir
from cubeloom.sources import records as source


def read_fastq(spark: SparkSession, path: str | list[str], chunk: int = 10_000, split_bytes: int = source.SPLIT_BYTES) -> DataFrame:
    """``file, rec_no, name, seq, qual``; a malformed record is an error.  gz, bz2 and xz by extension.

    Only plain files of more than *split_bytes* are read twice: their ranges are counted first,
    one number per task, so that records have the places that they have in the file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    long = [f for f, size in source.listed(paths) if size > split_bytes and not source.compressed(f)]
    options = {"splitBytes": split_bytes, "batchRecords": chunk}
    if long:
        options["counts"] = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
        source.load(spark, "count", long, splitBytes=split_bytes).write.parquet(options["counts"])
    return source.load(spark, "fastq", paths, **options)


def read_in_step(spark: SparkSession, sides: list[str | list[str]], labels: list[str], chunk: int = 10_000) -> DataFrame:
    """``file_no, rec_no, name`` and ``<label>_seq, <label>_qual`` of the files of each side, read side by side.

    A side's files go in the order of their names.  One task reads one file of each side, so nothing is
    shuffled; sides of unequal numbers of files or records are an error.
    """
    files = [[f for f, _ in source.listed(side)] for side in sides]
    if len({len(f) for f in files}) > 1:
        raise ValueError(f"sides of {[len(f) for f in files]} files")
    return source.load(spark, "fastq", files, labels, batchRecords=chunk)


def in_step(files: list[DataFrame], labels: list[str]) -> DataFrame:
    """One row per record of files read in step: ``file_no, rec_no, name`` and ``<label>_seq, <label>_qual`` of each.

    The files of a side are taken in the order of their names: the third of one side goes with the third of the others.
    """
    out = None
    for label, records in zip(labels, files):
        order = records.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")))  # a run's list of files
        part = records.join(order, "file").select("file_no", "rec_no", F.regexp_extract("name", r"^(\S+)", 1).alias("name"), F.col("seq").alias(f"{label}_seq"), F.col("qual").alias(f"{label}_qual"))
        out = part if out is None else out.join(part.drop("name"), ["file_no", "rec_no"], "full")
    missing = [F.col(f"{label}_seq").isNull() for label in labels]
    gap = missing[0]
    for m in missing[1:]:
        gap = gap | m
    return out.withColumn("name", F.when(gap, F.raise_error(F.concat(F.lit("files aren't in step at record "), F.col("rec_no").cast("string")))).otherwise(F.col("name")))


def mate_pairs(files: DataFrame) -> DataFrame:
    """``forward, reverse``: files (``file``) paired by names that differ in ``.forward.``/``.reverse.`` or ``_R1_``/``_R2_`` only; null: none."""
    key = F.regexp_replace("file", r"\.(forward|reverse)\.|_R[12]_", "*")
    second = F.col("file").rlike(r"\.reverse\.|_R2_")
    return files.groupBy(key.alias("key")).agg(F.min(F.when(~second, F.col("file"))).alias("forward"), F.min(F.when(second, F.col("file"))).alias("reverse")).drop("key")


def sample_files(files: DataFrame) -> DataFrame:
    """:func:`mate_pairs` of a run's files without those of undetermined reads and incomplete UMIs; pairs beside single files are an error."""
    pairs = mate_pairs(files.filter(~F.col("file").rlike("__(undetermined|incompleteUMI)")))
    kinds = pairs.agg(F.count_if(F.col("reverse").isNull()).alias("single"), F.count("reverse").alias("paired")).first()
    if kinds["single"] and kinds["paired"]:
        raise ValueError(f"{kinds['paired']} pairs beside {kinds['single']} single files")
    return pairs


def import_named(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records of the files in ``file, samplename``, the sample being added to their names; a sample or file named twice is an error."""
    sizes = mapping.agg(F.count("*").alias("n"), F.countDistinct("file").alias("f"), F.countDistinct("samplename").alias("s")).first()
    if not sizes["n"] == sizes["f"] == sizes["s"]:
        raise ValueError("a file or sample is named twice")
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    joined = records.withColumn("__base", base).join(mapping.select(F.col("file").alias("__base"), "samplename"), "__base")
    return joined.select("rec_no", F.concat("name", F.lit(" SN:"), "samplename").alias("name"), "seq", "qual", "samplename")


def write_by_sample(reads: DataFrame, path: str, compression: str = "gzip", mode: str = "append") -> None:
    """FASTQ files by sample (and strand, if given): one folder each."""
    text = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    keys = [c for c in ("samplename", "strand") if c in reads.columns]
    reads.select(*keys, text.alias("value")).write.mode(mode).partitionBy(*keys).option("compression", compression).text(path)


def file_sums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, md5`` of the files as they are, read as streams."""
    files = spark.createDataFrame([(f,) for f, _ in source.listed(path)], "file string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["file"]:
                with source.opened(name, raw=True) as stream:
                    digest = hashlib.md5()
                    while data := stream.read(1 << 20):
                        digest.update(data)
                yield pd.DataFrame({"file": [name], "md5": [digest.hexdigest()]})

    return files.repartition(max(1, min(files.count(), 1000)), "file").mapInPandas(run, "file string, md5 string")


def submission_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``prefix, file1, md5_1, file2, md5_2, mean_length`` of the files of each sample, one or two."""
    lengths = read_fastq(spark, path).groupBy("file").agg(F.sum(F.length("seq")).alias("bases"), F.count("*").alias("reads"))
    named = file_sums(spark, path).join(lengths, "file", "left").withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1))
    named = named.withColumn("prefix", F.regexp_replace("name", r"(\.(forward|reverse))?\.fastq.*$|_R[12]_.*$", ""))
    grouped = named.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("name", "md5"))).alias("files"), F.floor(F.sum("bases") / F.sum("reads") + 0.5).alias("mean_length"))
    at = lambda i, c: F.get("files", F.lit(i))[c]
    return grouped.select("prefix", at(0, "name").alias("file1"), at(0, "md5").alias("md5_1"), at(1, "name").alias("file2"), at(1, "md5").alias("md5_2"), "mean_length")
