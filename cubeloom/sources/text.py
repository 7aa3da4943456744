"""Record-separated text formats: FASTA, quality lists, memberships, name lists, neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions.names import sample_of_read, without_size
from cubeloom.functions.sequences import clean
from cubeloom.sources import records as source


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, head, body`` of files whose records begin with ``>``; compressed files are read by their extension.

    Spark reads what its codecs know; where a path names xz files all its files are streamed by tasks of their own.
    """
    if any(p.endswith(".xz") for p in ([path] if isinstance(path, str) else path)):
        return source.load(spark, "fasta", [path] if isinstance(path, str) else list(path)).select("file", F.col("name").alias("head"), "body").filter("head != '' or body != ''")
    raw = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    text = F.regexp_replace("value", r"^>|\n$", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.contains(text, F.lit("\n")), F.expr("substring(regexp_replace(value, '^>|\\n$', ''), instr(regexp_replace(value, '^>|\\n$', ''), '\\n') + 1)")).otherwise("")
    return raw.select("file", head.alias("head"), body.alias("body")).filter("trim(head) != '' or body != ''")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, seq``: names without size marks, sequences as upper-case letters."""
    return _records(spark, path).select(F.rtrim(without_size(F.trim("head"))).alias("name"), clean(F.col("body")).alias("seq"))


def write_fasta(sequences: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    text = F.concat(F.lit(">"), "name", F.lit("\n"), "seq")
    sequences.select(text.alias("value")).write.mode(mode).option("compression", compression or "none").text(path)


def read_quality_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, quals``: the numbers of a FASTA-like quality file."""
    numbers = F.transform(F.filter(F.split("body", r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return _records(spark, path).select(F.trim("head").alias("name"), numbers.alias("quals"))


def with_qualities(sequences: DataFrame, quals: DataFrame) -> DataFrame:
    """Sequences with their quality lists by name; one without is an error at run time."""
    joined = sequences.join(quals, "name", "left")
    return joined.withColumn("quals", F.when(F.col("quals").isNull(), F.raise_error(F.concat(F.lit("no qualities of "), "name"))).otherwise(F.col("quals")))


def read_fasta_with_qualities(spark: SparkSession, fasta: str | list[str], qual: str | list[str]) -> DataFrame:
    """``file_no, rec_no, name, seq, quals``: sequence files with their quality lists, by position.

    A pair of files is read side by side by one task; a name that differs or a file that ends early is an error.
    """
    sides = [[f for f, _ in source.listed(side)] for side in (fasta, qual)]
    if len(sides[0]) != len(sides[1]):
        raise ValueError(f"{len(sides[0])} files of sequences, {len(sides[1])} of qualities")
    return source.load(spark, "fasta_qual", sides)


def _lines(body: Column) -> Column:
    return F.explode(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""))


def read_membership(spark: SparkSession, path: str | list[str], one_run: bool = False) -> DataFrame:
    """``otuname, readname, samplename, rec_no``: members of clusters; their sample is in the read name.

    With *one_run* several run names are an error.
    """
    lines = _records(spark, path).select(without_size(F.trim("head")).alias("otuname"), F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("rec_no", "readname"))
    out = lines.select("otuname", F.trim("readname").alias("readname"), sample_of_read(F.col("readname")).alias("samplename"), F.col("rec_no").cast("long").alias("rec_no"))
    if one_run:
        runs = out.select(F.substring_index("samplename", "__", 1).alias("run")).distinct().limit(2).count()
        if runs > 1:
            raise ValueError("members of several runs")
    return out


def write_membership(members: DataFrame, path: str) -> None:
    """Clusters with their members, one record per cluster; meant for sets whose clusters fit a value."""
    record = members.groupBy("otuname").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rec_no", "readname"))), lambda x: x["readname"]), "\n").alias("body"))
    record.select(F.concat(F.lit(">"), "otuname", F.lit("\n"), "body").alias("value")).write.text(path)


def read_names(spark: SparkSession, path: str | list[str], headers_only: bool = False) -> DataFrame:
    """``name``: one per line without size marks and anything after a tab; of a FASTA file its headers."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    if headers_only:
        return lines.filter(F.startswith("line", F.lit(">"))).select(F.trim(F.expr("substring(line, 2)")).alias("name"))
    return lines.select(F.regexp_replace(without_size(F.col("line")), "\t.*$", "").alias("name")).filter("name != ''")


def read_keys(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``acc``: the first run of letters, digits and underscores of each line."""
    return spark.read.text(path).select(F.regexp_extract("value", r"([A-Za-z0-9_]+)", 1).alias("acc")).filter("acc != ''")


def read_replicates(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``child, parent``: every column of a line, the first too, is a child of the first."""
    cells = F.filter(F.split(F.regexp_replace("value", "\r$", ""), "\t"), lambda x: x != "")
    return spark.read.text(path).select(cells.alias("cells")).filter("size(cells) > 0").select(F.explode("cells").alias("child"), F.get("cells", F.lit(0)).alias("parent"))


def read_neighbours(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``query, acc``: neighbour lists; a query without any has a null accession."""
    name = F.regexp_replace(F.trim("head"), r";(size|base62)=[^;]*;?", "")
    found = _records(spark, path).select(name.alias("query"), F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "").alias("accs"))
    return found.select("query", F.explode_outer("accs").alias("acc"))


def write_neighbours(neighbours: DataFrame, path: str) -> None:
    record = neighbours.groupBy("query").agg(F.array_join(F.sort_array(F.collect_list("acc")), "\n").alias("body"))
    record.select(F.concat(F.lit(">"), "query", F.lit("\n"), "body").alias("value")).write.text(path)


def read_blanks(spark: SparkSession, path: str | list[str], cube: DataFrame) -> DataFrame:
    """``samplename, blank``: a record names a sample and its blanks; blanks without a sample hold for all others."""
    from cubeloom.operators.decontam import links_to_all

    lines = spark.read.text(path).limit(1).collect()
    if lines and not lines[0][0].startswith(">"):
        names = read_names(spark, path).withColumnRenamed("name", "samplename")
        return links_to_all(cube, names)
    return _records(spark, path).select(F.trim("head").alias("samplename"), _lines(F.col("body")).alias("blank"))
