"""Tab-separated tables: cubes, assignments, taxonomy dumps, hits, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.operators.cube import from_matrix, item_names, summed, to_matrix
from cubeloom.operators.hierarchy import without_root
from cubeloom.schemas import CLUSTER_HITS, CUBE, HITS, RANK_INDEX


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The cells of the first line of a table."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].rstrip("\r").split("\t") if first else []


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """A cube from a column table or a matrix, told apart by the header; equal keys are summed."""
    header = header_of(spark, path)
    lower = [h.lower() for h in header]
    options = {"sep": "\t", "header": True, "mode": "FAILFAST"}
    if len(lower) == 3 and lower[0] == "samplename" and lower[2] == "nreads":
        return summed(spark.read.schema(CUBE).options(**options, enforceSchema=True).csv(path))
    if not lower or lower[0] != "samplename":
        raise ValueError(f"{path}: neither a column table nor a matrix of counts")
    schema = ", ".join(["samplename string", *(f"`{h}` long" for h in header[1:])])
    return from_matrix(spark.read.schema(schema).options(**options).csv(path))


def write_cube(cube: DataFrame, path: str, layout: str = "column", zeros: bool = False, compression: str | None = None, mode: str = "errorifexists") -> None:
    """A cube as a column table (without zero cells unless *zeros*) or as a matrix."""
    if layout not in ("column", "matrix"):
        raise ValueError("layout must be column or matrix")
    if layout == "matrix":
        out = to_matrix(cube, item_names(cube)).orderBy("samplename")
    else:
        out = (cube if zeros else cube.filter("nreads != 0")).orderBy("samplename", F.desc("nreads"), "otuname")
    out.write.mode(mode).options(sep="\t", header=True, compression=compression or "none").csv(path)


def item_label(cube: DataFrame) -> str:
    """What a column table calls its items: ``sequence``, ``base62sequence`` or ``otuname``, by their spelling."""
    row = cube.agg(F.bool_and(F.col("otuname").rlike("^[ACGT]+$")).alias("plain"), F.bool_and(F.col("otuname").rlike("^[A-Za-z0-9]{34,}$")).alias("packed")).first()
    return "sequence" if row["plain"] else "base62sequence" if row["packed"] else "otuname"


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """``query, rank_idx, taxon`` of an assignment table; unknown ranks are an error, blanks are left out."""
    header = [h.lower() for h in header_of(spark, path)]
    unknown = [h for h in header[1:] if h not in RANK_INDEX]
    if not header or header[0] != "query" or unknown:
        raise ValueError(f"{path}: not an assignment table: {unknown or header[:1]}")
    schema = ", ".join(["query string", *(f"`{RANK_INDEX[h]}` string" for h in header[1:])])
    wide = spark.read.schema(schema).csv(path, sep="\t", header=True, mode="FAILFAST")
    long = wide.unpivot("query", [f"`{RANK_INDEX[h]}`" for h in header[1:]], "rank_idx", "taxon")
    return long.filter("taxon is not null and taxon != ''").select("query", F.col("rank_idx").cast("int").alias("rank_idx"), "taxon")


def _dump(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    cells = F.split(F.regexp_replace("value", r"\t\|\r?$", ""), r"\t\|\t", -1)
    return spark.read.text(path).select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``taxid, parent, rank`` of a node dump, without the root."""
    raw = _dump(spark, path, ["taxid", "parent", "rank"])
    return without_root(raw.select(F.col("taxid").cast("long").alias("taxid"), F.col("parent").cast("long").alias("parent"), "rank"))


def read_taxon_names(spark: SparkSession, path: str) -> DataFrame:
    """``taxid, name, nameclass`` of a name dump."""
    raw = _dump(spark, path, ["taxid", "name", "unique_name", "nameclass"])
    return raw.select(F.col("taxid").cast("long").alias("taxid"), "name", "nameclass")


def read_accession_taxids(spark: SparkSession, path: str, drop_refseq: bool = True) -> DataFrame:
    """``acc, taxid``: the first two fields of each line, accessions without their version."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.regexp_replace(F.get(cells, F.lit(0)), r"\.\d+$", "").alias("acc"), F.try_to_number(F.get(cells, F.lit(1)), F.lit("999999999999")).cast("long").alias("taxid"))
    rows = rows.filter("taxid is not null").distinct()
    return rows.filter(~F.contains("acc", F.lit("_"))) if drop_refseq else rows


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HITS).csv(path, sep="\t")


def read_cluster_hits(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a cluster hit table: type, length, identity, CIGAR, query and target."""
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"c{i} string" for i in range(10)))
    size = lambda c: F.regexp_replace(c, r";size=\d+;?", "")
    out = raw.select("c0", F.try_to_number("c2", F.lit("999999999")).cast("int"), F.expr("try_cast(c3 as double)"), "c7", size("c8"), F.nullif(size("c9"), F.lit("*")))
    return out.toDF(*CLUSTER_HITS.names)


def read_spike_ins(spark: SparkSession, path: str) -> DataFrame:
    """``samplename, stdname, conc``: a matrix with a header, or rows of two or three cells; a cell that is no number is an error."""
    header = header_of(spark, path)
    lines = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c")).filter("size(c) > 1")
    number = lambda x: x.cast("double")
    if header and header[0].lower() == "samplename":
        rows = lines.filter(F.lower(F.get("c", F.lit(0))) != "samplename")
        cells = F.explode(F.arrays_zip(F.array(*map(F.lit, header[1:])).alias("stdname"), F.slice("c", 2, len(header) - 1).alias("conc")))
        return rows.select(F.get("c", F.lit(0)).alias("samplename"), cells.alias("x")).select("samplename", "x.stdname", number(F.col("x.conc")).alias("conc"))
    three = F.size("c") >= 3
    at = lambda i: F.get("c", F.lit(i))
    return lines.select(F.when(three, at(0)).alias("samplename"), F.when(three, at(1)).otherwise(at(0)).alias("stdname"), number(F.when(three, at(2)).otherwise(at(1))).alias("conc"))


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """``samplename, volume``: a row per number after a sample's name; cells that are no numbers are passed over."""
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(path).select(F.get(cells, F.lit(0)).alias("samplename"), F.explode(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))).alias("v"))
    return rows.select("samplename", F.expr("try_cast(v as double)").alias("volume")).filter("volume is not null")
