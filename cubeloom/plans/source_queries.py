"""Round trips: rows of a table are written in a format and read back by its reader; the SQL is on the table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.plans import fixtures as fx
from cubeloom.plans.registry import query
from cubeloom.session import shared_dir
from cubeloom.sources import fastq, tables, text


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/format-{uuid.uuid4().hex}"


def _lines(df: DataFrame, line: Column, compression: str = "none") -> str:
    path = _folder(df.sparkSession)
    df.select(line.alias("value")).write.option("compression", compression).text(path)
    return path


def _str(name: str) -> Column:
    return F.col(name).cast("string")


def _reads(spark, d) -> DataFrame:
    return fx.seq_d(spark, d).filter("seq is not null")


@query("fasta_round_trip", f"{fx.cte('seq_l')} SELECT name, seq FROM seq_l")
def fasta_round_trip(spark, d):
    path = _folder(spark)
    text.write_fasta(fx.seq_l(spark, d), path, "gzip")
    return text.read_fasta(spark, path)


@query(
    "quality_list_round_trip",
    f"{fx.cte('seq_d')} SELECT name, array_to_string(list_transform(range(1, length(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33), ' ') AS quals FROM seq_d WHERE qual IS NOT NULL",
)
def quality_list_round_trip(spark, d):
    numbers = F.array_join(F.transform(F.split("qual", ""), lambda c: (F.ascii(c) - 33).cast("string")), " ")
    path = _lines(_reads(spark, d), F.concat(F.lit(">"), "name", F.lit("\n"), numbers), "bzip2")
    return text.read_quality_list(spark, path).select("name", F.array_join(F.col("quals").cast("array<string>"), " ").alias("quals"))


_BY_SAMPLE = f"{fx.cte('seq_d')} SELECT name, seq, qual, concat('s', CAST(doc_id % 3 AS VARCHAR)) AS samplename FROM seq_d WHERE seq IS NOT NULL"


def _fastq_round_trip(spark, d, compression: str, **options) -> DataFrame:
    path = _folder(spark)
    fastq.write_by_sample(_reads(spark, d).withColumn("samplename", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))), path, compression)
    return fastq.read_fastq(spark, path, **options).withColumn("samplename", F.regexp_extract("file", "samplename=([^/]+)/", 1))


@query("fastq_gz_round_trip", _BY_SAMPLE)
def fastq_gz_round_trip(spark, d):
    return _fastq_round_trip(spark, d, "gzip").select("name", "seq", "qual", "samplename")


@query("fastq_bz2_round_trip", _BY_SAMPLE)
def fastq_bz2_round_trip(spark, d):
    return _fastq_round_trip(spark, d, "bzip2").select("name", "seq", "qual", "samplename")


@query("fastq_ranges", f"WITH s AS ({_BY_SAMPLE}) SELECT samplename, count(*) AS n, count(*) AS n_places, CAST(sum(CAST(concat('0x', substr(md5(concat(name, seq, qual)), 1, 8)) AS BIGINT)) AS BIGINT) AS digest FROM s GROUP BY 1")
def fastq_ranges(spark, d):
    """Plain files in ranges: as many places as records, each below its file's number of records."""
    found = _fastq_round_trip(spark, d, "none", split_bytes=10_000)
    digest = F.conv(F.substring(F.md5(F.concat("name", "seq", "qual").cast("binary")), 1, 8), 16, 10).cast("long")
    files = found.groupBy("samplename", "file").agg(F.count("*").alias("n"), F.sum(digest).alias("digest"), F.countDistinct("rec_no").alias("n_places"), F.max("rec_no").alias("last"))
    places = F.when(F.col("last") + 1 == F.col("n"), F.col("n_places")).otherwise(0)
    return files.groupBy("samplename").agg(F.sum("n").alias("n"), F.sum(places).alias("n_places"), F.sum("digest").alias("digest"))


@query("fastq_in_step", f"{fx.cte('seq_d')} SELECT name, seq AS read_seq, qual AS read_qual, reverse(seq) AS index_seq, reverse(qual) AS index_qual FROM seq_d WHERE seq IS NOT NULL")
def fastq_in_step(spark, d):
    """Two sides in the same files and order."""
    dealt = _reads(spark, d).repartition(4, "name").sortWithinPartitions("name")
    record = lambda seq, qual: F.concat(F.lit("@"), "name", F.lit(" x\n"), seq, F.lit("\n+\n"), qual)
    sides = [_lines(dealt, record(F.col("seq"), F.col("qual")), "gzip"), _lines(dealt, record(F.reverse("seq"), F.reverse("qual")), "bzip2")]
    return fastq.read_in_step(spark, sides, ["read", "index"]).drop("file_no", "rec_no")


@query("fasta_with_qualities", f"{fx.cte('seq_d')} SELECT name, seq, length(qual) AS n_quals, list_sum(list_transform(range(1, length(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33))::BIGINT AS sum_quals FROM seq_d WHERE seq IS NOT NULL")
def fasta_with_qualities(spark, d):
    dealt = _reads(spark, d).repartition(4, "name").sortWithinPartitions("name")
    numbers = F.array_join(F.transform(F.split("qual", ""), lambda c: (F.ascii(c) - 33).cast("string")), " ")
    sides = [_lines(dealt, F.concat(F.lit(">"), "name", F.lit("\n"), body), "gzip") for body in (F.col("seq"), numbers)]
    found = text.read_fasta_with_qualities(spark, *sides)
    return found.select("name", "seq", F.size("quals").cast("long").alias("n_quals"), F.aggregate("quals", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_quals"))


@query("membership_round_trip", f"{fx.cte('reads_e')} SELECT otuname, readname, split_part(readname, ' SN:', 2) AS samplename FROM reads_e")
def membership_round_trip(spark, d):
    path = _folder(spark)
    text.write_membership(fx.reads_e(spark, d).withColumn("rec_no", F.lit(0)), path)
    return text.read_membership(spark, path).drop("rec_no")


@query("names_round_trip", "SELECT c_name AS name FROM customer")
def names_round_trip(spark, d):
    line = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit(";size=7;")).otherwise(""), F.when(F.col("c_custkey") % 3 == 0, F.lit("\tmore")).otherwise(""))
    return text.read_names(spark, _lines(fx.table(spark, d, "customer"), line))


@query("keys_round_trip", "SELECT concat('AB', CAST(s_suppkey AS VARCHAR)) AS acc FROM supplier")
def keys_round_trip(spark, d):
    return text.read_keys(spark, _lines(fx.table(spark, d, "supplier"), F.concat(F.lit(" AB"), _str("s_suppkey"), F.lit(".1 x"))))


@query(
    "replicates_round_trip",
    "SELECT s_name AS child, concat('n', CAST(s_nationkey AS VARCHAR)) AS parent FROM supplier UNION SELECT concat('n', CAST(s_nationkey AS VARCHAR)), concat('n', CAST(s_nationkey AS VARCHAR)) FROM supplier",
)
def replicates_round_trip(spark, d):
    rows = fx.table(spark, d, "supplier")
    return text.read_replicates(spark, _lines(rows, F.concat(F.lit("n"), _str("s_nationkey"), F.lit("\t"), "s_name", F.lit("\r")))).distinct()


@query("neighbours_round_trip", "SELECT concat('q', CAST(n_nationkey AS VARCHAR)) AS query, c_name AS acc FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey")
def neighbours_round_trip(spark, d):
    nations, customers = fx.table(spark, d, "nation"), fx.table(spark, d, "customer")
    path = _folder(spark)
    joined = nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    text.write_neighbours(joined.select(F.concat(F.lit("q"), _str("n_nationkey")).alias("query"), F.col("c_name").alias("acc")), path)
    return text.read_neighbours(spark, path)


@query("blanks_round_trip", "SELECT concat('s', CAST(c_custkey AS VARCHAR)) AS samplename, concat('b', CAST(n AS VARCHAR)) AS blank FROM customer, (VALUES (1), (2)) v(n)")
def blanks_round_trip(spark, d):
    record = F.concat(F.lit(">s"), _str("c_custkey"), F.lit("\nb1\n b2 \n"))
    found = text.read_blanks(spark, _lines(fx.table(spark, d, "customer"), record), fx.cube_e(spark, d))
    return found.select("samplename", F.trim("blank").alias("blank"))


@query("node_dump_round_trip", f"{fx.cte('nodes')} SELECT taxid, parent, rank FROM nodes")
def node_dump_round_trip(spark, d):
    root = spark.createDataFrame([(1, 1, "no rank")], "taxid long, parent long, rank string")
    nodes = fx.nodes(spark, d).select("taxid", "parent", "rank").unionByName(root)
    return tables.read_nodes(spark, _lines(nodes, F.concat(F.concat_ws("\t|\t", _str("taxid"), _str("parent"), "rank"), F.lit("\t|"))))


@query("name_dump_round_trip", f"{fx.cte('nodes')} SELECT taxid, name, 'scientific name' AS nameclass FROM nodes")
def name_dump_round_trip(spark, d):
    line = F.concat(F.concat_ws("\t|\t", _str("taxid"), "name", F.lit(""), F.lit("scientific name")), F.lit("\t|\r"))
    return tables.read_taxon_names(spark, _lines(fx.nodes(spark, d), line))


@query("accession_dump_round_trip", f"{fx.cte('acc_taxid')} SELECT acc, taxid FROM acc_taxid")
def accession_dump_round_trip(spark, d):
    rows = fx.acc_taxid(spark, d)
    versions = rows.withColumn("acc", F.concat("acc", F.lit(".2"))).unionByName(rows.withColumn("acc", F.concat(F.lit("NC_"), "acc")))
    return tables.read_accession_taxids(spark, _lines(versions, F.concat_ws("\t", "acc", _str("taxid"))))


@query("cube_column_round_trip", f"{fx.cte('cube_l')} SELECT samplename, otuname, nreads FROM cube_l WHERE nreads != 0")
def cube_column_round_trip(spark, d):
    path = _folder(spark)
    tables.write_cube(fx.cube_l(spark, d), path, compression="gzip")
    return tables.read_cube(spark, path)


@query("cube_matrix_round_trip", f"{fx.cte('cube_e')} SELECT samplename, otuname, nreads FROM cube_e")
def cube_matrix_round_trip(spark, d):
    path = _folder(spark)
    tables.write_cube(fx.cube_e(spark, d), path, "matrix")
    return tables.read_cube(spark, path)


@query("volumes_round_trip", "SELECT concat('s', CAST(c_custkey AS VARCHAR)) AS samplename, CAST(v AS DOUBLE) AS volume FROM customer, (VALUES (1), (2)) t(k), LATERAL (SELECT c_custkey * k AS v)")
def volumes_round_trip(spark, d):
    line = F.concat_ws("\t", F.concat(F.lit("s"), _str("c_custkey")), _str("c_custkey"), F.lit("no number"), (F.col("c_custkey") * 2).cast("string"))
    return tables.read_volumes(spark, _lines(fx.table(spark, d, "customer"), line))


@query("spike_ins_round_trip", "SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS samplename, concat('std', CAST(s_nationkey AS VARCHAR)) AS stdname, s_suppkey / 4 AS conc FROM supplier")
def spike_ins_round_trip(spark, d):
    line = F.concat_ws("\t", F.concat(F.lit("s"), _str("s_suppkey")), F.concat(F.lit("std"), _str("s_nationkey")), (F.col("s_suppkey") / 4).cast("string"))
    return tables.read_spike_ins(spark, _lines(fx.table(spark, d, "supplier"), line))


@query(
    "cluster_hits_round_trip",
    f"""{fx.cte('seq_d')} SELECT CASE WHEN doc_id % 2 = 0 THEN 'H' ELSE 'S' END AS kind, CAST(length(seq) AS INTEGER) AS length, CASE WHEN doc_id % 2 = 0 THEN 97.5 END::DOUBLE AS identity,
 CASE WHEN doc_id % 2 = 0 THEN '32M' ELSE '*' END AS cigar, name AS query, CASE WHEN doc_id % 2 = 0 THEN concat('t', CAST(doc_id // 2 AS VARCHAR)) END AS target FROM seq_d WHERE seq IS NOT NULL""",
)
def cluster_hits_round_trip(spark, d):
    hit = F.col("doc_id") % 2 == 0
    either = lambda a, b: F.when(hit, a).otherwise(F.lit(b))
    target = F.concat(F.lit("t"), F.floor(F.col("doc_id") / 2).cast("string"))
    line = F.concat_ws("\t", either(F.lit("H"), "S"), F.lit("0"), F.length("seq").cast("string"), either(F.lit("97.5"), "*"), F.lit("+"), F.lit("*"), F.lit("*"), either(F.lit("32M"), "*"), F.concat("name", F.lit(";size=3;")), either(target, "*"))
    return tables.read_cluster_hits(spark, _lines(_reads(spark, d), line)).toDF("kind", "length", "identity", "cigar", "query", "target")


@query("pairs_of_files", "SELECT concat('r', CAST(s_suppkey AS VARCHAR), '.forward.fastq') AS forward, CASE WHEN s_suppkey % 2 = 0 THEN concat('r', CAST(s_suppkey AS VARCHAR), '.reverse.fastq') END AS reverse FROM supplier")
def pairs_of_files(spark, d):
    rows = fx.table(spark, d, "supplier")
    name = lambda strand: F.concat(F.lit("r"), _str("s_suppkey"), F.lit(f".{strand}.fastq")).alias("file")
    return fastq.mate_pairs(rows.select(name("forward")).unionByName(rows.filter("s_suppkey % 2 = 0").select(name("reverse"))))
