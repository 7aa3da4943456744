"""Readers and writers on small files."""

from __future__ import annotations

import gzip
import hashlib
import lzma

import pytest
from pyspark.errors import PySparkException

from cubeloom.operators.cube import dense
from cubeloom.sources import fastq, submission, tables, text
from cubeloom.streaming import append
from tests.conftest import rows_of


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b">a;size=3;\r\nac gt\r\nAC\r\n>b c \nNN\n>empty\n")
    found = rows_of(text.read_fasta(spark, str(tmp_path / "a.fasta")))
    assert found == [("a", "ACGTAC"), ("b c", "NN"), ("empty", "")]
    text.write_fasta(text.read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"), "gzip")
    assert rows_of(text.read_fasta(spark, str(tmp_path / "out"))) == found


def test_quality_list(spark, tmp_path):
    (tmp_path / "q").write_text(">a\n10 20\n30\n>b\n5\n")
    quals = text.read_quality_list(spark, str(tmp_path / "q"))
    assert rows_of(quals) == [("a", (10, 20, 30)), ("b", (5,))]
    with pytest.raises(PySparkException):
        text.with_qualities(spark.createDataFrame([("c", "A")], "name string, seq string"), quals).collect()


def test_membership(spark, tmp_path):
    (tmp_path / "m.otu").write_text(">o1\nr1 SN:x__a__p\nr2 SN:x__b__p\n>o2;size=1;\nr3 SN:x__a__p\n")
    found = text.read_membership(spark, str(tmp_path / "m.otu"), one_run=True)
    assert [(r.otuname, r.samplename, r.rec_no) for r in found.orderBy("readname").collect()] == [("o1", "x__a__p", 0), ("o1", "x__b__p", 1), ("o2", "x__a__p", 0)]
    text.write_membership(found, str(tmp_path / "again"))
    assert rows_of(text.read_membership(spark, str(tmp_path / "again"))) == rows_of(found)


def test_lists(spark, tmp_path):
    (tmp_path / "n").write_text("a;size=2;\tx\nb\n\n")
    assert rows_of(text.read_names(spark, str(tmp_path / "n"))) == [("a",), ("b",)]
    (tmp_path / "k").write_text(" gi|AB_1.2\nXY9\n--\n")
    assert rows_of(text.read_keys(spark, str(tmp_path / "k"))) == [("XY9",), ("gi",)]
    (tmp_path / "r").write_text("p\tc1\tc2\nq\n")
    assert rows_of(text.read_replicates(spark, str(tmp_path / "r"))) == [("c1", "p"), ("c2", "p"), ("p", "p"), ("q", "q")]
    (tmp_path / "h").write_text(">q1;base62=Ab;\nx\ny\n>q2\n")
    assert rows_of(text.read_neighbours(spark, str(tmp_path / "h"))) == [("x", "q1"), ("y", "q1"), (None, "q2")]


@pytest.mark.parametrize("kind", ["", ".gz", ".xz"])
def test_fastq(spark, tmp_path, kind):
    data = b"@r1 x\nacgt\n+\nIIII\n@r2\nAC\n+r2\n!I\n"
    path = tmp_path / f"a.fastq{kind}"
    path.write_bytes({"": bytes, ".gz": gzip.compress, ".xz": lzma.compress}[kind](data))
    found = fastq.read_fastq(spark, str(path), chunk=1).drop("file")
    assert rows_of(found) == [("r1 x", "IIII", 0, "ACGT"), ("r2", "!I", 1, "AC")]


def test_fastq_errors_and_steps(spark, tmp_path):
    (tmp_path / "bad.fastq").write_text("@r1\nACGT\n+\nIII\n")
    with pytest.raises(PySparkException):
        fastq.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()
    one = spark.createDataFrame([("f", 0, "r 1", "A", "I"), ("f", 1, "s 1", "C", "I")], "file string, rec_no long, name string, seq string, qual string")
    assert fastq.in_step([one, one], ["read", "index"]).select("rec_no", "read_seq", "index_seq").count() == 2
    with pytest.raises(PySparkException):
        fastq.in_step([one, one.filter("rec_no = 0")], ["read", "index"]).collect()


def test_pairs_and_imports(spark):
    files = spark.createDataFrame([("a.forward.fq",), ("a.reverse.fq",), ("b_R1_x",), ("b_R2_x",), ("c.fq",)], "file string")
    assert rows_of(fastq.mate_pairs(files)) == [("a.forward.fq", "a.reverse.fq"), ("b_R1_x", "b_R2_x"), ("c.fq", None)]
    with pytest.raises(ValueError):
        fastq.import_named(spark.createDataFrame([], "file string, rec_no long, name string, seq string, qual string"), spark.createDataFrame([("a", "s"), ("b", "s")], "file string, samplename string"))


def test_cube_layouts(spark, tmp_path):
    (tmp_path / "long.tsv").write_text("samplename\totuname\tnreads\ns1\ta\t2\ns1\ta\t3\ns2\tb\t1\n")
    found = tables.read_cube(spark, str(tmp_path / "long.tsv"))
    assert rows_of(found) == [(1, "b", "s2"), (5, "a", "s1")]
    (tmp_path / "wide.tsv").write_text("samplename\ta\tb\ns1\t2\t0\ns1\t3\t0\ns2\t0\t1\n")
    assert rows_of(tables.read_cube(spark, str(tmp_path / "wide.tsv"))) == rows_of(found)
    for layout in ("column", "matrix"):
        tables.write_cube(found.coalesce(1), str(tmp_path / layout), layout)
        assert rows_of(tables.read_cube(spark, str(tmp_path / layout))) == rows_of(found)
    assert dense(found).count() == 4
    assert tables.item_label(spark.createDataFrame([("s", "ACGT", 1)], found.schema)) == "sequence"
    (tmp_path / "short.tsv").write_text("samplename\ta\tb\ns1\t2\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.read_cube(spark, str(tmp_path / "short.tsv")).collect()


def test_assignment_and_taxonomy(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("query\tdomain\tGenus\nq1\tB\t\nq2\t\tg\n")
    assert rows_of(tables.read_assignment(spark, str(tmp_path / "t.tsv"))) == [("q1", 1, "B"), ("q2", 23, "g")]
    (tmp_path / "u.tsv").write_text("query\tcolour\nq1\tB\n")
    with pytest.raises(ValueError):
        tables.read_assignment(spark, str(tmp_path / "u.tsv"))
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tdomain\t|\n")
    assert rows_of(tables.read_nodes(spark, str(tmp_path / "nodes"))) == [(1, "superkingdom", 2)]
    (tmp_path / "names").write_text("2\t|\tBacteria\t|\t\t|\tscientific name\t|\n")
    assert rows_of(tables.read_taxon_names(spark, str(tmp_path / "names"))) == [("Bacteria", "scientific name", 2)]
    (tmp_path / "acc").write_text("accession taxid\nAB1.2 5\nNC_1.1 6\n")
    assert rows_of(tables.read_accession_taxids(spark, str(tmp_path / "acc"))) == [("AB1", 5)]


def test_calibration_tables(spark, tmp_path):
    (tmp_path / "m").write_text("samplename\tx\ty\ns\t1\t2.5\n")
    assert rows_of(tables.read_spike_ins(spark, str(tmp_path / "m"))) == [(1.0, "s", "x"), (2.5, "s", "y")]
    (tmp_path / "p").write_text("x\t4\ns\ty\t5\n")
    assert rows_of(tables.read_spike_ins(spark, str(tmp_path / "p"))) == [(4.0, None, "x"), (5.0, "s", "y")]
    (tmp_path / "v").write_text("s\t1\tx\t2.5\n")
    assert rows_of(tables.read_volumes(spark, str(tmp_path / "v"))) == [("s", 1.0), ("s", 2.5)]


def test_submission(spark, tmp_path):
    data = b"@r\nACGT\n+\nIIII\n@s\nAC\n+\nII\n"
    for strand in ("forward", "reverse"):
        (tmp_path / f"x.{strand}.fastq").write_bytes(data)
    row = fastq.submission_table(spark, str(tmp_path / "*.fastq")).first()
    assert (row.prefix, row.file1, row.file2, row.mean_length) == ("x", "x.forward.fastq", "x.reverse.fastq", 3)
    assert row.md5_1 == hashlib.md5(data).hexdigest()
    sheet = spark.createDataFrame([("a<b", "t", "l", "f1", "m1")], "sample string, title string, library string, file1 string, md5_1 string")
    made = submission.documents(sheet, "S")
    assert 'refname="a&lt;b"' in made["experiment"] and submission.layout_of(24) == "PAIRED"


def test_cache_stream(spark, tmp_path):
    path, source = str(tmp_path / "cache"), str(tmp_path / "in")
    for rows in ([("k", "x"), ("k", "y")], [("k", "x"), ("l", "z")]):
        spark.createDataFrame(rows, "key string, acc string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, acc string").parquet(source)
        append.upsert_cache(spark, stream, path, str(tmp_path / "cp")).awaitTermination()
    assert rows_of(append.latest(spark, path)) == [("x", "k"), ("z", "l")]
