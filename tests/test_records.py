"""The streaming source: ranges, sides in step, compressed files, errors."""

from __future__ import annotations

import bz2
import gzip
import lzma
import random

import pytest
from pyspark.errors import PySparkException

from cubeloom.sources import fastq, records, text
from tests.conftest import rows_of

_PACKED = {"": bytes, ".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress}


def _made(n: int, seed: int, end: str = "\n") -> tuple[bytes, list[tuple]]:
    """A file with qualities that begin with ``@`` and ``+``, empty reads and blank lines, and its records."""
    rng = random.Random(seed)
    rows, out = [], []
    for k in range(n):
        length = rng.choice([0, 1, 7, 40])
        seq = "".join(rng.choice("ACGTN") for _ in range(length))
        qual = "".join(rng.choice("@+!I") for _ in range(length))
        out.append(f"@r{k} x{end}{seq.lower()}{end}+{end}{qual}{end}" + (end if rng.random() < 0.2 else ""))
        rows.append((f"r{k} x", seq, qual))
    return "".join(out).encode(), rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_range_gives_each_record_once(tmp_path, end):
    data, rows = _made(60, 1, end)
    path = tmp_path / "a.fastq"
    path.write_bytes(data)
    for size in [*range(1, 90, 4), 1000, len(data) + 1]:
        found = [r for s in range(0, len(data), size) for r in records.fastq_records(str(path), s, s + size if s + size < len(data) else None)]
        assert found == rows, size


def test_numbers_of_split_files(spark, tmp_path):
    expected = []
    for i in range(3):
        data, rows = _made(200, i)
        (tmp_path / f"{i}.fastq{'.bz2' if i == 2 else ''}").write_bytes(bz2.compress(data) if i == 2 else data)
        expected += [(str(i), k, *r) for k, r in enumerate(rows)]
    found = fastq.read_fastq(spark, str(tmp_path), chunk=7, split_bytes=300)
    assert found.rdd.getNumPartitions() > 10
    rows = sorted((r.file.rpartition("/")[2][0], r.rec_no, r.name, r.seq, r.qual) for r in found.collect())
    assert rows == sorted(expected)


@pytest.mark.parametrize("kind", sorted(_PACKED))
def test_sides_in_step(spark, tmp_path, kind):
    data, rows = _made(50, 3)
    other, others = _made(50, 4)
    for name, content in (("a_R1_", data), ("a_R2_", other), ("b_R1_", other), ("b_R2_", data)):
        (tmp_path / f"{name}.fastq{kind}").write_bytes(_PACKED[kind](content))
    found = fastq.read_in_step(spark, [f"{tmp_path}/*_R1_*", f"{tmp_path}/*_R2_*"], ["read", "index"], chunk=9)
    expected = [(n, k, f"r{k}", *a[1:], *b[1:]) for n, (x, y) in enumerate([(rows, others), (others, rows)], 1) for k, (a, b) in enumerate(zip(x, y))]
    assert sorted(map(tuple, found.collect())) == expected
    by_join = fastq.in_step([fastq.read_fastq(spark, f"{tmp_path}/*_R{i}_*") for i in (1, 2)], ["read", "index"])
    assert rows_of(found.withColumn("file_no", found.file_no.cast("int"))) == rows_of(by_join)


def test_a_side_that_ends_early_is_an_error(spark, tmp_path):
    for name, n in (("a", 5), ("b", 4)):
        (tmp_path / name).write_bytes(_made(n, 1)[0])
    with pytest.raises(PySparkException, match="in step at record 4"):
        fastq.read_in_step(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], ["x", "y"]).collect()
    with pytest.raises(ValueError):
        fastq.read_in_step(spark, [str(tmp_path), f"{tmp_path}/b"], ["x", "y"])


@pytest.mark.parametrize("kind", sorted(_PACKED))
def test_sequences_with_quality_lists(spark, tmp_path, kind):
    pack = _PACKED[kind]
    (tmp_path / f"s.fasta{kind}").write_bytes(pack(b">a x\nac gt\nN\n>b\n\n>c\nA\n"))
    (tmp_path / f"s.qual{kind}").write_bytes(pack(b">a x\n10 20\n 30\n>b\n>c\n5\n"))
    found = text.read_fasta_with_qualities(spark, f"{tmp_path}/s.fasta{kind}", f"{tmp_path}/s.qual{kind}")
    assert [tuple(r)[1:] for r in found.orderBy("rec_no").collect()] == [(0, "a x", "ACGTN", [10, 20, 30]), (1, "b", "", []), (2, "c", "A", [5])]
    assert rows_of(text.read_fasta(spark, f"{tmp_path}/s.fasta{kind}")) == [("a x", "ACGTN"), ("b", ""), ("c", "A")]
    assert rows_of(text.read_quality_list(spark, f"{tmp_path}/s.qual{kind}").filter("name != 'b'")) == [("a x", (10, 20, 30)), ("c", (5,))]


def test_names_that_differ_are_an_error(spark, tmp_path):
    (tmp_path / "s").write_text(">a\nA\n>b\nC\n")
    (tmp_path / "q").write_text(">b\n1\n>a\n2\n")
    with pytest.raises(PySparkException, match="differ in names at record 0"):
        text.read_fasta_with_qualities(spark, f"{tmp_path}/s", f"{tmp_path}/q").collect()


def test_empty_files_and_hidden_ones(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("")
    (tmp_path / "_b.fastq").write_text("no record")
    (tmp_path / "c.fastq.gz").write_bytes(gzip.compress(b""))
    assert fastq.read_fastq(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        fastq.read_fastq(spark, f"{tmp_path}/none")


def test_members_of_a_compressed_file_are_one_stream(spark, tmp_path):
    one, two = _made(5, 1), _made(6, 2)
    (tmp_path / "a.fastq.gz").write_bytes(gzip.compress(one[0]) + gzip.compress(two[0]))
    assert [tuple(r) for r in fastq.read_fastq(spark, f"{tmp_path}/a.fastq.gz").orderBy("rec_no").select("name", "seq", "qual").collect()] == one[1] + two[1]
