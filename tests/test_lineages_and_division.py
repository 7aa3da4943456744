"""Lineages under append, accessions, sequences divided at a query, primers and depths in plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cubeloom.operators import demux, lineages, quantify
from tests.conftest import rows_of


def _lines(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "lineage string")


def _nodes(df):
    return {r.path: (r.taxid, r.parent, r.rank, r.name) for r in df.collect()}


def test_append_keeps_ids(spark):
    first = lineages.appended(_lines(spark, "order:A;genus:B", "order:A", None, "", "TXID=9;genus:\"B\""))
    assert _nodes(first) == {"order:A": (2, 1, "order", "A"), "order:A;genus:B": (3, 2, "genus", "B"), "taxid:9;genus:B": (4, 9, "genus", "B")}
    second = lineages.appended(_lines(spark, "order:A;family:C; genus=D;", "order:A;genus:B"), first)
    assert _nodes(second) == _nodes(first) | {"order:A;family:C": (5, 2, "family", "C"), "order:A;family:C;genus:D": (6, 5, "genus", "D")}
    assert rows_of(lineages.appended(_lines(spark, "order:A"), second)) == rows_of(second)
    assert min(r[0] for r in _nodes(lineages.appended(_lines(spark, "order:A"), floor=500)).values()) == 501


def test_positional_ranks_and_errors(spark):
    made = lineages.appended(_lines(spark, "taxid:7|A||B", "A"), ranks=["order", "family", "genus"], separator="|")
    assert _nodes(made) == {"order:A": (2, 1, "order", "A"), "taxid:7;order:A": (3, 7, "order", "A"), "taxid:7;order:A;genus:B": (4, 3, "genus", "B")}
    for bad in ("colour:red", "order", "order:A;x"):
        with pytest.raises(PySparkException, match="not an entry"):
            lineages.appended(_lines(spark, bad)).collect()


def test_accessions(spark):
    def expected(n):
        if n < 10**8:
            return f"AA{n:08d}"
        block, place = divmod(n, 99_999_999)
        return chr(65 + block // 26) + chr(65 + block % 26) + f"{place:08d}"

    numbers = [1, 99_999_999, 10**8, 199_999_998, 25 * 99_999_999, 26 * 99_999_999, 27 * 99_999_999 + 5, 675 * 99_999_999]
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    found = {r.n: r.acc for r in frame.select("n", lineages.accession(F.col("n")).alias("acc")).collect()}
    assert found == {n: expected(n) for n in numbers} and len(set(found.values())) == len(numbers)
    rows = spark.createDataFrame([("b", "order:A"), ("a", "order:A;genus:B"), ("c", None), ("d", "taxid:9")], "k string, lineage string")
    made = lineages.accessions(rows, lineages.appended(rows), ["k"], used=2, prefix="X")
    assert rows_of(made.select("k", "acc", "taxid")) == [("XAA00000003", "a", 3), ("XAA00000004", "b", 2), ("XAA00000005", "c", None), ("XAA00000006", "d", 9)]


def _divide(seq, qual, word, border, filler):
    at = seq.rfind(word)
    cut, resume = (len(seq), len(seq)) if at < 0 else {"both": (at, at + len(word)), "start": (at, at), "end": (at + len(word),) * 2}[border]
    parts = [seq[:cut], qual[:cut], seq[resume:], qual[resume:]]
    if filler and not parts[0]:
        parts[:2] = ["A", "5"]
    elif filler and not parts[2]:
        parts[2:] = ["A", "5"]
    return (*parts, at >= 0)


@pytest.mark.parametrize("border", ["both", "start", "end"])
@pytest.mark.parametrize("filler", [False, True])
def test_division(spark, border, filler):
    seqs = ["TTTTACGGTCCCC", "ACGGTCC", "CCACGGT", "ACGGT", "CCCCCCCC", ""]
    rows = [(str(k), s, "".join(chr(40 + i) for i in range(len(s)))) for k, s in enumerate(seqs)]
    frame = spark.createDataFrame(rows, "name string, seq string, qual string")
    found = demux.divided(frame, ["ACGGT"], max_mismatches=0, border=border, filler=filler)
    columns = ["name", "former", "former_qual", "latter", "latter_qual", "found"]
    assert sorted(map(tuple, found.select(columns).collect())) == [(n, *_divide(s, q, "ACGGT", border, filler)) for n, s, q in rows]
    kept = demux.divided(frame, ["ACGGT"], max_mismatches=0, border=border, keep_missed=False)
    assert kept.count() == 4
    if border == "both" and not filler:
        plain = demux.divide_at(frame.filter("seq != ''"), "ACGGT", max_share=0.0)
        assert {r.name: (r.former, r.latter or "") for r in plain.collect()} == {n: (p[0], p[2]) for n, s, q in rows if s for p in [_divide(s, q, "ACGGT", border, False)]}


def test_null_sequences_and_second_queries(spark):
    frame = spark.createDataFrame([("a", None, None), ("b", "TTGGATCCTT", "IIIIIIIIII")], "name string, seq string, qual string")
    found = demux.divided(frame, ["ACACAC", "GGATCC"], max_mismatches=0).orderBy("name").collect()
    assert [(r.former, r.latter, r.found) for r in found] == [("", "", False), ("TT", "TT", True)]
    with pytest.raises(ValueError):
        demux.divided(frame, ["A"], border="none")


def test_primers_at_the_head(spark):
    """Ungapped fits in plain Python: the primer as it is at the head."""
    seqs = ["ACGTTGCAAATTT", "ACGTTGCA", "TTTTTTTTTTTTTTT", "ACGATGCATCCCC"]
    frame = spark.createDataFrame([(s,) for s in seqs], "seq string")
    hits = {r.seq: r.hit for r in demux.locate_primers(frame, [("p", "ACGTTGCA")]).collect()}
    wrong = {s: sum(a != b for a, b in zip(s, "ACGTTGCA")) for s in seqs}
    for s in seqs:
        assert (hits[s] is not None) == (wrong[s] / 8 <= 0.14)
        if hits[s]:
            assert (hits[s].primer, hits[s].start, hits[s].end, hits[s].mismatches) == ("p", 0, 7, wrong[s])


def test_depths_reach_their_slope(spark):
    """A sample's depth is the last one before the curve's slope falls below the target's."""
    rng = np.random.default_rng(5)
    rows = [(s, f"i{k}", int(c)) for s in ("a", "b") for k, c in enumerate(rng.geometric(0.02, 60))]
    cube = spark.createDataFrame(rows + [("b", f"x{k}", 1) for k in range(20)], "samplename string, otuname string, nreads long")
    gate = {r.samplename: r.target for r in quantify.coverage_gate(cube, min_coverage=0.9, min_reads=1).collect()}
    depths = {r.samplename: r.depth for r in quantify.rarefaction_depths(cube, min_coverage=0.9, min_reads=1).collect()}
    assert set(depths) == set(gate) == {"a", "b"}
    for sample, depth in depths.items():
        counts = np.array([r.nreads for r in cube.filter(F.col("samplename") == sample).collect()])
        limit = 1 - gate[sample] - 1e-10
        n = int(counts.sum())
        if depth < n:
            assert quantify.rare_slope(counts, depth) <= limit < quantify.rare_slope(counts, depth - 1)
        else:
            assert quantify.rare_slope(counts, n - 1) > limit
