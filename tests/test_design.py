"""Errors of inputs that don't fit, places, and operators against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cubeloom import session
from cubeloom.functions.distributions import binomial_pmf
from cubeloom.operators import assignments, decontam, demux, filters, neighbours, reads
from cubeloom.sources import fastq
from tests.conftest import rows_of


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "local-cluster[3,2,1000]"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "s3://x/y/"
    assert session.shared_dir(Session()) == "s3://x/y"
    Session.conf = Conf({"spark.master": "local[2]"})
    assert session.shared_dir(Session()).startswith("file://")


def test_places_follow_the_order(spark):
    draw = random.Random(1)
    rows = [(draw.randint(0, 50), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a long, b long")
    found = {r.b: r.place for r in session.with_places(frame, [F.desc("a"), F.col("b")]).collect()}
    assert found == {b: k + 1 for k, (_, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert session.with_places(frame.limit(0), [F.col("a")]).collect() == []


def test_files_in_step_go_by_file_and_record(spark):
    schema = "file string, rec_no long, name string, seq string, qual string"
    first = spark.createDataFrame([(f, 0, f"{f} x", f"A{f}", "II") for f in "ab"], schema)
    second = spark.createDataFrame([(f, 0, f"{f} y", f"C{f}", "II") for f in "cd"], schema)
    found = fastq.in_step([first, second], ["one", "two"])
    assert sorted((r.file_no, r.name, r.one_seq, r.two_seq) for r in found.collect()) == [(1, "a", "Aa", "Cc"), (2, "b", "Ab", "Cd")]
    with pytest.raises(PySparkException, match="in step"):
        fastq.in_step([first, second.filter("file = 'c'")], ["one", "two"]).collect()


def test_gates_come_before_the_cap(spark):
    frame = spark.createDataFrame([("a", "AC", "II"), ("b", "AC", "++"), ("c", "", "")], "name string, seq string, qual string")
    assert [(r.name, r.qual) for r in reads.by_quality(frame, min_mean=25, max_quality=20).collect()] == [("a", "55")]


def test_missing_members_and_sequences(spark):
    members = spark.createDataFrame([("o1", "r1"), ("o2", "r2")], "otuname string, readname string")
    for names in (["o1"], ["o1", "o2", "o3"]):
        with pytest.raises(PySparkException, match="no (member|sequence) of o"):
            filters.with_sequences(members, spark.createDataFrame([(n, "AC") for n in names], "name string, seq string")).collect()


def test_unequal_query_lists(spark):
    table = spark.createDataFrame([("q1", 8, "x")], "query string, rank_idx int, taxon string")
    lists = [spark.createDataFrame([(q,) for q in names], "query string") for names in (["q1", "q2"], ["q1"])]
    with pytest.raises(PySparkException, match="not in all tables: q2"):
        assignments.merge_assignments([table, table], queries=lists).collect()
    assert rows_of(assignments.merge_assignments([table, table], queries=lists[:1] * 2)) == [("q1", 8, 0, "x")]


def test_jump_chance_is_the_sum_over_both_ways():
    draw = random.Random(2)
    for _ in range(50):
        x, r, f = draw.randint(0, 12), draw.randint(0, 300), draw.randint(0, 300)
        pr, pf = draw.choice([0.0, 0.01, 0.2]), draw.choice([0.0, 0.003])
        total = sum(binomial_pmf(j, r + j, pr) * binomial_pmf(i - j, f + i - j, pf) for i in range(x + 1) for j in range(i + 1))
        assert math.isclose(decontam.jump_chance(x, r, f, pr, pf), 1 - total, abs_tol=1e-9)


@pytest.mark.parametrize("best", [None, 1, 3])
def test_blocks_of_queries_give_all_hits(spark, best):
    draw = random.Random(3)
    vectors = [(i, [float(draw.randint(-3, 3)) for _ in range(4)]) for i in range(60)]
    frame = spark.createDataFrame(vectors, "acc long, vector array<float>")
    asked = frame.filter("acc < 20").withColumnRenamed("acc", "query")
    found = {(r["query"], r.acc): r.score for r in neighbours.vector_hits(asked, frame, 10, best, block=6).collect()}
    every = {(q, a): int(10 * sum(x * y for x, y in zip(u, v))) for q, u in vectors[:20] for a, v in vectors}
    for q in range(20):
        levels = sorted({s for (p, _), s in every.items() if p == q}, reverse=True)[: best or 999]
        wanted = {k: s for k, s in every.items() if k[0] == q and s in levels}
        own = {k: s for k, s in found.items() if k[0] == q}
        assert wanted.items() <= own.items() <= every.items() and (best or own == wanted)


def test_draws_are_the_smallest_hashes(spark):
    from pyspark.sql import Window

    from cubeloom.operators import quantify

    cells = spark.createDataFrame([("a", "x", 700), ("a", "y", 40), ("b", "x", 3), ("c", "z", 90)], "samplename string, otuname string, nreads long")
    depths = spark.createDataFrame([("a", 333), ("b", 3), ("c", 0)], "samplename string, depth long")
    reads = cells.join(depths, "samplename").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("nreads").cast("int")))).withColumn("replicate", F.explode(F.array(F.lit(1), F.lit(2))))
    order = Window.partitionBy("samplename", "replicate").orderBy(F.xxhash64(F.lit(7), "replicate", "samplename", "otuname", "i"), "otuname", "i")
    kept = reads.withColumn("place", F.row_number().over(order)).filter("place <= depth").groupBy("replicate", "samplename", "otuname").agg(F.count("*").alias("nreads"))
    assert rows_of(quantify.rarefy(cells, depths, replicates=2, seed=7)) == rows_of(kept)


def test_totals_that_differ(spark):
    members = spark.createDataFrame([("o1", "r1")], "otuname string, readname string")
    for sizes in ([("o1", 2)], [("o1", 1), ("o2", 1)], [("o2", 1)]):
        with pytest.raises(PySparkException, match="add up"):
            filters.with_checked_totals(spark.createDataFrame(sizes, "name string, size long"), members).collect()


def test_files_of_samples(spark):
    names = ["r__a__p.forward.fastq", "r__a__p.reverse.fastq", "r__undetermined__p.forward.fastq", "r__b__p__incompleteUMI.fastq"]
    frame = spark.createDataFrame([(n,) for n in names], "file string")
    assert rows_of(fastq.sample_files(frame)) == [(names[0], names[1])]
    with pytest.raises(ValueError, match="1 pairs beside 1 single"):
        fastq.sample_files(frame.unionByName(spark.createDataFrame([("r__c__p.fastq",)], "file string")))


def test_primer_lists(spark):
    schema = "rec_no long, name string, seq string"
    first = spark.createDataFrame([(1, "p2", "ggrc"), (0, "p1", "ACGNT")], schema)
    assert demux.primer_list(first) == [("p1", "ACGNT"), ("p2", "GGRC")]
    assert demux.primer_list(first, spark.createDataFrame([(0, "q1", "TT"), (1, "q2", "AA")], schema)) == [("p1", "ACGNT", "TT"), ("p2", "GGRC", "AA")]
    for wrong in ([(0, "q", "TT")], [(0, "q", "T-"), (1, "r", "A")]):
        with pytest.raises(ValueError, match="primer"):
            demux.primer_list(first, spark.createDataFrame(wrong, schema))


def test_taxonomy_sink(spark, tmp_path):
    from cubeloom.operators import hierarchy

    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "domain"), (3, 2, "genus")], "taxid long, parent long, rank string")
    names = spark.createDataFrame([(2, "B", "scientific name"), (2, "C", "synonym"), (3, "G", "scientific name")], "taxid long, name string, nameclass string")
    hierarchy.write_taxonomy(nodes, names, spark.createDataFrame([("x", 3), ("x", 3)], "acc string, taxid long"), str(tmp_path / "t"))
    read = lambda t: rows_of(spark.read.parquet(str(tmp_path / "t" / t)))
    assert read("nodes") == [(1, "superkingdom", 2), (2, "genus", 3)]
    assert read("names") == [("B", 2), ("G", 3)] and read("acc_taxid") == [("x", 3)]


def test_alignments_of_many_are_those_of_each(monkeypatch):
    from cubeloom.functions import alignment

    draw = random.Random(5)
    word = lambda sizes: "".join(draw.choice("ACGTN") for _ in range(draw.choice(sizes)))
    pairs = [(word([0, 1, 7, 12]), word([0, 3, 6])) for _ in range(200)]
    for scores in (alignment.Scores(), alignment.Scores(2, -4, -20, -2), alignment.Scores(end_gap="gap")):
        single = [alignment.align(*p, scores) for p in pairs]
        monkeypatch.setattr(alignment, "_TOGETHER", 7)
        assert alignment.align_many(*zip(*pairs), scores) == single
        assert all((a.replace("-", ""), b.replace("-", "")) == p and len(a) == len(b) for (a, b), p in zip(single, pairs))


def test_records_without_a_layout(spark):
    rows = [("AC", "II", None, None, None, None, None, None)]
    names = ", ".join(f"seq{i} string, qual{i} string" for i in range(1, 5))
    frame = spark.createDataFrame(rows, names)
    assert [(r.index_seq, r.seq) for r in demux.normalised(frame, tag=1).collect()] == [("A", "C")]
    with pytest.raises(PySparkException, match="no layout"):
        demux.normalised(frame.withColumn("seq3", F.lit("A"))).collect()


def test_pruned_hits_keep_what_decides(spark):
    draw = random.Random(4)
    vectors = [(i, [float(draw.randint(-3, 3)) for _ in range(4)]) for i in range(120)]
    frame = spark.createDataFrame(vectors, "acc long, vector array<float>").repartition(3)
    every = {(q, a): int(10 * sum(x * y for x, y in zip(u, v))) for q, u in vectors[:10] for a, v in vectors}
    limits = [(q, draw.choice([None, 0, 60]), draw.choice([None, 30, 90])) for q in range(10)]
    asked = spark.createDataFrame(limits, "query long, floor long, below long").join(frame.withColumnRenamed("acc", "query"), "query")
    found = {(r["query"], r.acc): r.score for r in neighbours.vector_hits(asked, frame, 10, 2, block=4, chunk=16).collect()}
    assert found.items() <= every.items() and len(found) < len(every)
    for q, floor, below in limits:
        own = {k: s for k, s in every.items() if k[0] == q}
        levels = sorted(set(own.values()))
        least = min([levels[-2], *([floor] if floor is not None else []), *[s for s in levels if below is not None and s < below][-1:]])
        assert {k: s for k, s in own.items() if s >= least}.items() <= found.items()
    some = spark.createDataFrame([(1, 5), (7, 3)], "query long, acc long")
    assert {(r["query"], r.acc): r.score for r in neighbours.pair_scores(some, frame, 10).collect()} == {k: every[k] for k in ((1, 5), (7, 3))}
