"""What bounds memory, disk and time of queries on larger tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq

from cubeloom.llm import positional_index
from cubeloom.operators import chimeras, decontam, search
from cubeloom.plans import catalogue
from tests.conftest import SMALL, rows_of

CELLS = [("s", "o", 50), ("b1", "o", 1), ("b2", "o", 2), ("b3", "p", 3), ("s", "p", 3), ("t", "o", 2), ("t", "q", 7), ("b1", "q", 0), ("u", "q", 0), (None, "o", 9)]


def _cells(spark):
    blanks = spark.createDataFrame([(b,) for b in ("b1", "b2", "b3", "b3", "absent")], "samplename string")
    return spark.createDataFrame(CELLS, "samplename string, otuname string, nreads long"), blanks


def _no_links(*_):
    raise AssertionError("pairs of samples and blanks")


def test_shared_blanks_need_no_pairs(spark, monkeypatch):
    cells, blanks = _cells(spark)
    links = decontam.links_to_all(cells, blanks)
    for options in ({}, {"adjust": "none"}, {"unit": "all"}):
        assert rows_of(decontam.tau_test_to_all(cells, blanks, **options)) == rows_of(decontam.tau_test(cells, links, **options))
    assert rows_of(decontam.statistics_to_all(cells, blanks)) == rows_of(decontam.blank_statistics(cells, links))
    assert rows_of(decontam.contamination_rates_to_all(cells, blanks)) == rows_of(decontam.contamination_rates(cells, links))
    assert decontam.tau_test_to_all(cells, blanks.limit(0)).isEmpty() and decontam.contamination_rates_to_all(cells.filter("samplename = 'b1'"), blanks).isEmpty()
    monkeypatch.setattr(decontam, "links_to_all", _no_links)
    assert catalogue.queries()["tau_test"](spark, SMALL).count() == 48
    assert catalogue.queries()["contamination_rate"](spark, SMALL).count() == 2


def test_calibrated_values_need_no_pairs(spark, monkeypatch):
    cells, blanks = _cells(spark)
    amounts = cells.withColumn("ncopies", cells.nreads / 4)
    assert rows_of(decontam.calibrated_tau_test_to_all(amounts, blanks)) == rows_of(decontam.calibrated_tau_test(amounts, decontam.links_to_all(cells, blanks)))
    monkeypatch.setattr(decontam, "links_to_all", _no_links)
    assert catalogue.queries()["calibrated_tau_test"](spark, SMALL).count() == 48


def test_a_task_holds_one_shard_of_the_index(spark):
    """A shard is a row group of its own, or a reader takes all of a file's at once."""
    from cubeloom.llm.common import Scratch

    docs = spark.range(0, 4100, 1, 1).selectExpr("id AS doc_id", "concat('word', id % 7) AS text")
    index = positional_index.build_index(docs, Scratch(spark))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    assert index.count() == 3
    assert [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)] == [1, 1, 1]


def test_dealt_neighbours_are_not_broadcast(spark):
    samples = spark.createDataFrame([(f"s{i}", f"f{i % 3}", f"r{i // 3}") for i in range(9)], "samplename string, forward string, reverse string")
    found = decontam.tag_neighbours(samples)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("ShuffledHashJoin") == 2 and plan.count("BuildLeft") == 2
    assert found.count() == 2 * 9 * 2


FLIP = str.maketrans("ACGT", "TGCA")


def _letters(draw, n):
    return "".join(draw.choice("ACGT") for _ in range(n))


def test_an_index_with_a_window_loses_no_hit(spark):
    draw = random.Random(21)
    targets = [(f"t{i}", _letters(draw, draw.randint(60, 90))) for i in range(40)] + [("tiny", "ACG"), ("none", None), ("same", "ACGTACGTAC" * 8)]
    reads = []
    for i in range(80):
        part = draw.choice(targets[:40])[1][5:59]
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(part))
            part = part[:at] + draw.choice(["", "A", "CG"]) + part[at + 1 :]
        reads.append((f"r{i}", part if i % 2 else part[::-1].translate(FLIP)))
    stored, asked = (spark.createDataFrame(x, "name string, seq string") for x in (targets, reads))
    window = search.window_for(asked, 0.92, 6)
    whole, thin = (search.store(stored, 6, 4, window=w) for w in (1, window))
    assert window > 3 and spark.table(thin.words).count() * 2 < spark.table(whole.words).count()
    assert rows_of(search.hits(asked, thin, 0.92)) == rows_of(search.hits(asked, whole, 0.92))
    assert search.hits(asked, thin, 0.92).count() > 40
    # A piece with fewer k-mers than the window is told, not lost in silence.
    short = spark.createDataFrame([("s", targets[0][1][:24])], "name string, seq string")
    assert search.too_short(short, whole, 0.92).isEmpty() and search.too_short(short, thin, 0.92).count() == 1
    assert search.window_for(short.limit(0), 0.92, 6) == 1


def test_equal_sequences_are_searched_once(spark, monkeypatch):
    draw = random.Random(22)
    true = [_letters(draw, 80) for _ in range(3)]
    targets = spark.createDataFrame([(f"t{i}{c}", t) for i, t in enumerate(true) for c in "cab"], "name string, seq string")
    reads = spark.createDataFrame([(f"r{i}{c}", t[3:70]) for i, t in enumerate(true) for c in "xyz"] + [("lost", _letters(draw, 67))], "name string, seq string")
    asked = []
    inner = search.hits
    monkeypatch.setattr(search, "hits", lambda queries, index, *a, **o: asked.append((queries.count(), spark.table(index.letters).count())) or inner(queries, index, *a, **o))
    found = search.best_in(reads, targets, 0.95, 8)
    assert {r["query"]: (r.target, r.target_start) for r in found.collect()} == {f"r{i}{c}": (f"t{i}a", 3) for i in range(3) for c in "xyz"}
    assert asked == [(4, 3)]


def test_clusters_store_few_words(spark, monkeypatch):
    draw = random.Random(23)
    rows = [(f"c{i}", _letters(draw, 100), 9) for i in range(6)]
    stored = []
    inner = search.store
    monkeypatch.setattr(search, "store", lambda *a, **o: stored.append(inner(*a, **o)) or stored[-1])
    assert search.clustered(spark.createDataFrame(rows, "name string, seq string, size long"), 0.97).count() == 6
    assert spark.table(stored[0].words).count() < 6 * 93 / 4


def test_many_sequences_are_laid_at_a_time(spark, monkeypatch):
    draw = random.Random(24)
    whole = [_letters(draw, 200) for _ in range(4)]
    # Ten letters less in front, and three more in the middle: places behind 127 keep their shifts.
    moved = [x[10:90] + "ACG" + x[90:] for x in whole]
    groups = [[moved[i], whole[i], whole[i - 1]] for i in range(4)]
    together = chimeras.beside_all(whole, groups)
    for x, around, laid in zip(whole, groups, together):
        own = np.frombuffer(x.encode(), np.uint8)
        assert (laid == chimeras.beside(x, around)).all()
        assert (laid[0] == own)[20:].mean() > 0.95 and (laid[1] == own).all() and (laid[2] == own).mean() < 0.6
    calls = []
    inner = chimeras._paths
    monkeypatch.setattr(chimeras, "_paths", lambda *a: calls.append(len(a[0])) or inner(*a))
    chimeras.beside_all(whole, groups)
    assert calls == [8]
    monkeypatch.setattr(chimeras, "_PATHS", 3)
    assert all((x == y).all() for x, y in zip(together, chimeras.beside_all(whole, groups)))


def test_counting_table_of_any_size_gives_the_same(monkeypatch):
    draw = random.Random(25)
    parents = [_letters(draw, draw.randint(0, 60)) for _ in range(90)]
    queries = [draw.choice(parents)[:30] + _letters(draw, 20) for _ in range(25)]
    sizes, parent_sizes = np.array([draw.randint(1, 9) for _ in queries]), np.sort(np.array([draw.randint(1, 30) for _ in parents]))[::-1]

    def words(x, k):
        return [x[i : i + k] for i in range(len(x) - k + 1)]

    for k, most in ((3, 4), (8, 2)):
        expected = []
        for q, x in enumerate(queries):
            for chunk in range(4):
                own = words(x, k)
                own = {w for i, w in enumerate(own) if i * 4 // len(own) == chunk}
                shared = [(len(own & set(words(p, k))), i) for i, p in enumerate(parents) if parent_sizes[i] >= 2 * sizes[q]]
                expected += [(q, chunk, i, n) for n, i in sorted(shared, key=lambda y: (-y[0], y[1]))[:most] if n]
        for cells in (1, 500, 1 << 20):
            monkeypatch.setattr(chimeras, "_CELLS", cells)
            found = chimeras.best_shared(queries, sizes, parents, parent_sizes, k, 4, 2.0, most)
            assert sorted(zip(*(x.tolist() for x in found))) == sorted(expected)
