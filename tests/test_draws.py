"""Draws by hypergeometric splitting: their law, their bounds, samples of many reads."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.functions import draws
from cubeloom.operators import quantify
from tests.conftest import rows_of

_CELLS = "samplename string, otuname string, nreads long"


def _chances(counts: list[int], depth: int) -> dict[tuple, float]:
    """The multivariate hypergeometric law, outcome by outcome."""
    whole = math.comb(sum(counts), depth)
    kinds = itertools.product(*[range(c + 1) for c in counts])
    return {k: math.prod(math.comb(c, x) for c, x in zip(counts, k)) / whole for k in kinds if sum(k) == depth}


def _fits(found: list[tuple], chances: dict[tuple, float]) -> bool:
    """Chi-square below its mean and six deviations."""
    assert set(found) <= set(chances)
    n, value = len(found), 0.0
    for outcome, p in chances.items():
        value += (found.count(outcome) - n * p) ** 2 / (n * p)
    free = len(chances) - 1
    return value < free + 6 * math.sqrt(2 * free)


@pytest.mark.parametrize("limit", [draws.LIMIT, 0])
@pytest.mark.parametrize("counts, depth", [([5, 3, 2], 4), ([1, 1, 1, 1, 1], 2), ([7, 1], 7)])
def test_law_of_a_split(limit, counts, depth):
    """With limit 0 all draws go by inversion."""
    rng = np.random.default_rng(3)
    found = [tuple(map(int, draws.split(rng, counts, depth, limit))) for _ in range(4000)]
    assert _fits(found, _chances(counts, depth))


def test_law_over_blocks(spark):
    counts = {"a": 4, "b": 3, "c": 2, "d": 2}
    cells = spark.createDataFrame([("s", k, n) for k, n in counts.items()], _CELLS)
    drawn = quantify.rarefy_cells(cells, spark.createDataFrame([("s", 5)], "samplename string, depth long"), replicates=1500, block_cells=2).collect()
    by = {}
    for r in drawn:
        by.setdefault(r.replicate, {})[r.otuname] = r.nreads
    found = [tuple(x.get(k, 0) for k in counts) for x in by.values()]
    assert len(found) == 1500 and _fits(found, _chances(list(counts.values()), 5))


def test_any_partitions_and_odd_rows(spark):
    rows = [("s", f"i{k}", k % 7) for k in range(500)] + [("t", "x", 3), ("u", "y", 2), ("v", "z", 4), (None, "x", 1), ("s", None, 5), ("s", "i1", 4), ("w", "n", None)]
    cells = spark.createDataFrame(rows, _CELLS)
    depths = spark.createDataFrame([("s", 300), ("t", 9), ("u", 0), ("v", None), ("w", 2), ("gone", 1)], "samplename string, depth long")
    drawn = quantify.rarefy_cells(cells, depths, replicates=2, seed=1, block_cells=40)
    sums = {(r.replicate, r.samplename): r.n for r in drawn.groupBy("replicate", "samplename").agg(F.sum("nreads").alias("n")).collect()}
    assert sums == {(1, "s"): 300, (2, "s"): 300, (1, "t"): 3, (2, "t"): 3}
    given = cells.groupBy("samplename", "otuname").agg(F.sum("nreads").alias("of"))
    assert drawn.join(given, ["samplename", "otuname"]).filter("nreads > of").isEmpty()
    assert rows_of(drawn) == rows_of(quantify.rarefy_cells(cells.repartition(7), depths, replicates=2, seed=1, block_cells=40))
    assert quantify.rarefy_cells(cells.limit(0), depths).count() == 0


def test_ten_billion_reads(spark):
    cells = spark.createDataFrame([("s", f"i{k}", 10_000_000 if k else 5 * 10**9) for k in range(500)], _CELLS)
    start = time.time()
    drawn = quantify.rarefy_cells(cells, spark.createDataFrame([("s", 10**9)], "samplename string, depth long"), replicates=4)
    sums = drawn.groupBy("replicate").agg(F.sum("nreads").alias("n"), F.max("nreads").alias("most")).collect()
    assert time.time() - start < 60
    share = 5 * 10**9 / (5 * 10**9 + 499 * 10_000_000)
    assert len(sums) == 4 and all(r.n == 10**9 and abs(r.most / 1e9 - share) < 6 * 0.5 / math.sqrt(1e9) for r in sums)


def test_groups_are_whole_across_batches():
    import pandas as pd

    draw = np.random.default_rng(5)
    rows = sorted((f"s{draw.integers(4)}", int(draw.integers(3)), i) for i in range(90))
    frame = pd.DataFrame(rows, columns=["samplename", "block", "i"])
    for size in (1, 7, 30, 90):
        found = []
        for part, borders in quantify._groups((frame.iloc[k : k + size].reset_index(drop=True) for k in range(0, 90, size)), ["samplename", "block"]):
            found += [part.iloc[i:j] for i, j in borders]
        assert [tuple(r) for g in found for r in g.itertuples(index=False)] == rows
        assert [len(g[["samplename", "block"]].drop_duplicates()) for g in found] == [1] * len({r[:2] for r in rows})
    assert list(quantify._groups(iter([frame.iloc[:0]]), ["samplename"])) == []
