"""Planted rates of tag jumps come back; what the blanks don't determine is null."""

from __future__ import annotations

import itertools
import random

import numpy as np

from cubeloom.operators import decontam, jumps

_CELLS = "samplename string, otuname string, nreads long"
_HALVES = "samplename string, forward string, reverse string"


def _plate(run: str, forward: dict[str, float], reverse: dict[str, float], blanks: set[tuple], seed: int):
    rng = random.Random(seed)
    items = [f"o{k}" for k in range(30)]
    reads = {(f, r): {} if (f, r) in blanks else {o: rng.randrange(10**5, 10**7) for o in rng.sample(items, 12)} for f, r in itertools.product(forward, reverse)}
    cells, halves = [], []
    for (f, r), own in reads.items():
        name = f"{run}__{f}+{r}__p"
        halves.append((name, f, r))
        if (f, r) in blanks:
            for o in items:
                by_reverse = sum(x.get(o, 0) for (a, b), x in reads.items() if a == f and b != r)
                by_forward = sum(x.get(o, 0) for (a, b), x in reads.items() if b == r and a != f)
                own[o] = round(forward[f] * by_reverse + reverse[r] * by_forward)
        cells += [(name, o, n) for o, n in own.items()]
    return cells, halves


def test_planted_rates(spark):
    forward = {"f1": 0.002, "f2": 0.0005, "f3": 0.0}
    reverse = {"r1": 0.001, "r2": 0.004, "r3": 0.0001}
    blanks = {("f1", "r1"), ("f2", "r2"), ("f3", "r3"), ("f1", "r3")}
    cells, halves = _plate("x", forward, reverse, blanks, 1)
    more, others = _plate("y", {"f1": 0.01, "f2": 0.0}, {"r1": 0.003, "r2": 0.0}, {("f1", "r1")}, 2)
    named = spark.createDataFrame([(n,) for n, f, r in halves if (f, r) in blanks] + [("y__f1+r1__p",), ("none",)], "samplename string")
    # Plates don't share tags: samples of another run get names of their own.
    others = [(n, f"y{f}", f"y{r}") for n, f, r in others]
    found = jumps.joint_rates(spark.createDataFrame(cells + more, _CELLS), spark.createDataFrame(halves + others, _HALVES), named)
    rows = {r.samplename: r for r in found.collect()}
    assert len(rows) == 5
    for name, f, r in halves:
        if (f, r) in blanks:
            row = rows[name]
            assert abs(row.reverse_rate - forward[f]) < 0.02 * forward[f] + 1e-6 and abs(row.forward_rate - reverse[r]) < 0.02 * reverse[r] + 1e-6
            total = 1 + row.reverse_rate + row.forward_rate
            assert abs(row.reverse_jump - row.reverse_rate / total) < 1e-12 and row.residual < 1e4
    assert abs(rows["y__f1+r1__p"].reverse_rate - 0.01) < 1e-4 and abs(rows["y__f1+r1__p"].forward_rate - 0.003) < 1e-4


def test_rates_that_are_not_determined(spark):
    """One item gives one equation for two rates; no neighbours give none."""
    cells = spark.createDataFrame([("x__b__p", "o", 7), ("x__s__p", "o", 5000), ("x__t__p", "o", 900), ("x__c__p", "o", 4)], _CELLS)
    halves = spark.createDataFrame([("x__b__p", "f1", "r1"), ("x__s__p", "f1", "r2"), ("x__t__p", "f2", "r1"), ("x__c__p", "f9", "r9")], _HALVES)
    rows = {r.samplename: r for r in jumps.joint_rates(cells, halves, spark.createDataFrame([("x__b__p",), ("x__c__p",)], "samplename string")).collect()}
    assert rows["x__b__p"].reverse_rate is None and rows["x__b__p"].reverse_jump is None and rows["x__b__p"].residual < 1e-6
    assert rows["x__c__p"].forward_rate is None and abs(rows["x__c__p"].residual - 16) < 1e-9
    assert jumps.joint_rates(cells.limit(0), halves, halves.select("samplename")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, x = rng.random((12, 3)), rng.uniform(-0.1, 0.2, 3)
        gram, right = a.T @ a, a.T @ (a @ x)
        found, known = jumps.bounded_least_squares(gram, right, 0.1)
        gradient = gram @ found - right
        assert known.all() and ((0 <= found) & (found <= 0.1 + 1e-12)).all()
        assert all(g > -1e-7 if v < 1e-12 else g < 1e-7 if v > 0.1 - 1e-12 else abs(g) < 1e-7 for v, g in zip(found, gradient))


def test_sums_over_tags_are_those_over_pairs(spark):
    draw = random.Random(9)
    tags = [(f"r__s{i}__p", draw.choice(["f1", "f2", None]), draw.choice(["r1", "r2", "r3"])) for i in range(30)] + [("r__alone__p", "f9", "r9")]
    samples = spark.createDataFrame(tags, "samplename string, forward string, reverse string")
    cells = {(draw.choice(tags)[0], f"o{draw.randint(1, 5)}"): draw.randint(1, 90) for _ in range(80)}
    cube = spark.createDataFrame([(*k, n) for k, n in cells.items()], "samplename string, otuname string, nreads long")
    edges = decontam.tag_neighbours(samples)
    edges = spark.createDataFrame(edges.collect(), edges.schema)
    pairs = {(s, t, "reversejump") for s, f, r in tags for t, g, q in tags if f and f == g and r != q} | {(s, t, "forwardjump") for s, f, r in tags for t, g, q in tags if f and g and r == q and f != g}
    assert {tuple(e) for e in edges.collect()} == pairs and edges.count() == len(pairs)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(decontam.neighbour_sums(cube, edges), decontam.tag_sums(cube, samples))
    rates = decontam.jump_rates(cube, edges, 0.001, 0.0015)
    assert same(rates, decontam.tag_rates(cube, samples, 0.001, 0.0015))
    assert same(decontam.jump_test(cube, edges, rates), decontam.tag_test(cube, samples, rates))
    plan = decontam.tag_sums(cube, samples)._jdf.queryExecution().optimizedPlan().toString()
    assert "dst" not in plan  # no pairs of samples
