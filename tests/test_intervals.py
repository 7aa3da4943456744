"""Trees in pre-order numbers against walks in plain Python."""

from __future__ import annotations

import random

import pytest

from cubeloom import session
from cubeloom.operators import intervals
from tests.conftest import rows_of

_NODES = "taxid long, parent long, rank string"


def _random_tree(n: int, seed: int) -> dict[int, int]:
    """Ids in no order, several roots, one parent with a third of the nodes."""
    rng = random.Random(seed)
    ids = rng.sample(range(10, 10 * n + 20), n)
    parents = {ids[0]: ids[0], ids[1]: 1}
    for k in range(2, n):
        parents[ids[k]] = ids[1] if rng.random() < 0.33 else ids[rng.randrange(max(0, k - 40), k)]
    return parents


def _up(parents: dict[int, int], node: int) -> list[int]:
    out = []
    while parents[node] in parents and parents[node] != node:
        node = parents[node]
        out.append(node)
    return out


@pytest.mark.parametrize("seed", [1])
def test_numbers_and_scopes(spark, seed):
    parents = _random_tree(120, seed)
    tree = intervals.numbered(spark.createDataFrame([(a, b, None) for a, b in parents.items()], _NODES))
    rows = {r.taxid: r for r in tree.collect()}
    up = {n: _up(parents, n) for n in parents}
    assert sorted(r.pre for r in rows.values()) == list(range(1, 121))
    for n, r in rows.items():
        assert r.depth == len(up[n])
        inside = {m for m in parents if m == n or n in up[m]}
        assert {m for m, x in rows.items() if r.pre <= x.pre <= r.last} == inside
    siblings = sorted((n for n in parents if up[n] and up[n][0] == rows[n].parent), key=lambda n: (rows[n].parent, rows[n].pre))
    assert siblings == sorted(siblings, key=lambda n: (rows[n].parent, n))
    rng = random.Random(seed)
    for size in (0, 3, 30):
        chosen = rng.sample(sorted(parents), size)
        given = spark.createDataFrame([(c,) for c in [*chosen, 5]], "taxid long")
        assert rows_of(intervals.below(tree, given)) == [(m,) for m in parents if m in chosen or set(up[m]) & set(chosen)]
        reached = {a for c in chosen for a in [c, *up[c]]}
        assert rows_of(intervals.above(tree, given)) == [(m,) for m in reached]
        assert rows_of(intervals.ancestors(tree, given).select("ancestor", "taxid")) == [(a, c) for c in chosen for a in up[c]]


def test_odd_trees(spark):
    frame = spark.createDataFrame([(2, 1, None), (2, 1, None), (3, 2, None), (None, 2, None), (7, 8, None), (8, 7, None), (4, None, None)], _NODES)
    tree = intervals.numbered(frame)
    assert [tuple(r) for r in tree.select("taxid", "depth", "pre", "last").orderBy("pre").collect()] == [(2, 0, 1, 2), (3, 1, 2, 2), (4, 0, 3, 3)]
    empty = intervals.numbered(frame.limit(0))
    assert empty.count() == intervals.below(empty, frame.select("taxid")).count() == intervals.above(empty, frame.select("taxid")).count() == 0


def test_running_maximum(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, rng.randrange(1000)])) for k in range(200)]
    frame = spark.createDataFrame(rows, "k long, v long").repartition(5)
    expected, most = [], None
    for k, v in rows:
        most = v if most is None else most if v is None else max(most, v)
        expected.append((k, most))
    found = session.with_running_max(frame, [frame.k], frame.v, "most").select("k", "most")
    assert sorted(map(tuple, found.collect())) == expected


def test_order_of_a_scope(spark):
    nodes = spark.createDataFrame([(2, 1, "class"), (3, 2, "genus"), (4, 3, "species"), (5, 3, "species"), (6, 1, "class")], _NODES)
    names = spark.createDataFrame([(2, "Alpha"), (3, "Beta"), (4, "Beta one"), (5, "beta two"), (5, "other"), (6, "Gamma")], "taxid long, name string")
    accs = spark.createDataFrame([("x", 4), ("x", 4), ("y", 5), ("z", 6)], "acc string, taxid long")
    tree = intervals.numbered(nodes)
    scoped = lambda **k: sorted(r.taxid for r in intervals.scope(nodes, names, tree, **k).collect())
    assert scoped() == [2, 3, 4, 5, 6]
    assert scoped(include=["alpha"]) == [2, 3, 4, 5]
    assert scoped(include=["alpha"], keywords=["^beta"]) == [3, 4, 5]
    assert scoped(include=["alpha"], ngwords=["^beta$"]) == [2, 4, 5]
    assert scoped(include=["alpha"], keywords=["species,beta"], ngwords=["other"]) == [4]
    assert scoped(exclude=["genus,beta"]) == [2, 6]
    listed = spark.createDataFrame([("x",), ("z",), ("none",)], "acc string")
    assert scoped(listed=listed, acc_taxid=accs) == [4, 6]
    assert rows_of(intervals.accessions_of(accs, nodes.select("taxid"), listed, spark.createDataFrame([("z",)], "acc string"))) == [("x", 4)]
    cut = intervals.database_of_list(nodes, names, accs, tree, listed.filter("acc = 'x'"))
    assert sorted(r.taxid for r in cut["nodes"].collect()) == [2, 3, 4] and cut["names"].count() == 3 and cut["acc_taxid"].count() == 1
