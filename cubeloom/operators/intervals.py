"""A hierarchy numbered in pre-order, so that scoping needs no closure.

``taxid, parent, depth, pre, last``: a node and all below it have the numbers
``pre`` to ``last``, without gaps, from 1 on; siblings go by their ids.  The table
has one row a node.  Descendants of any set are a running maximum along ``pre``,
ancestors of any set a running count looked up at both ends: one sort each,
whatever the depth, and no parent's children meet in one task.

Nodes whose parent isn't a node, or is the node itself, are roots.  Rows without
an id are left out, of rows with equal ids the least parent counts, and nodes on
a cycle have no root and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions.names import any_word
from cubeloom.operators.hierarchy import rank_index
from cubeloom.schemas import RANK_INDEX
from cubeloom.session import with_running, with_running_max, written


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """``taxid, parent`` by depth, each level written; a root's parent is null."""
    single = nodes.filter("taxid is not null").groupBy("taxid").agg(F.min("parent").alias("parent"))
    single = written(single.withColumn("parent", F.nullif("parent", F.col("taxid"))), "tree-nodes")
    known = single.select(F.col("taxid").alias("parent"), F.lit(True).alias("known"))
    top = single.join(known, "parent", "left").select("taxid", F.when(F.col("known"), F.col("parent")).alias("parent"))
    levels = [written(top.filter("parent is null"), "tree-level")]
    below = single.filter("parent is not null")
    while True:
        level = written(below.join(levels[-1].select(F.col("taxid").alias("parent")), "parent", "left_semi").select("taxid", "parent"), "tree-level")
        if level.isEmpty():
            return levels
        levels.append(level)


def numbered(nodes: DataFrame) -> DataFrame:
    """The numbers of a tree (``taxid, parent``): sizes are summed from the deepest level up, places given from the roots down."""
    levels = _levels(nodes)
    sized: list[DataFrame] = []
    for level in reversed(levels):
        if sized:
            under = sized[-1].groupBy(F.col("parent").alias("taxid")).agg(F.sum("size").alias("under"))
            level = level.join(under, "taxid", "left").select("taxid", "parent", (F.coalesce("under", F.lit(0)) + 1).alias("size"))
        else:
            level = level.select("taxid", "parent", F.lit(1).cast("long").alias("size"))
        sized.append(written(level, "tree-sizes"))
    out: list[DataFrame] = []
    for depth, level in enumerate(reversed(sized)):
        if out:
            level = level.join(out[-1].select(F.col("taxid").alias("parent"), F.col("pre").alias("above")), "parent")
        else:
            level = level.withColumn("above", F.lit(0).cast("long"))
        placed = written(with_running(level, [F.col("above"), F.col("taxid")], F.col("size"), "upto"), "tree-places")
        # What a level has before a parent's first child comes off the running sum.
        first = placed.groupBy("above").agg(F.min(F.col("upto") - F.col("size")).alias("first"))
        pre = F.col("above") + 1 + F.col("upto") - F.col("size") - F.col("first")
        row = placed.join(first, "above").select("taxid", "parent", F.lit(depth).alias("depth"), pre.alias("pre"), (pre + F.col("size") - 1).alias("last"))
        out.append(written(row, "tree-numbers"))
    return written(reduce(DataFrame.unionByName, out), "tree")


def below(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """``taxid``: *roots* (``taxid``) and all nodes below them; ids that are no nodes give none."""
    marked = tree.select("taxid", "pre", "last").join(roots.select("taxid", F.lit(True).alias("hit")).distinct(), "taxid", "left")
    reach = with_running_max(marked, [F.col("pre")], F.when(F.col("hit"), F.col("last")), "reach")
    return reach.filter("reach >= pre").select("taxid")


def above(tree: DataFrame, taxids: DataFrame) -> DataFrame:
    """``taxid``: the given nodes and all their ancestors: nodes with a given one between ``pre`` and ``last``."""
    marked = tree.select("taxid", "pre", "last").join(taxids.select("taxid", F.lit(1).alias("hit")).distinct(), "taxid", "left")
    counted = written(with_running(marked, [F.col("pre")], F.coalesce("hit", F.lit(0)), "upto"), "tree-counts")
    ends = counted.select(F.col("pre").alias("last"), F.col("upto").alias("at_end"))
    return counted.join(ends, "last").filter("at_end > upto - coalesce(hit, 0)").select("taxid")


def ancestors(tree: DataFrame, taxids: DataFrame) -> DataFrame:
    """``taxid, ancestor``: the proper ancestors of each given node (``taxid``), a row a step; the result grows with its depth, and nothing else is made."""
    up = tree.select(F.col("taxid").alias("ancestor"), F.col("parent").alias("next"))
    step = written(tree.join(taxids.select("taxid").distinct(), "taxid", "left_semi").select("taxid", F.col("parent").alias("ancestor")).filter("ancestor is not null"), "steps")
    levels = [step]
    while not step.isEmpty():
        step = written(step.join(up, "ancestor").filter("next is not null").select("taxid", F.col("next").alias("ancestor")), "steps")
        levels.append(step)
    return reduce(DataFrame.unionByName, levels)


def named(nodes: DataFrame, names: DataFrame, words: list[str]) -> DataFrame:
    """``taxid`` of nodes (``taxid, rank``) with a name that one of *words* matches, a regular expression, or ``rank,expression`` for one rank."""
    hit = F.lit(False)
    for word in words:
        rank, comma, rest = word.partition(",")
        ranked = bool(comma) and rank in RANK_INDEX
        match = any_word(F.col("name"), [rest if ranked else word])
        hit = hit | (match & (rank_index(F.col("rank")) == RANK_INDEX[rank]) if ranked else match)
    return nodes.select("taxid", "rank").join(names.select("taxid", "name"), "taxid").filter(hit).select("taxid").distinct()


def scope(
    nodes: DataFrame,
    names: DataFrame,
    tree: DataFrame,
    include: list[str] = (),
    exclude: list[str] = (),
    keywords: list[str] = (),
    ngwords: list[str] = (),
    listed: DataFrame | None = None,
    acc_taxid: DataFrame | None = None,
) -> DataFrame:
    """``taxid`` of a scope, in this order.

    1. *include*: nodes that match and all below them; without it the nodes of the accessions *listed* (``acc``,
       with *acc_taxid*); without both all nodes with a name.
    2. *keywords*: nodes with a name that matches one of them stay (nodes below don't follow).
    3. *ngwords*: nodes with a name that matches go, by themselves.
    4. *exclude*: nodes that match go with all below them.
    """
    if include:
        inside = below(tree, named(nodes, names, include))
    elif listed is not None:
        inside = acc_taxid.join(listed.select("acc").distinct(), "acc", "left_semi").select("taxid").distinct()
    else:
        inside = nodes.join(names, "taxid", "left_semi").select("taxid").distinct()
    if keywords:
        inside = inside.join(named(nodes, names, keywords), "taxid", "left_semi")
    if ngwords:
        inside = inside.join(named(nodes, names, ngwords), "taxid", "left_anti")
    if exclude:
        inside = inside.join(below(tree, named(nodes, names, exclude)), "taxid", "left_anti")
    return inside


def accessions_of(acc_taxid: DataFrame, taxids: DataFrame, listed: DataFrame | None = None, unlisted: DataFrame | None = None) -> DataFrame:
    """``acc, taxid`` of the accessions of *taxids*; of *listed* ones only, without *unlisted* ones."""
    out = acc_taxid.select("acc", "taxid").distinct().join(taxids, "taxid", "left_semi").select("acc", "taxid")
    if listed is not None:
        out = out.join(listed, "acc", "left_semi")
    return out if unlisted is None else out.join(unlisted, "acc", "left_anti")


def database_of_list(nodes: DataFrame, names: DataFrame, acc_taxid: DataFrame, tree: DataFrame, listed: DataFrame) -> dict[str, DataFrame]:
    """The tables of a taxonomy cut to a list of accessions: theirs, and their nodes with all ancestors and names."""
    kept = acc_taxid.select("acc", "taxid").distinct().join(listed, "acc", "left_semi")
    taxids = written(above(tree, kept.select("taxid")), "list-nodes")
    return {"acc_taxid": kept, "nodes": nodes.join(taxids, "taxid", "left_semi"), "names": names.join(taxids, "taxid", "left_semi")}
