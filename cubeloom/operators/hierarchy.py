"""Hierarchy (taxonomy) operators over ``taxid, parent, rank`` nodes.

Walks are frontier joins, one step of depth a round, each round written; the
closure ``taxid, ancestor, depth`` is the reusable result.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.names import any_word
from cubeloom.schemas import RANK_INDEX, RANK_SYNONYMS
from cubeloom.session import with_places, written


def rank_index(rank: Column) -> Column:
    """The place of a rank; 0 for ranks outside the domain and for null."""
    known = F.create_map(*chain.from_iterable((F.lit(r), F.lit(i)) for r, i in RANK_INDEX.items()))
    return F.coalesce(F.try_element_at(known, rank), F.lit(0))


def normal_rank(rank: Column) -> Column:
    """A dump's name of a rank as the domain's."""
    known = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in RANK_SYNONYMS.items()))
    return F.coalesce(F.try_element_at(known, rank), rank)


def without_root(nodes: DataFrame, root: int = 1) -> DataFrame:
    """Nodes with normal ranks, without the root itself."""
    return nodes.filter(F.col("taxid") != root).withColumn("rank", normal_rank(F.col("rank")))


def write_taxonomy(nodes: DataFrame, names: DataFrame, acc_taxid: DataFrame, path: str, root: int = 1) -> None:
    """The normalised tables of a taxonomy under *path*: ``nodes`` without the root, one scientific name per node in ``names``, and ``acc_taxid``."""
    without_root(nodes, root).select("taxid", "parent", "rank").write.parquet(f"{path}/nodes")
    scientific_names(names).write.parquet(f"{path}/names")
    acc_taxid.select("acc", "taxid").distinct().write.parquet(f"{path}/acc_taxid")


def scientific_names(names: DataFrame) -> DataFrame:
    """``taxid, name``: one scientific name per node, the first by order of names."""
    return names.filter("nameclass = 'scientific name'").groupBy("taxid").agg(F.min("name").alias("name"))


def closure(nodes: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``taxid, ancestor, depth`` of all proper ancestors that are nodes; of *starts* (``taxid``) only, if given."""
    up = nodes.select(F.col("taxid").alias("ancestor"), F.col("parent").alias("next"))
    begin = nodes if starts is None else nodes.join(starts.select("taxid").distinct(), "taxid", "left_semi")
    up = written(up, "parents")
    step = written(begin.select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).join(up, "ancestor"), "closure")
    levels = []
    while not step.isEmpty():
        levels.append(step.select("taxid", "ancestor", "depth"))
        above = step.select("taxid", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth")).filter("ancestor != taxid")
        step = written(above.join(up, "ancestor"), "closure")
    return reduce(DataFrame.unionByName, levels) if levels else step.select("taxid", "ancestor", "depth")


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``taxid``: *roots* (``taxid``) and all nodes below them."""
    below = nodes.select(F.col("parent").alias("taxid"), F.col("taxid").alias("child"))
    found = written(roots.select("taxid").distinct(), "descendants")
    step = found
    levels = [found]
    while True:
        step = written(step.join(below, "taxid").select(F.col("child").alias("taxid")), "descendants")
        if step.isEmpty():
            return reduce(DataFrame.unionByName, levels).distinct()
        levels.append(step)


def lineages(accessions: DataFrame, nodes: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """``acc, rank_idx, taxid``: the ranked nodes at and above each accession's node (``acc, taxid``); *tree* is the closure, if at hand."""
    ranks = nodes.select(F.col("taxid").alias("ancestor"), rank_index(F.col("rank")).alias("rank_idx"))
    above = (closure(nodes, accessions.select("taxid")) if tree is None else tree).select("taxid", "ancestor")
    own = accessions.select("taxid", F.col("taxid").alias("ancestor")).distinct()
    pairs = accessions.select("acc", "taxid").distinct().join(above.unionByName(own), "taxid")
    return pairs.join(ranks, "ancestor").filter("rank_idx > 0").select("acc", "rank_idx", F.col("ancestor").alias("taxid"))


def lineage_columns(lineage: DataFrame, names: DataFrame, ranks: list[str]) -> DataFrame:
    """``acc`` and the taxon's name at each of *ranks* as a column."""
    named = lineage.join(names, "taxid").filter(F.col("rank_idx").isin([RANK_INDEX[r] for r in ranks]))
    wide = named.groupBy("acc").pivot("rank_idx", [RANK_INDEX[r] for r in ranks]).agg(F.first("name"))
    return wide.select("acc", *[F.col(str(RANK_INDEX[r])).alias(r.replace(" ", "_")) for r in ranks])


def scoped(nodes: DataFrame, names: DataFrame, include: list[str] = (), exclude: list[str] = (), include_ids: list[int] = (), exclude_ids: list[int] = ()) -> DataFrame:
    """``taxid``: nodes below the included ones (all, if none are given), without those below the excluded ones.

    Words are regular expressions on names, or ``rank,word`` for one rank.
    """
    named = nodes.select("taxid", "rank").join(names.select("taxid", "name"), "taxid")

    def chosen(words: list[str], ids: list[int]) -> DataFrame:
        hit = F.col("taxid").isin(list(ids))
        for word in words:
            rank, comma, rest = word.partition(",")
            if comma and rank in RANK_INDEX:
                hit = hit | (rank_index(F.col("rank")) == RANK_INDEX[rank]) & any_word(F.col("name"), [rest])
            else:
                hit = hit | any_word(F.col("name"), [word])
        return named.filter(hit).select("taxid")

    inside = descendants(nodes, chosen(include, include_ids)) if include or include_ids else nodes.select("taxid")
    if exclude or exclude_ids:
        inside = inside.join(descendants(nodes, chosen(exclude, exclude_ids)), "taxid", "left_anti")
    return inside


def with_ancestors(taxids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``taxid``: the given nodes and all their ancestors."""
    above = closure(nodes, taxids).select(F.col("ancestor").alias("taxid"))
    return taxids.select("taxid").unionByName(above).distinct()


def rank_window(taxids: DataFrame, nodes: DataFrame, max_rank: str | None = None, min_rank: str | None = None) -> DataFrame:
    """Without nodes of ranks above *max_rank* and their ancestors, and below *min_rank* and their descendants."""
    ranked = taxids.join(nodes.select("taxid", rank_index(F.col("rank")).alias("rank_idx")), "taxid")
    out = taxids.select("taxid")
    if max_rank is not None:
        high = ranked.filter((F.col("rank_idx") > 0) & (F.col("rank_idx") < RANK_INDEX[max_rank])).select("taxid")
        out = out.join(with_ancestors(high, nodes), "taxid", "left_anti")
    if min_rank is not None:
        low = ranked.filter(F.col("rank_idx") > RANK_INDEX[min_rank]).select("taxid")
        out = out.join(descendants(nodes, low), "taxid", "left_anti")
    return out


def accessions_in(acc_taxid: DataFrame, taxids: DataFrame, drop_refseq: bool = True) -> DataFrame:
    """``acc, taxid`` of the accessions of *taxids*; those with an underscore (RefSeq) go by default."""
    kept = acc_taxid.filter(~F.contains("acc", F.lit("_"))) if drop_refseq else acc_taxid
    return kept.join(taxids.select("taxid"), "taxid", "left_semi").select("acc", "taxid")


def drop_unnamed_species(taxids: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Without species named `` sp.`` unless an ancestor of theirs is among *taxids*."""
    unnamed = taxids.join(nodes.filter("rank = 'species'"), "taxid", "left_semi").join(names.filter(F.contains("name", F.lit(" sp."))), "taxid", "left_semi")
    covered = closure(nodes, unnamed).join(taxids.select(F.col("taxid").alias("ancestor")), "ancestor", "left_semi").select("taxid").distinct()
    return taxids.join(unnamed.join(covered, "taxid", "left_anti"), "taxid", "left_anti")


def nodes_from_lineages(lines: DataFrame, ranks: list[str] | None = None, separator: str = ";") -> DataFrame:
    """``taxid, parent, rank, name, path`` synthesised from ``lineage`` strings.

    An entry is ``rank:name``, or a name of the rank in its place of *ranks*;
    blank entries are passed over.  Every prefix of a lineage is a node; numbers
    follow the order of prefixes, from 2 on, under the root 1.
    """
    parts = F.split("lineage", F.lit(separator))
    place = F.posexplode(parts).alias("place", "entry")
    entries = lines.select("lineage").distinct().select("lineage", place)
    if ranks is None:
        entries = entries.select("lineage", "place", F.substring_index("entry", ":", 1).alias("rank"), F.expr("substring(entry, instr(entry, ':') + 1)").alias("name"))
    else:
        entries = entries.select("lineage", "place", F.get(F.array(*map(F.lit, ranks)), F.col("place")).alias("rank"), F.col("entry").alias("name"))
    entries = entries.filter("name != ''")
    upto = Window.partitionBy("lineage").orderBy("place")
    entries = entries.withColumn("step", F.concat_ws(":", "rank", "name")).withColumn("path", F.array_join(F.collect_list("step").over(upto), ";")).withColumn("above", F.lag("path").over(upto))
    kinds = entries.select("path", "above", "rank", "name").distinct()
    numbered = written(with_places(kinds, [F.col("path")]).withColumn("taxid", 1 + F.col("place")).drop("place"), "lineage-nodes")
    parents = numbered.select(F.col("path").alias("above"), F.col("taxid").alias("parent"))
    return numbered.join(parents, "above", "left").select("taxid", F.coalesce("parent", F.lit(1).cast("long")).alias("parent"), "rank", "name", "path")

