"""Assignments of queries to taxa: consensus of neighbours, merging, filling of blanks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.names import any_word
from cubeloom.operators.hierarchy import closure, rank_index
from cubeloom.schemas import RANK_INDEX, RANKS
from cubeloom.session import written


def _visible(lineage: DataFrame, names: DataFrame | None, hidden: list[str]) -> DataFrame:
    """*lineage* without the taxa that count as unidentified (regular expressions, or ``rank,expression``)."""
    if not hidden:
        return lineage
    named = lineage.join(names, "taxid", "left")
    hit = F.lit(False)
    for word in hidden:
        rank, comma, rest = word.partition(",")
        if comma and rank in RANK_INDEX:
            hit = hit | (F.col("rank_idx") == RANK_INDEX[rank]) & F.coalesce(F.col("name").rlike(rest), F.lit(False))
        else:
            hit = hit | F.coalesce(F.col("name").rlike(word), F.lit(False))
    return named.filter(~hit).select("acc", "rank_idx", "taxid")


def votes(
    neighbours: DataFrame, lineage: DataFrame, nodes: DataFrame, names: DataFrame | None = None, hide_lower: list[str] = (), hide_upper: list[str] = (), tree: DataFrame | None = None
) -> DataFrame:
    """``query, rank_idx, taxid, votes, opposers, unidentified, n``: the most voted taxon of every rank.

    At a rank a neighbour votes with its taxon there, else with its first one
    at a deeper rank.  One with neither is pending; it opposes if its first
    taxon at a shallower rank isn't the winner's nearest ancestor that isn't
    deeper than that rank (an unranked ancestor on the way ends the comparison).
    Ranks at which no neighbour has a taxon can't differ from the next deeper
    one and are left out.  Ties go to the smaller taxid.  *tree* is the closure of *nodes*, if at hand.
    """
    pairs = written(neighbours.select("query", "acc").distinct(), "neighbours")
    sizes = pairs.groupBy("query").agg(F.count("*").alias("n"))
    lower = pairs.join(_visible(lineage, names, list(hide_lower)), "acc").select("query", "acc", "rank_idx", "taxid")
    upper = pairs.join(_visible(lineage, names, list(hide_upper)), "acc").select("query", "acc", F.col("rank_idx").alias("at"), F.col("taxid").alias("value"))
    ranks = lower.select("query", "rank_idx").distinct()
    # The vote at a rank: the neighbour's first visible taxon from there on down.
    cast = (
        lower.withColumnRenamed("rank_idx", "at")
        .join(ranks, "query")
        .filter("at >= rank_idx")
        .groupBy("query", "rank_idx", "acc")
        .agg(F.min(F.struct("at", "taxid")).alias("vote"))
        .select("query", "rank_idx", "acc", F.col("vote.taxid").alias("taxid"))
    )
    counted = cast.groupBy("query", "rank_idx", "taxid").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("query", "rank_idx").orderBy(F.desc("votes"), "taxid")
    winners = counted.withColumn("all", F.sum("votes").over(Window.partitionBy("query", "rank_idx"))).withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
    winners = written(winners, "winners")  # the walk up from them would repeat the votes
    # Pending neighbours: all that cast no vote, with their first visible taxon further up.
    pending = pairs.join(winners.select("query", "rank_idx", F.col("taxid").alias("winner")), "query").join(cast.select("query", "rank_idx", "acc"), ["query", "rank_idx", "acc"], "left_anti")
    first = (
        pending.join(upper, ["query", "acc"])
        .filter("at < rank_idx")
        .groupBy("query", "rank_idx", "acc", "winner")
        .agg(F.max(F.struct("at", "value")).alias("up"))
        .select("query", "rank_idx", "acc", "winner", F.col("up.at").alias("at"), F.col("up.value").alias("value"))
    )
    ranked = nodes.select(F.col("taxid").alias("ancestor"), rank_index(F.col("rank")).alias("ancestor_rank"))
    tree = closure(nodes, winners.select("taxid").distinct()) if tree is None else tree.join(winners.select("taxid").distinct(), "taxid", "left_semi")
    above = tree.join(ranked, "ancestor")
    nearest = above.filter("ancestor_rank > 0").groupBy("taxid").agg(F.min("depth").alias("from_depth"))
    above = above.join(nearest, "taxid").filter("depth >= from_depth").select(F.col("taxid").alias("winner"), "ancestor", "ancestor_rank", "depth")
    compared = (
        first.join(above, "winner")
        .groupBy("query", "rank_idx", "acc", "value")
        .agg(
            F.min(F.when(F.col("ancestor_rank") <= F.col("at"), F.struct("depth", "ancestor", "ancestor_rank"))).alias("stop"),
            F.max(F.struct("depth", "ancestor", "ancestor_rank")).alias("top"),
        )
        .select("query", "rank_idx", "value", F.coalesce("stop", "top").alias("met"))
        .filter("met.ancestor_rank > 0 and met.ancestor != value")
    )
    opposed = compared.groupBy("query", "rank_idx").agg(F.count("*").alias("pending_opposers"))
    joined = winners.join(opposed, ["query", "rank_idx"], "left").join(sizes, "query")
    opposers = F.col("all") - F.col("votes") + F.coalesce("pending_opposers", F.lit(0))
    return joined.select("query", "rank_idx", "taxid", "votes", opposers.alias("opposers"), (F.col("n") - F.col("votes") - opposers).alias("unidentified"), "n")


def support(voted: DataFrame, names: DataFrame) -> DataFrame:
    """``query, rank_idx, support``: ``name: votes:opposers:unidentified/n`` of every rank's most voted taxon."""
    text = F.concat("name", F.lit(": "), F.concat_ws(":", *[F.col(c).cast("string") for c in ("votes", "opposers", "unidentified")]), F.lit("/"), F.col("n").cast("string"))
    return voted.join(names, "taxid").select("query", "rank_idx", text.alias("support"))


def consensus(voted: DataFrame, nodes: DataFrame, max_opposer_share: float = 0.0, max_unidentified_share: float = 0.0, min_supporters: int = 2, min_ratio: float = 10.0, tree: DataFrame | None = None) -> DataFrame:
    """``query, rank_idx, taxid``: the deepest acceptable winner of each query and its ranked ancestors."""
    ok = (
        (F.col("opposers") / F.col("n") <= max_opposer_share)
        & (F.col("unidentified") / F.col("n") <= max_unidentified_share)
        & (F.col("votes") >= min_supporters)
        & ((F.col("opposers") == 0) | (F.col("votes") / F.col("opposers") >= min_ratio))
    )
    best = voted.filter(ok).groupBy("query").agg(F.max(F.struct("rank_idx", "taxid")).alias("best")).select("query", "best.rank_idx", "best.taxid")
    best = written(best, "consensus")
    ranked = nodes.select(F.col("taxid").alias("ancestor"), rank_index(F.col("rank")).alias("rank_idx")).filter("rank_idx > 0")
    tree = closure(nodes, best.select("taxid").distinct()) if tree is None else tree
    above = best.drop("rank_idx").join(tree, "taxid").join(ranked, "ancestor")
    filled = above.select("query", "rank_idx", F.col("ancestor").alias("taxid"))
    # An ancestor of the winner's own rank takes its place, as the fill comes last.
    return best.join(filled.select("query", "rank_idx"), ["query", "rank_idx"], "left_anti").select("query", "rank_idx", "taxid").unionByName(filled)


def named_assignment(assigned: DataFrame, names: DataFrame, style: str = "name") -> DataFrame:
    """``query, rank_idx, taxon`` with the taxon as ``name``, ``id`` or ``both``."""
    shown = {"name": F.col("name"), "id": F.col("taxid").cast("string"), "both": F.concat("name", F.lit(" ("), F.col("taxid").cast("string"), F.lit(")"))}
    if style not in shown:
        raise ValueError(f"style must be one of {sorted(shown)}")
    return assigned.join(names, "taxid").select("query", "rank_idx", shown[style].alias("taxon"))


def priorities(rule: str, n: int) -> list[int]:
    """The priority of each of *n* tables: ``equal``, ``ascend``, ``descend``, or an order such as ``2>0=1``."""
    if rule == "equal":
        return [0] * n
    if rule == "ascend":
        return list(range(n))
    if rule == "descend":
        return list(range(n))[::-1]
    tokens = re.findall(r"\d+|[<>=]", rule)
    tables, signs = [int(t) for t in tokens[::2]], tokens[1::2]
    if "".join(tokens) != rule.replace(" ", "") or sorted(tables) != list(range(n)) or {"<", ">"} <= set(signs):
        raise ValueError(f"can't read the priority {rule!r}")
    levels = [0]
    for sign in signs:
        levels.append(levels[-1] + {"=": 0, "<": 1, ">": -1}[sign])
    return [level - min(levels) for _, level in sorted(zip(tables, levels))]


def merge_assignments(tables: list[DataFrame], rule: str = "equal", prefer_lower: bool = False, queries: list[DataFrame] | None = None) -> DataFrame:
    """``query, rank_idx, taxon, source`` of assignments (``query, rank_idx, taxon``) merged by priority.

    Tables are taken from the highest priority on, each from shallow to deep
    ranks.  A taxon beyond the result's depth is taken.  One that differs from the
    result's ends the table's turn, and if both have the same priority also cuts
    the result there.  With *prefer_lower* a table that reaches deeper than the
    result replaces it.  A query's cells, ranks times tables at most, are folded
    as one array.  With *queries* (``query``, a list for each table) a query that not all of them have is an error.
    """
    level = priorities(rule, len(tables))
    order = sorted(range(len(tables)), key=lambda i: (-level[i], i))
    cells = None
    for turn, i in enumerate(order):
        part = tables[i].filter("taxon is not null and taxon != ''").select("query", F.struct(F.lit(turn).alias("turn"), F.col("rank_idx").cast("int").alias("rank"), "taxon", F.lit(level[i]).alias("level"), F.lit(i).alias("source")).alias("cell"))
        cells = part if cells is None else cells.unionByName(part)
    per_query = cells.groupBy("query").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    folded = per_query.select("query", F.expr(_merge_fold(prefer_lower)).alias("result"))
    if queries is not None:
        folded = _in_all(queries).join(folded, "query", "left")
    return folded.select("query", F.explode("result").alias("x")).select("query", F.col("x.rank").alias("rank_idx"), "x.taxon", "x.source")


def _in_all(queries: list[DataFrame]) -> DataFrame:
    """``query`` of lists that must be the same; one that a list lacks is an error at run time."""
    every = None
    for i, listed in enumerate(queries):
        part = listed.select("query", F.lit(i).alias("list"))
        every = part if every is None else every.unionByName(part)
    counted = every.groupBy("query").agg(F.count_distinct("list").alias("lists"))
    lacks = F.raise_error(F.concat(F.lit("not in all tables: "), "query"))
    return counted.select(F.when(F.col("lists") < len(queries), lacks).otherwise(F.col("query")).alias("query"))


def shown_sources(merged: DataFrame, names: list[str]) -> DataFrame:
    """A merged assignment with each taxon as ``taxon (table)``."""
    table = F.get(F.array(*map(F.lit, names)), F.col("source"))
    return merged.select("query", "rank_idx", F.concat("taxon", F.lit(" ("), table, F.lit(")")).alias("taxon"))


def lowest_sources(merged: DataFrame, names: list[str]) -> DataFrame:
    """``query, source``: the table that gave each query's deepest taxon."""
    deepest = merged.groupBy("query").agg(F.max(F.struct("rank_idx", "source")).alias("x"))
    return deepest.select("query", F.get(F.array(*map(F.lit, names)), F.col("x.source")).alias("source"))


def _merge_fold(prefer_lower: bool) -> str:
    """The fold of ordered cells; the state is the result so far, the turn that has ended, and the turn begun."""
    row = "struct<turn:int,rank:int,taxon:string,level:int,source:int>"
    deepest = "coalesce(array_max(transform(s.kept, k -> k.rank)), -1)"
    table_depth = "array_max(transform(filter(cells, q -> q.turn = c.turn), q -> q.rank))"
    fresh = f"(c.turn != s.begun AND {table_depth} > {deepest})" if prefer_lower else "false"
    kept = f"if({fresh}, CAST(array() AS array<{row}>), s.kept)"
    clash = f"exists({kept}, k -> k.rank = c.rank AND k.taxon != c.taxon)"
    tie = f"exists({kept}, k -> k.rank = c.rank AND k.taxon != c.taxon AND k.level = c.level)"
    depth = f"coalesce(array_max(transform({kept}, k -> k.rank)), -1)"
    return f"""aggregate(cells, named_struct('kept', CAST(array() AS array<{row}>), 'ended', -1, 'begun', -1),
      (s, c) -> CASE WHEN s.ended = c.turn THEN s
        WHEN {clash} AND {tie} THEN named_struct('kept', filter({kept}, k -> k.rank < c.rank), 'ended', c.turn, 'begun', c.turn)
        WHEN {clash} THEN named_struct('kept', {kept}, 'ended', c.turn, 'begun', c.turn)
        WHEN c.rank > {depth} THEN named_struct('kept', concat({kept}, array(c)), 'ended', s.ended, 'begun', c.turn)
        ELSE named_struct('kept', {kept}, 'ended', s.ended, 'begun', c.turn) END,
      s -> s.kept)"""


def fill_blanks(wide: DataFrame, ranks: list[str], full: bool = False) -> DataFrame:
    """Blanks of a wide assignment (``query`` and *ranks*, shallow to deep) filled.

    A blank takes the next deeper taxon; one below all taxa becomes
    ``unidentified`` and the deepest taxon.  *full* first adds all ranks.
    """
    order = sorted(ranks, key=RANK_INDEX.get)
    columns = list(RANKS[1:]) if full else order
    value = {r: F.nullif(F.col(f"`{r}`"), F.lit("")) if r in order else F.lit(None).cast("string") for r in columns}
    out = []
    for i, rank in enumerate(columns):
        deeper = F.coalesce(*[value[r] for r in columns[i:]])
        last = F.coalesce(*[value[r] for r in columns[:i][::-1]]) if i else F.lit(None).cast("string")
        out.append(F.coalesce(deeper, F.concat(F.lit("unidentified "), last)).alias(rank))
    return wide.select("query", *out)


def matching_queries(assigned: DataFrame, words: list[str]) -> DataFrame:
    """``query`` of assignments with a taxon that matches one of *words*."""
    return assigned.filter(any_word(F.col("taxon"), words)).select("query").distinct()
