"""Cube filters: samples, items, taxa, support, replicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.names import any_word
from cubeloom.schemas import RANK_INDEX
from cubeloom.session import with_places, written


def by_list(cube: DataFrame, names: DataFrame, column: str, keep: bool = True) -> DataFrame:
    """Rows whose *column* is (or with ``keep=False`` isn't) in the first column of *names*."""
    listed = names.select(F.col(names.columns[0]).alias(column)).distinct()
    return cube.join(listed, column, "left_semi" if keep else "left_anti")


def by_words(cube: DataFrame, words: list[str], column: str, keep: bool = True) -> DataFrame:
    """Rows whose *column* matches (or doesn't match) one of *words*, regular expressions in any case."""
    found = any_word(F.col(column), words)
    return cube.filter(found if keep else ~found)


def keep_items_with_zeros(cube: DataFrame, items: DataFrame) -> DataFrame:
    """The listed items; one that has no cell at all gets a row without a sample and with 0 reads."""
    listed = items.select(F.col(items.columns[0]).alias("otuname")).distinct()
    return listed.join(cube, "otuname", "left").select("samplename", "otuname", F.coalesce("nreads", F.lit(0)).alias("nreads"))


def _taxon_words(words: list[str]) -> Column:
    """Whether an assignment row matches: ``word``, or ``rank,word`` for one rank only."""
    found: list[Column] = []
    for word in words:
        rank, comma, rest = word.partition(",")
        if comma and rank in RANK_INDEX:
            found.append((F.col("rank_idx") == RANK_INDEX[rank]) & any_word(F.col("taxon"), [rest]))
        else:
            found.append(any_word(F.col("taxon"), [word]))
    return reduce(Column.__or__, found, F.lit(False))


def by_taxa(cube: DataFrame, assignment: DataFrame, words: list[str], include: bool = True) -> DataFrame:
    """Items with (or without) a taxon that matches one of *words* at any rank; *assignment* is ``query, rank_idx, taxon``."""
    items = assignment.filter(_taxon_words(words)).select(F.col("query").alias("otuname")).distinct()
    return cube.join(items, "otuname", "left_semi" if include else "left_anti")


def support_round(
    cube: DataFrame,
    min_item: int = 0,
    min_item_share: float = 0.0,
    min_sample: int = 0,
    min_sample_share: float = 0.0,
    min_item_total: int = 0,
    min_sample_total: int = 0,
) -> DataFrame:
    """One round of the support filter.

    An item stays if one of its cells has ``min_item`` reads and that share of
    the item's total, and the total is enough; a sample likewise.
    """
    # Number and share grow with the reads of a cell, so a key's largest cell decides for all.
    most, total = F.col("most"), F.col("total")
    sums = lambda key: cube.groupBy(key).agg(F.max("nreads").alias("most"), F.sum("nreads").alias("total"))
    keep_items = sums("otuname").filter((most >= min_item) & (most / total >= min_item_share) & (total >= min_item_total)).select("otuname")
    keep_samples = sums("samplename").filter((most >= min_sample) & (most / total >= min_sample_share) & (total >= min_sample_total)).select("samplename")
    return cube.join(keep_items, "otuname", "left_semi").join(keep_samples, "samplename", "left_semi")


def support_filter(cube: DataFrame, **limits) -> DataFrame:
    """Rounds of :func:`support_round` until one removes nothing; each round is a written table."""
    now = written(cube.filter("nreads > 0"), "support")
    size = now.count()
    while True:
        now = written(support_round(now, **limits), "support")
        left = now.count()
        if left == size:
            return now
        size = left


def replicate_elimination(
    cube: DataFrame, replicates: DataFrame, min_replicates: int = 2, min_replicate_share: float = 1.0, min_positive: int = 1, min_positive_share: float = 0.0
) -> DataFrame:
    """Without items that their samples' replicates (``child, parent``) don't agree on.

    Within a parent, an item in too few replicates adds its reads there to its
    inconsistent reads; items with enough of those, in number and share, go.
    """
    sizes = replicates.groupBy("parent").agg(F.countDistinct("child").alias("of"))
    cells = cube.join(replicates.select(F.col("child").alias("samplename"), "parent").distinct(), "samplename")
    inner = cells.groupBy("parent", "otuname").agg(F.countDistinct("samplename").alias("found"), F.sum("nreads").alias("reads")).join(sizes, "parent")
    odd = inner.filter((F.col("found") < min_replicates) | (F.col("found") / F.col("of") < min_replicate_share)).groupBy("otuname").agg(F.sum("reads").alias("odd_reads"))
    totals = cube.groupBy("otuname").agg(F.sum("nreads").alias("total"))
    gone = odd.join(totals, "otuname").filter((F.col("odd_reads") >= min_positive) & (F.col("odd_reads") / F.col("total") >= min_positive_share))
    return cube.join(gone.select("otuname"), "otuname", "left_anti")


def representatives(cube: DataFrame, assignment: DataFrame, top_n: int | None = None) -> DataFrame:
    """``taxon, otuname``: per taxon the item with the largest cell, then the largest total, then the first name.

    With *top_n* only the taxa of the largest totals.
    """
    sums = cube.groupBy("otuname").agg(F.max("nreads").alias("most"), F.sum("nreads").alias("total"))
    named = sums.join(assignment.select(F.col("query").alias("otuname"), "taxon").filter("taxon is not null and taxon != ''"), "otuname")
    best = named.withColumn("place", F.row_number().over(Window.partitionBy("taxon").orderBy(F.desc("most"), F.desc("total"), "otuname")))
    chosen = best.filter("place = 1").select("taxon", "otuname")
    if top_n is None:
        return chosen
    largest = named.groupBy("taxon").agg(F.sum("total").alias("total")).orderBy(F.desc("total"), "taxon").limit(top_n)
    return chosen.join(largest.select("taxon"), "taxon", "left_semi")


def named_representatives(chosen: DataFrame, style: str = "numbered") -> DataFrame:
    """Representatives (``taxon, otuname``) with their ``name``: the ``taxon``, ``item`` and taxon, or ``numbered`` taxa (``NN_taxon``, by order of taxa)."""
    if style == "taxon":
        return chosen.withColumn("name", F.col("taxon"))
    if style == "item":
        return chosen.withColumn("name", F.concat_ws(":", "otuname", "taxon"))
    if style != "numbered":
        raise ValueError("style must be taxon, item or numbered")
    placed = with_places(chosen, [F.col("taxon")])
    width = len(str(placed.count()))
    return placed.withColumn("name", F.concat_ws("_", F.lpad(F.col("place").cast("string"), width, "0"), "taxon")).drop("place")


def with_checked_totals(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """Sequences (``name, size``) whose size is the number of their members (``otuname``); another number is an error."""
    counted = members.groupBy(F.col("otuname").alias("name")).agg(F.count("*").alias("__n"))
    differs = F.raise_error(F.concat(F.lit("members don't add up: "), "name"))
    checked = sequences.join(counted, "name", "full").withColumn("size", F.when(F.col("size").eqNullSafe(F.col("__n")), F.col("size")).otherwise(differs))
    return checked.select(*sequences.columns)


def members_in(members: DataFrame, cube: DataFrame) -> DataFrame:
    """Members (``otuname, samplename, …``) of the cells that a filtered cube still has."""
    return members.join(cube.select("samplename", "otuname"), ["samplename", "otuname"], "left_semi")


def with_sequences(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """Members (``otuname, ...``) with the sequence (``name, seq``) of their item; an item without members or without a sequence is an error."""
    listed = members.withColumn("__member", F.lit(True)).join(sequences.select(F.col("name").alias("otuname"), "seq"), "otuname", "full")
    gone = F.when(F.col("__member").isNull(), F.concat(F.lit("no member of "), "otuname")).when(F.col("seq").isNull(), F.concat(F.lit("no sequence of "), "otuname"))
    checked = F.when(gone.isNotNull(), F.raise_error(gone)).otherwise(F.col("seq"))
    return listed.select(*members.columns, checked.alias("seq"))


def accession_forms(name: Column) -> Column:
    """The forms in which a list may name a sequence: its whole name, its first token, the accession in ``db|ACC``."""
    token = F.regexp_extract(name, r"^\s*(\S+)", 1)
    return F.array_distinct(F.array(name, token, F.regexp_extract(token, r"([A-Za-z0-9_]+)\|?$", 1)))


def without_listed(sequences: DataFrame, negatives: DataFrame) -> DataFrame:
    """Sequences (``name``) that *negatives* (its first column) has in none of their :func:`accession_forms`."""
    listed = negatives.select(F.col(negatives.columns[0]).alias("form")).distinct()
    hit = sequences.select("name", F.explode(accession_forms(F.col("name"))).alias("form")).join(listed, "form", "left_semi").select("name").distinct()
    return sequences.join(hit, "name", "left_anti")


def around_ignored(rows: DataFrame, ignored: DataFrame, work, column: str = "name") -> DataFrame:
    """What *work* makes of the rows that *ignored* (its first column) doesn't list, and the listed ones as they are.

    *work* returns the same columns.
    """
    listed = ignored.select(F.col(ignored.columns[0]).alias(column)).distinct()
    done = work(rows.join(listed, column, "left_anti"))
    return done.select(*rows.columns).unionByName(rows.join(listed, column, "left_semi").select(*rows.columns))


def unnamed_numbered(shards: list[DataFrame], prefix: str = "temp_") -> DataFrame:
    """``shard, name, number``: the names of several tables (``name``) in one, each with a name of its own by table and order."""
    every = None
    for i, shard in enumerate(shards):
        part = shard.select(F.lit(i).alias("shard"), "name")
        every = part if every is None else every.unionByName(part)
    placed = with_places(every, [F.col("shard"), F.col("name")])
    return placed.select("shard", "name", F.concat(F.lit(prefix), (F.col("place") - 1).cast("string")).alias("number"))
