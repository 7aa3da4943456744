"""Hierarchies from lineage strings under append: known paths keep their ids, new ones follow.

A lineage is ``rank:name`` (or ``rank=name``) entries, or names of the ranks in
their places of *ranks*; quotes about an entry's parts go, blank entries are
passed over, and an entry of another form or rank is an error at run time.  A
first entry ``taxid:N`` is an anchor: what follows hangs under the given node N.
A node's path is its anchor and all entries down to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.operators.hierarchy import rank_index
from cubeloom.session import with_places, written

_ANCHOR = r"(?i)^ta?xid[:=](\d+)"
_ENTRY = r'^"?(.+?)"?[:=]"?(.+?)"?$'


def _prefixes(lines: DataFrame, ranks: list[str] | None, separator: str) -> DataFrame:
    """``lineage, place, rank, name, path, above, anchor``: every prefix of each different lineage, places from 0."""
    anchor = F.nullif(F.regexp_extract("lineage", _ANCHOR + rf"(\Q{separator}\E|$)", 1), F.lit(""))
    rest = F.when(anchor.isNull(), F.col("lineage")).otherwise(F.regexp_replace("lineage", _ANCHOR + rf"(\Q{separator}\E|$)", ""))
    # split takes an expression: the separator is quoted as a whole.
    parts = F.posexplode(F.split(rest, rf"\Q{separator}\E"))
    entries = lines.filter("lineage is not null").select("lineage").distinct().withColumn("anchor", anchor).select("lineage", "anchor", parts.alias("place", "entry"))
    entries = entries.withColumn("entry", F.trim("entry")).filter("entry != ''")
    if ranks is None:
        rank, name = F.regexp_extract("entry", _ENTRY, 1), F.regexp_extract("entry", _ENTRY, 2)
    else:
        rank, name = F.coalesce(F.get(F.array(*map(F.lit, ranks)), F.col("place")), F.lit("")), F.regexp_extract("entry", r'^"?(.+?)"?$', 1)
    wrong = (rank_index(rank) == 0) | (name == "")
    entries = entries.withColumn("rank", F.when(wrong, F.raise_error(F.concat(F.lit("not an entry of a lineage: "), "entry"))).otherwise(rank)).withColumn("name", name)
    upto = Window.partitionBy("lineage").orderBy("place")  # a lineage's own entries
    steps = F.collect_list(F.concat_ws(":", "rank", "name")).over(upto)
    path = F.concat_ws(";", F.concat(F.lit("taxid:"), "anchor"), F.array_join(steps, ";"))
    entries = entries.withColumn("path", path)
    return entries.select("lineage", "place", "rank", "name", "path", F.lag("path").over(upto).alias("above"), "anchor")


def appended(lines: DataFrame, known: DataFrame | None = None, ranks: list[str] | None = None, separator: str = ";", floor: int = 1) -> DataFrame:
    """``taxid, parent, rank, name, path``: *known* nodes (the result of an earlier call) and those of *lines* (``lineage``).

    New paths are numbered in their order from one above the largest known id and *floor* (the id of the
    root, or what the ids of given nodes end below).  Appending lineages that are known changes nothing.
    """
    kinds = _prefixes(lines, ranks, separator).select("path", "above", "anchor", "rank", "name").distinct()
    start = floor
    if known is not None:
        known = known.select("taxid", "parent", "rank", "name", "path")
        kinds = kinds.join(known.select("path"), "path", "left_anti")
        start = max(floor, known.agg(F.max("taxid")).first()[0] or 0)
    fresh = written(with_places(kinds, [F.col("path")]).withColumn("taxid", F.col("place") + start).drop("place"), "fresh-nodes")
    ids = fresh.select("path", "taxid") if known is None else fresh.select("path", "taxid").unionByName(known.select("path", "taxid"))
    placed = fresh.join(ids.select(F.col("path").alias("above"), F.col("taxid").alias("over")), "above", "left")
    parent = F.coalesce("over", F.col("anchor").cast("long"), F.lit(1).cast("long"))
    out = placed.select("taxid", parent.alias("parent"), "rank", "name", "path")
    return out if known is None else known.unionByName(out)


def accession(number: Column) -> Column:
    """The accession of a sequence's number: two letters and eight digits; the letters count the hundreds of millions, as the format has it."""
    # Fixed values of the format: blocks of 99,999,999 numbers, but that the first has one more.
    block, place = F.floor(number / 99_999_999).cast("int"), number % 99_999_999
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + F.lit(1), F.lit(1))
    first = number < 100_000_000
    high = F.when(first | (block < 26), F.lit(0)).otherwise(F.floor(block / 26)).cast("int")
    low = F.when(first, F.lit(0)).otherwise(block % 26).cast("int")
    digits = F.lpad(F.when(first, number).otherwise(place).cast("string"), 8, "0")
    return F.when(high > 25, F.raise_error(F.lit("more sequences than accessions"))).otherwise(F.concat(letter(high), letter(low), digits))


def accessions(sequences: DataFrame, nodes: DataFrame, order: list[str], ranks: list[str] | None = None, separator: str = ";", used: int = 0, prefix: str = "") -> DataFrame:
    """*sequences* (``lineage`` and others) with ``acc`` and ``taxid``: numbered from ``used + 1`` on by *order*, at the lowest node of their lineage.

    A lineage that is an anchor only is at the given node; one without entries has a null ``taxid``.
    """
    lowest = _prefixes(sequences, ranks, separator).groupBy("lineage").agg(F.max_by("path", "place").alias("path"))
    at = lowest.join(nodes.select("path", "taxid"), "path").select("lineage", "taxid")
    numbered = with_places(sequences, [F.col(c) for c in order], "__number")
    given = F.nullif(F.regexp_extract("lineage", _ANCHOR + "$", 1), F.lit("")).cast("long")
    acc = F.concat(F.lit(prefix), accession(F.col("__number") + used))
    return numbered.join(at, "lineage", "left").withColumn("taxid", F.coalesce("taxid", given)).withColumn("acc", acc).drop("__number")
