"""Count cubes: building, folding, roll-up, top-N, ordering, layouts.

A cube is a long table ``samplename, otuname, nreads`` without zero cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.names import checked_sample, sample_of_read, sample_part, with_run
from cubeloom.session import with_places

KEYS = ["samplename", "otuname"]


def summed(cube: DataFrame, shares: int | None = None) -> DataFrame:
    """Cells of equal keys as one.

    Where keys hardly meet, summing before the shuffle holds nearly all cells of a task: with *shares* they are dealt to so many partitions first.
    """
    cube = cube.repartition(shares, *KEYS) if shares else cube
    return cube.groupBy(*KEYS).agg(F.sum("nreads").alias("nreads"))


def from_membership(members: DataFrame, runname: str | None = None) -> DataFrame:
    """Reads per sample and item from ``otuname, readname``; a read without a three-part sample is an error."""
    sample = checked_sample(sample_of_read(F.col("readname")))
    sample = with_run(sample, runname) if runname else sample
    return members.select(sample.alias("samplename"), "otuname").groupBy(*KEYS).agg(F.count("*").alias("nreads"))


def with_rows(cube: DataFrame, more: DataFrame) -> DataFrame:
    """The cube with the cells of a second one, such as that of the spike-ins, cells that meet being summed."""
    return summed(cube.select(*KEYS, "nreads").unionByName(more.select(*KEYS, "nreads")))


def rename_run(cube: DataFrame, runname: str) -> DataFrame:
    """Samples under another run name; cells that meet are summed."""
    return summed(cube.withColumn("samplename", with_run(F.col("samplename"), runname)))


def fold_replicates(cube: DataFrame, replicates: DataFrame) -> DataFrame:
    """Samples as their parents by ``child, parent``: by the full name first, else by the tag in it."""
    full = replicates.select(F.col("child").alias("samplename"), F.col("parent").alias("by_name"))
    tags = replicates.select(F.col("child").alias("tag"), F.col("parent").alias("by_tag"))
    joined = cube.withColumn("tag", sample_part(F.col("samplename"), "tag")).join(full, "samplename", "left").join(tags, "tag", "left")
    tagged = F.concat_ws("__", sample_part(F.col("samplename"), "run"), F.col("by_tag"), sample_part(F.col("samplename"), "primer"))
    parent = F.coalesce("by_name", F.when(F.col("by_tag").isNotNull(), tagged), "samplename")
    return summed(joined.select(parent.alias("samplename"), "otuname", "nreads"))


def roll_up(cube: DataFrame, assignment: DataFrame, fuse: bool = True, shares: int | None = None) -> DataFrame:
    """Items as their taxa by ``query, taxon`` (blank or missing: the item's own name), or ``item:taxon`` without *fuse*; *shares* as in :func:`summed`."""
    taxa = assignment.select(F.col("query").alias("otuname"), F.nullif("taxon", F.lit("")).alias("taxon"))
    taxon = F.col("taxon") if fuse else F.concat_ws(":", "otuname", "taxon")
    joined = cube.join(taxa, "otuname", "left")
    name = F.when(F.col("taxon").isNull(), F.col("otuname")).otherwise(taxon)
    return summed(joined.select("samplename", name.alias("otuname"), "nreads"), shares)


def item_totals(cube: DataFrame) -> DataFrame:
    return cube.groupBy("otuname").agg(F.sum("nreads").alias("total"))


def top_items(cube: DataFrame, n: int, others: str = "others") -> DataFrame:
    """The *n* items of the largest totals (then by name), the rest summed as *others*."""
    best = item_totals(cube).orderBy(F.desc("total"), "otuname").limit(n).select("otuname", F.lit(True).alias("best"))
    joined = cube.join(best, "otuname", "left")
    name = F.when(F.col("best"), F.col("otuname")).otherwise(others)
    return summed(joined.select("samplename", name.alias("otuname"), "nreads"))


def ordered_items(cube: DataFrame, sort_taxon: DataFrame | None = None) -> DataFrame:
    """``otuname, total, place``: items by total, or by ``query, taxon`` of a rank first."""
    totals = item_totals(cube)
    order: list[Column] = [F.desc("total"), F.col("otuname")]
    if sort_taxon is not None:
        totals = totals.join(sort_taxon.select(F.col("query").alias("otuname"), "taxon"), "otuname", "left").withColumn("taxon", F.coalesce(F.nullif("taxon", F.lit("")), "otuname"))
        order.insert(0, F.col("taxon"))
    return with_places(totals, order).select("otuname", "total", "place")


def numbered_items(cube: DataFrame, sort_taxon: DataFrame | None = None) -> DataFrame:
    """The cube with items named ``NN:name`` by their place, padded to the longest number."""
    places = ordered_items(cube, sort_taxon)
    width = len(str(places.agg(F.max("place")).first()[0]))
    names = places.select("otuname", F.concat_ws(":", F.lpad(F.col("place").cast("string"), width, "0"), "otuname").alias("numbered"))
    return cube.join(names, "otuname").select("samplename", F.col("numbered").alias("otuname"), "nreads")


def sample_places(cube: DataFrame) -> DataFrame:
    """The cube with each item's place within its sample, by count, then name."""
    order = Window.partitionBy("samplename").orderBy(F.desc("nreads"), "otuname")
    return cube.withColumn("place", F.row_number().over(order).cast("long"))


def shares(cube: DataFrame) -> DataFrame:
    """The cube with item and sample totals, and each cell's share of either."""
    items = item_totals(cube).withColumnRenamed("total", "item_total")
    samples = cube.groupBy("samplename").agg(F.sum("nreads").alias("sample_total"))
    joined = cube.join(items, "otuname").join(samples, "samplename")
    return joined.withColumn("item_share", F.col("nreads") / F.col("item_total")).withColumn("sample_share", F.col("nreads") / F.col("sample_total"))


def item_names(cube: DataFrame) -> list[str]:
    """The items in order, for the columns of a matrix (a matrix can't have more than fit a schema)."""
    return [r[0] for r in cube.select("otuname").distinct().orderBy("otuname").collect()]


def to_matrix(cube: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per sample, one column per item, absent cells 0."""
    names = item_names(cube) if names is None else names
    return cube.groupBy("samplename").pivot("otuname", names).agg(F.sum("nreads")).na.fill(0)


def from_matrix(matrix: DataFrame) -> DataFrame:
    """A matrix as a cube; repeated samples are summed, zeros left out."""
    items = [f"`{c}`" for c in matrix.columns if c != "samplename"]
    long = matrix.unpivot("samplename", items, "otuname", "nreads")
    return summed(long.filter("nreads != 0"))


def dense(cube: DataFrame) -> DataFrame:
    """All cells of a cube, absent ones as 0: the product of its two key lists is the result itself."""
    every = cube.select("samplename").distinct().join(cube.select("otuname").distinct())
    return every.join(cube, KEYS, "left").select(*KEYS, F.coalesce("nreads", F.lit(0).cast("long")).alias("nreads"))
