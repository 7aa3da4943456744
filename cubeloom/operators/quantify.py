"""Statistics on cubes: calibration by spike-ins, coverage, rarefaction, word frequencies."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions import draws
from cubeloom.functions.names import sample_part
from cubeloom.session import written


def spike_in_fit(cube: DataFrame, spike_ins: DataFrame, min_r2: float = 0.49) -> DataFrame:
    """``samplename, slope, r2, accepted``: reads against concentration through the origin.

    *spike_ins* is ``samplename, stdname, conc``; a row for the sample beats one
    for its tag, which beats one without a sample.  A sample is accepted with a
    positive slope, an R2 of *min_r2* and reads of every spike-in.
    """
    samples = cube.select("samplename").distinct().withColumn("tag", sample_part(F.col("samplename"), "tag"))
    given = spike_ins.select(F.col("samplename").alias("of"), "stdname", F.col("conc").cast("double").alias("conc"))
    own = samples.join(given.filter("of is not null").withColumnRenamed("of", "samplename"), "samplename").select("samplename", "stdname", "conc", F.lit(1).alias("level"))
    tagged = samples.join(given.filter("of is not null").withColumnRenamed("of", "tag"), "tag").select("samplename", "stdname", "conc", F.lit(2).alias("level"))
    flat = given.filter("of is null").select("stdname", "conc")
    general = cube.select("samplename").distinct().join(flat).withColumn("level", F.lit(3))  # every sample has every spike-in of the design
    best = own.unionByName(tagged).unionByName(general).groupBy("samplename", "stdname").agg(F.min_by("conc", "level").alias("conc"))
    points = best.join(cube.withColumnRenamed("otuname", "stdname"), ["samplename", "stdname"], "left").withColumn("y", F.coalesce("nreads", F.lit(0)).cast("double"))
    sums = points.groupBy("samplename").agg(
        F.sum(F.col("conc") * F.col("y")).alias("xy"), F.sum(F.col("conc") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"), F.min("y").alias("least")
    )
    slope = F.col("xy") / F.nullif("xx", F.lit(0.0))
    r2 = 1 - (F.col("yy") - F.col("slope") * F.col("xy")) / F.nullif("yy", F.lit(0.0))
    fitted = sums.withColumn("slope", slope).withColumn("r2", r2)
    accepted = F.coalesce((F.col("slope") > 0) & (F.col("r2") >= min_r2) & (F.col("least") > 0), F.lit(False))
    return fitted.select("samplename", "slope", "r2", accepted.alias("accepted"))


def absolute_quantities(cube: DataFrame, spike_ins: DataFrame, solution_volumes: DataFrame, water_volumes: DataFrame, min_r2: float = 0.49) -> DataFrame:
    """``samplename, otuname, ncopies``: reads over slope times solution over water volume, without the spike-ins.

    Volumes are ``samplename, volume`` (several rows of a sample add up); a
    sample without an accepted fit or a volume has 0 everywhere.
    """
    fits = spike_in_fit(cube, spike_ins, min_r2).filter("accepted").select("samplename", "slope")
    solution = solution_volumes.groupBy("samplename").agg(F.sum("volume").alias("solution"))
    water = water_volumes.groupBy("samplename").agg(F.sum("volume").alias("water"))
    cells = cube.join(spike_ins.select(F.col("stdname").alias("otuname")).distinct(), "otuname", "left_anti")
    joined = cells.join(fits, "samplename", "left").join(solution, "samplename", "left").join(water, "samplename", "left")
    copies = F.col("nreads") / F.col("slope") * F.col("solution") / F.nullif("water", F.lit(0.0))
    return joined.select("samplename", "otuname", F.coalesce(copies, F.lit(0.0)).alias("ncopies"))


def coverage(cube: DataFrame) -> DataFrame:
    """``samplename, nseq, coverage``: reads, and the coverage ``1 - singletons / reads``."""
    sums = cube.filter("nreads > 0").groupBy("samplename").agg(F.sum("nreads").alias("nseq"), F.count_if(F.col("nreads") == 1).alias("singletons"))
    return sums.select("samplename", "nseq", (1 - F.col("singletons") / F.col("nseq")).alias("coverage"))


def coverage_gate(cube: DataFrame, min_coverage: float = 0.95, coverage_target: float | None = None, min_reads: int = 0) -> DataFrame:
    """``samplename, nseq, coverage, target`` of the samples that stay, and the coverage that they are rarefied to."""
    kept = coverage(cube).filter((F.col("coverage") >= max(min_coverage, coverage_target or 0.0)) & (F.col("nseq") >= min_reads))
    target = F.lit(coverage_target) if coverage_target is not None else F.greatest(F.min("coverage"), F.lit(min_coverage))
    return kept.join(F.broadcast(kept.agg(target.alias("target"))))


def rare_slope(counts: np.ndarray, depth: int) -> float:
    """Expected new items between *depth* and the next read, drawing without replacement."""
    n = int(counts.sum())
    if depth >= n:
        return 0.0

    def log_choose(a: np.ndarray | int, b: int) -> np.ndarray:
        a = np.asarray(a, dtype=float)
        return np.array([math.lgamma(x + 1) - math.lgamma(b + 1) - math.lgamma(x - b + 1) if x >= b else -np.inf for x in np.atleast_1d(a)])

    # An item is first met with the next read if none of its reads were among *depth*: C(n - c, m) / C(n, m) * c / (n - m).
    sizes, times = np.unique(counts, return_counts=True)
    missed = np.exp(log_choose(n - sizes, depth) - log_choose(n, depth))
    return float((times * missed * sizes / (n - depth)).sum())


def target_depth(counts: np.ndarray, target: float) -> int:
    """The depth at which the slope passes ``1 - target``: steps down by a tenth of the reads, then ever finer ones."""
    limit = 1.0 - target - 1e-10
    n = int(counts.sum())
    at, step_share = n - 1, 0.1
    if rare_slope(counts, at) > limit:
        return n
    while True:
        step = max(1, int((n - 1) * step_share + 0.5))
        lower = at - step
        if lower - step > 0 and rare_slope(counts, lower) <= limit:
            at = lower
        elif step == 1:
            return at
        else:
            step_share *= 0.1


def rarefaction_depths(cube: DataFrame, **gate) -> DataFrame:
    """``samplename, depth`` for the samples that pass :func:`coverage_gate`; a sample's counts are one group."""
    cells = cube.filter("nreads > 0").join(coverage_gate(cube, **gate).select("samplename", "target"), "samplename")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"samplename": group.samplename.iloc[:1], "depth": [target_depth(group.nreads.to_numpy(), float(group.target.iloc[0]))]})

    return cells.select("samplename", "nreads", "target").groupBy("samplename").applyInPandas(run, "samplename string, depth long")


def rarefy(cube: DataFrame, depths: DataFrame, replicates: int = 10, seed: int = 0) -> DataFrame:
    """``replicate, samplename, otuname, nreads``: random subsets of a sample's reads without replacement.

    A read is a hash of seed, replicate, sample, item and number; the *depth*
    smallest ones of a sample are drawn, so the draw doesn't depend on partitions.
    Hashes are counted in 4,096 ranges first: only the range in which the depth is
    reached is put in order, so one sample's reads are never sorted in one task.
    """
    reads = cube.filter("nreads > 0").join(depths, "samplename").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("nreads").cast("int"))))
    reads = reads.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draw = F.xxhash64(F.lit(seed), "replicate", "samplename", "otuname", "i")
    # The upper 12 bits in the order of signed numbers.
    reads = reads.withColumn("draw", draw).withColumn("range", F.shiftright("draw", 52))
    key = ["samplename", "replicate"]
    counted = reads.groupBy(*key, "range").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("range")))
    border = counted.filter((F.col("upto") > F.col("depth")) & (F.col("upto") - F.col("n") <= F.col("depth")))
    border = written(border.select(*key, F.col("range").alias("border"), (F.col("depth") - F.col("upto") + F.col("n")).alias("left")), "borders")
    placed = reads.join(border, key, "left").filter("border is null or range <= border")
    cells = ["replicate", "samplename", "otuname"]
    whole = placed.filter("border is null or range < border").groupBy(*cells).agg(F.count("*").alias("nreads"))
    last = placed.filter("range = border").withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("draw", "otuname", "i")))
    part = last.filter(F.col("place") <= F.col("left")).groupBy(*cells).agg(F.count("*").alias("nreads"))
    return whole.unionByName(part).groupBy(*cells).agg(F.sum("nreads").alias("nreads"))


#: Cells that one group of :func:`rarefy_cells` holds.
BLOCK_CELLS = 50_000


def _seeded(*key) -> np.random.Generator:
    digest = hashlib.blake2b("\x1f".join(map(str, key)).encode(), digest_size=16).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


def rarefy_cells(cube: DataFrame, depths: DataFrame, replicates: int = 10, seed: int = 0, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``replicate, samplename, otuname, nreads``: random subsets as of :func:`rarefy`, with work that grows with cells, not reads.

    A sample's reads are split among blocks of about *block_cells* items, and those of a block among its
    items, each time along a tree of halves by hypergeometric draws.  A group is a block, or a sample's
    sums of blocks, so a sample with a third of all cells is many groups.  Draws are seeded by replicate,
    sample and block, items in order of names: they don't depend on partitions.  Cells without reads and
    null names or counts are left out, equal keys are summed, a depth of null or below 0 draws nothing.
    """
    key = ["samplename", "block"]
    cells = cube.filter("nreads > 0 and samplename is not null and otuname is not null").groupBy("samplename", "otuname").agg(F.sum("nreads").alias("nreads"))
    cells = written(cells, "cells")
    wanted = depths.filter("depth > 0").groupBy("samplename").agg(F.min("depth").alias("depth"))
    sizes = cells.groupBy("samplename").agg(F.ceil(F.count("*") / block_cells).alias("blocks")).join(wanted, "samplename")
    blocked = cells.join(sizes, "samplename").withColumn("block", F.pmod(F.xxhash64("otuname"), F.col("blocks")))
    sums = blocked.groupBy(*key).agg(F.sum("nreads").alias("nreads"), F.first("depth").alias("depth"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, borders in _groups(frames, ["samplename"]):
            samples, counts, depths_ = (frame[c].to_numpy() for c in ("samplename", "nreads", "depth"))
            taken = []
            for i, j in borders:
                taken.extend(np.column_stack([draws.split(_seeded(seed, r, samples[i]), counts[i:j], int(depths_[i])) for r in range(1, replicates + 1)]))
            yield frame[key].assign(taken=taken)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, borders in _groups(frames, key):
            samples, blocks, counts, taken = (frame[c].to_numpy() for c in ("samplename", "block", "nreads", "taken"))
            for r in range(1, replicates + 1):
                split = [draws.split(_seeded(seed, r, samples[i], blocks[i]), counts[i:j], int(taken[i][r - 1])) for i, j in borders]
                part = frame[["samplename", "otuname"]].assign(replicate=r, nreads=np.concatenate(split))
                yield part.loc[part["nreads"] > 0, ["replicate", "samplename", "otuname", "nreads"]]

    in_order = lambda df, by, *then: df.repartition(*by).sortWithinPartitions(*by, *then)
    dealt = written(in_order(sums, ["samplename"], "block").mapInPandas(deal, "samplename string, block long, taken array<long>"), "dealt")
    inner = in_order(blocked.select(*key, "otuname", "nreads").join(dealt, key), key, "otuname")
    return inner.mapInPandas(draw, "replicate int, samplename string, otuname string, nreads long")


def _groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows in order of *key*, whole groups at a time, with the first row and the end of each; at most a batch and a group are held."""
    held = None

    def borders(frame: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(frame) - 1, bool)
        for c in key:
            column = frame[c].to_numpy()
            new |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    for frame in frames:
        if not len(frame):
            continue
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        starts = borders(held)
        if len(starts) > 1:
            yield held.iloc[: starts[-1]], list(zip(starts[:-1], starts[1:]))
            held = held.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None:
        yield held, [(0, len(held))]


def rarefied(cube: DataFrame, replicates: int = 10, seed: int = 0, **gate) -> dict[str, DataFrame]:
    """Coverage-based rarefaction as a whole: the draws, and coverage and reads of every sample before and after.

    ``drawn`` (``replicate, samplename, otuname, nreads``), ``input_coverage``, ``input_reads`` (all samples),
    ``output_coverage``, ``output_reads`` (by replicate).
    """
    before = coverage(cube)
    drawn = written(rarefy_cells(cube, rarefaction_depths(cube, **gate), replicates, seed), "drawn")
    keyed = drawn.withColumn("samplename", F.concat_ws("\x1f", F.col("replicate").cast("string"), "samplename"))
    part = lambda i: F.split_part("samplename", F.lit("\x1f"), F.lit(i))
    after = coverage(keyed).select(part(1).cast("int").alias("replicate"), part(2).alias("samplename"), "nseq", "coverage")
    return {
        "drawn": drawn,
        "input_coverage": before.select("samplename", "coverage"),
        "input_reads": before.select("samplename", "nseq"),
        "output_coverage": after.select("replicate", "samplename", "coverage"),
        "output_reads": after.select("replicate", "samplename", "nseq"),
    }


def word_frequencies(cube: DataFrame, log_scale: bool = False) -> DataFrame:
    """``samplename, name, freq``: counts scaled to 20 for the largest of a sample, rounded, zeros left out."""
    largest = F.max("nreads").over(Window.partitionBy("samplename"))
    scaled = F.log(F.col("nreads") * math.exp(20) / largest) if log_scale else F.col("nreads") * 20 / largest
    name = F.regexp_replace("otuname", "^unidentified ", "")
    return cube.select("samplename", name.alias("name"), F.floor(scaled + 0.5).cast("double").alias("freq")).filter("freq > 0")


def with_dummy_word(words: DataFrame) -> DataFrame:
    """A dummy word of hardly any weight added to each sample."""
    dummy = words.select("samplename").distinct().select("samplename", F.lit("dummy").alias("name"), F.lit(0.00001).alias("freq"))
    return words.unionByName(dummy)

