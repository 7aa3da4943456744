"""Rates of tag jumps, determined together by all blanks of a plate.

A blank's reads of an item are the item's reads in the samples with the same
forward tag times that tag's rate, and those with the same reverse tag times that
one's: one equation for each blank and item.  Spark sums the normal equations by
blank; what is left grows with the design, and is solved plate by plate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators.decontam import tag_sums


def equations(cube: DataFrame, samples: DataFrame, blanks: DataFrame) -> DataFrame:
    """``samplename, rr, rf, ff, rn, fn, nn``: sums over items of products of a blank's own reads (n) and those beside it by either way (r, f).

    *samples* is ``samplename, forward, reverse``; a blank without a row there, or without any reads in and beside it, gives none.
    """
    listed = blanks.select("samplename").distinct()
    zero = F.lit(0).cast("long")
    beside = tag_sums(cube, samples.select("samplename", "forward", "reverse").distinct(), listed).select(
        "samplename", "otuname", F.when(F.col("jump") == "reversejump", F.col("nreads")).otherwise(zero).alias("r"), F.when(F.col("jump") == "forwardjump", F.col("nreads")).otherwise(zero).alias("f"), zero.alias("n")
    )
    own = cube.join(listed, "samplename", "left_semi").join(samples.select("samplename").distinct(), "samplename", "left_semi").select("samplename", "otuname", zero.alias("r"), zero.alias("f"), F.col("nreads").alias("n"))
    cells = beside.unionByName(own).groupBy("samplename", "otuname").agg(*[F.sum(c).alias(c) for c in "rfn"])
    return cells.groupBy("samplename").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("rr", "rf", "ff", "rn", "fn", "nn")])


def bounded_least_squares(gram: np.ndarray, right: np.ndarray, limit: float, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """The least ``x gram x - 2 right x`` with each x from 0 to *limit*, and which x it determines.

    Coordinates are set to their best value in turn until none moves.  A coordinate that a null direction of
    *gram* touches isn't determined.
    """
    scale = np.sqrt(np.diag(gram))
    live = scale > 0
    unit = np.where(live, scale, 1.0)
    a, b = gram / np.outer(unit, unit), right / unit
    bound, x = limit * unit, np.zeros(len(right))
    for _ in range(100_000):
        moved = 0.0
        for i in np.flatnonzero(live):
            best = min(max(b[i] - a[i] @ x + a[i, i] * x[i], 0.0), bound[i])
            moved, x[i] = max(moved, abs(best - x[i]) / unit[i]), best
        if moved <= tolerance:
            break
    values, vectors = np.linalg.eigh(a)
    null = vectors[:, values < 1e-9 * max(values.max(initial=0.0), 1e-300)]
    return x / unit, live & (np.linalg.norm(null, axis=1) < 1e-6)


def joint_rates(cube: DataFrame, samples: DataFrame, blanks: DataFrame, limit: float = 0.1) -> DataFrame:
    """``samplename, reverse_rate, forward_rate, reverse_jump, forward_jump, residual`` of each blank with equations.

    ``reverse_rate`` belongs to the blank's forward tag and ``forward_rate`` to its reverse tag: all blanks of
    a plate (the run in their names) with that tag share it.  They count against the reads that stayed, as the
    jump test takes them; ``..._jump`` are shares of all reads, ``rate / (1 + both rates)``.  What the blanks don't
    determine is null, and so are both jumps then.  ``residual`` is the sum of squares that is left of the blank.
    """
    rows = equations(cube, samples, blanks).join(samples.select("samplename", "forward", "reverse").distinct(), "samplename")
    rows = rows.withColumn("plate", F.substring_index("samplename", "__", 1))

    def solve(plate: pd.DataFrame) -> pd.DataFrame:
        plate = plate.sort_values("samplename").reset_index(drop=True)
        forward, reverse = sorted(set(plate.forward)), sorted(set(plate.reverse))
        i = plate.forward.map({t: k for k, t in enumerate(forward)}).to_numpy()
        j = plate.reverse.map({t: k + len(forward) for k, t in enumerate(reverse)}).to_numpy()
        gram, right = np.zeros((len(forward) + len(reverse),) * 2), np.zeros(len(forward) + len(reverse))
        rr, rf, ff, rn, fn, nn = (plate[c].to_numpy(float) for c in ("rr", "rf", "ff", "rn", "fn", "nn"))
        for at, value in (((i, i), rr), ((i, j), rf), ((j, i), rf), ((j, j), ff)):
            np.add.at(gram, at, value)
        np.add.at(right, i, rn)
        np.add.at(right, j, fn)
        x, known = bounded_least_squares(gram, right, limit)
        r, f = x[i], x[j]
        residual = np.maximum(nn - 2 * (r * rn + f * fn) + r * r * rr + 2 * r * f * rf + f * f * ff, 0.0)
        both = known[i] & known[j]
        masked = lambda value, ok: [float(v) if o else None for v, o in zip(value, ok)]
        columns = {"reverse_rate": masked(r, known[i]), "forward_rate": masked(f, known[j]), "reverse_jump": masked(r / (1 + r + f), both), "forward_jump": masked(f / (1 + r + f), both)}
        return pd.DataFrame({"samplename": plate.samplename, **columns, "residual": residual})

    return rows.groupBy("plate").applyInPandas(solve, "samplename string, reverse_rate double, forward_rate double, reverse_jump double, forward_jump double, residual double")
