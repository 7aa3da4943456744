"""Denoising reads by an error model of substitutions.

A read is a copy of some true sequence in which letters were replaced, at rates
that depend on the two letters and the quality.  Different sequences are taken for copies of larger ones unless
there are too many of them for that.

1. *Unique sequences* with their number and the mean quality of each place.  Tasks add up equal
   sequences first, so a sequence that a third of the reads have is a row a task; sorted by sequence, the sums meet.
2. *Comparing* with centres: sequences of one length with at most *max_distance* replacements.
   Cut in ``max_distance + 1`` pieces, two such sequences have a piece in common (the pigeonhole), so none is lost.
3. *Assigning*: a sequence goes to the centre from which most copies of it are expected, the chance of its
   replacements times the reads of the centre.
4. *Testing*: the Poisson chance of as many copies as there are, given one, times the number of unique
   sequences.  Those below *omega* are no copies: the largest of every neighbourhood of them become centres, all
   at once, and the next round compares with these only.  It ends when none is left.  Most of a neighbourhood is ruled out
   by the largest that has one of its pieces; only what is left is compared with all that share a piece.
5. *Refitting*: the rates are counted over all assigned reads, with a prior from the qualities' own meaning,
   and the rounds are repeated with them until they settle.

Work grows with the unique sequences times the centres near them.  All tables
are written between rounds; only rates (16 times 64 numbers) and counts reach the driver.

Defined cases: reads with other letters than A, C, G and T, without a sequence or with qualities of another length
belong to no centre; a single copy is never a centre, and if none is near it belongs
to none (null).  The largest number wins, then the smaller sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.session import written

LETTERS = "ACGT"
QUALITIES = 64
_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in LETTERS]] = range(4)
#: Unique sequences that a task adds up before it hands them on.
_HELD = 20_000


def codes(sequence: str) -> np.ndarray:
    """Letters as numbers from 0 to 3."""
    return _CODE[np.frombuffer(sequence.encode("ascii", "replace"), dtype=np.uint8)]


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of *frame* by the length of ``seq``."""
    return ((int(n), part) for n, part in frame.groupby(frame["seq"].str.len()))


def _matrix(sequences: pd.Series, n: int) -> np.ndarray:
    """Sequences of *n* letters as rows of bytes."""
    return np.frombuffer("".join(sequences).encode("ascii"), np.uint8).reshape(-1, n)


def nominal_rates() -> np.ndarray:
    """``[from, to, quality]``: the chance that the quality itself states, shared by the other three letters."""
    wrong = np.minimum(10.0 ** (-np.arange(QUALITIES) / 10.0), 0.75)
    rates = np.repeat(wrong[None, None, :] / 3, 4, axis=0).repeat(4, axis=1)
    rates[np.arange(4), np.arange(4)] = 1 - wrong
    return rates


def valid(reads: DataFrame) -> DataFrame:
    """Reads that the model can take: letters A, C, G, T only, a quality for each."""
    return reads.filter(F.col("seq").rlike("^[ACGT]+$") & (F.length("seq") == F.length("qual")))


def unique_sequences(reads: DataFrame) -> DataFrame:
    """``seq, size, quality`` of ``seq, qual`` (offset 33): the rounded mean quality of every place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[int, np.ndarray]] = {}
        for frame in frames:
            for n, part in _by_length(frame):
                at, seqs = pd.factorize(part["seq"])
                order = np.argsort(at, kind="stable")
                counts = np.bincount(at)
                q = np.frombuffer("".join(part["qual"]).encode("latin-1", "replace"), np.uint8).reshape(-1, n)[order]
                sums = np.add.reduceat(q, np.cumsum(counts) - counts, axis=0, dtype=np.int64) - 33 * counts[:, None]
                _add(held, seqs, counts, sums)
            if len(held) > _HELD:
                yield _frame(held)
                held.clear()
        if held:
            yield _frame(held)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[int, np.ndarray]] = {}
        for frame in frames:
            if not len(frame):
                continue
            _add(held, frame["seq"], frame["n"], frame["total"])
            # Sorted, so that only the last one may go on.
            last = frame["seq"].iloc[-1]
            open_ = held.pop(last)
            if held:
                yield _means(held)
            held = {last: open_}
        if held:
            yield _means(held)

    partial = valid(reads).select("seq", "qual").mapInPandas(run, "seq string, n long, total array<long>")
    return partial.repartition("seq").sortWithinPartitions("seq").mapInPandas(meet, "seq string, size long, quality array<int>")


def _add(held: dict, seqs, counts, sums) -> None:
    """Add numbers and sums of qualities to those that *held* has of the same sequences."""
    for seq, n, total in zip(seqs, counts, sums):
        before = held.get(seq)
        held[seq] = (int(n), total) if before is None else (before[0] + int(n), before[1] + total)


def _frame(held: dict) -> pd.DataFrame:
    return pd.DataFrame({"seq": list(held), "n": [n for n, _ in held.values()], "total": [q.tolist() for _, q in held.values()]})


def _means(held: dict) -> pd.DataFrame:
    """The sums of *held* as ``seq, size, quality``; halves are rounded up."""
    means = [np.clip(np.floor(q / n + 0.5), 0, QUALITIES - 1).astype(np.int32).tolist() for n, q in held.values()]
    return pd.DataFrame({"seq": list(held), "size": [n for n, _ in held.values()], "quality": means})


def pieces(distance: int):
    """The pieces of ``seq``, as ``length, piece, letters``: two sequences of one length with at most *distance* replacements share one."""
    n = distance + 1
    start = lambda k: F.floor(F.length("seq") * k / n).cast("int")
    each = [F.struct(F.length("seq").alias("length"), F.lit(k).alias("piece"), F.substring("seq", start(k) + 1, start(k + 1) - start(k)).alias("letters")) for k in range(n)]
    return F.array(*each)


def _near(some: DataFrame, others: DataFrame, distance: int) -> DataFrame:
    """``seq, other``: different sequences with at most *distance* replacements, by common pieces."""
    left = some.select("seq", F.explode(pieces(distance)).alias("p"))
    right = others.select("seq", F.explode(pieces(distance)).alias("p")).withColumnRenamed("seq", "other")
    pairs = left.join(right, "p").filter("seq != other")
    # A pair that shares several pieces is taken at the first of them only.
    for k in range(distance):
        start, after = (F.floor(F.length("seq") * i / (distance + 1)).cast("int") for i in (k, k + 1))
        pairs = pairs.filter((F.col("p.piece") <= k) | (F.substring("seq", start + 1, after - start) != F.substring("other", start + 1, after - start)))
    return _within(pairs, distance)


def _within(pairs: DataFrame, distance: int) -> DataFrame:
    """Those of *pairs* (``seq, other``, of one length) with at most *distance* replacements."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in _by_length(frame):
                yield part[(_matrix(part["seq"], n) != _matrix(part["other"], n)).sum(axis=1) <= distance]

    return pairs.select("seq", "other").mapInPandas(run, "seq string, other string")


def _largest(sequences: DataFrame, distance: int) -> DataFrame:
    """``seq, size`` of *sequences* that no larger one (then smaller sequence) is near to.

    Each is compared first with the largest that has each of its pieces, at most ``distance + 1``; what none of these beats is compared with all.
    """
    place = F.struct((-F.col("size")).alias("s"), F.col("seq").alias("t"))
    cut = sequences.select("seq", place.alias("place"), F.explode(pieces(distance)).alias("p"))
    first = cut.groupBy("p").agg(F.min("place").alias("first"))
    led = cut.join(first, "p").filter("first < place").select("seq", F.col("first.t").alias("other")).distinct()
    left = written(sequences.join(_within(led, distance).select("seq").distinct(), "seq", "left_anti").select("seq", "size"), "denoise-led")
    near = _near(left, sequences, distance).join(left, "seq").join(sequences.select(F.col("seq").alias("other"), F.col("size").alias("other_size")), "other")
    beaten = near.filter("other_size > size or (other_size = size and other < seq)").select("seq").distinct()
    return left.join(beaten, "seq", "left_anti")


def _scored(pairs: DataFrame, rates: np.ndarray) -> DataFrame:
    """``seq, centre, size, chance``: the logarithm of the chance that a read of the centre reads as *seq*."""
    logs = np.log(np.maximum(rates, 1e-300)).reshape(16, QUALITIES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in _by_length(frame):
                way = _CODE[_matrix(part["centre"], n)] * 4 + _CODE[_matrix(part["seq"], n)]
                chance = logs[way, np.stack(part["quality"].to_numpy())].sum(axis=1)
                yield part[["seq", "centre", "size"]].assign(chance=chance)

    return pairs.select("seq", "centre", "size", "quality").mapInPandas(run, "seq string, centre string, size long, chance double")


def log_tail(size: np.ndarray, log_expected: np.ndarray) -> np.ndarray:
    """The logarithm of the Poisson chance of *size* or more, given one or more.

    The terms from *size* on fall at least as fast as a geometric series, whose sum bounds them (at most
    ``size / (size - expected)`` times too large); where more are expected it is 0.
    """
    expected = np.exp(np.minimum(log_expected, 700))
    first = -expected + size * log_expected - np.array([lgamma(n + 1) for n in size])
    ratio = np.minimum(expected / (size + 1), 1 - 1e-12)
    given = np.where(expected > 1e-8, np.log(-np.expm1(-np.maximum(expected, 1e-300))), log_expected)
    return np.where(expected >= size, 0.0, np.minimum(first - np.log1p(-ratio) - given, 0.0))


def _tested(best: DataFrame, log_limit: float) -> DataFrame:
    """*best* (``seq, size, log_expected``) that have too many copies for their centre, or no centre at all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            alone = frame["log_expected"].isna().to_numpy()
            tail = log_tail(frame["size"].to_numpy(np.float64), frame["log_expected"].fillna(0.0).to_numpy())
            yield frame.loc[alone | (tail < log_limit), ["seq", "size"]]

    return best.filter("size > 1").select("seq", "size", "log_expected").mapInPandas(run, "seq string, size long")


def _best(uniques: DataFrame, scored: DataFrame, reads: DataFrame) -> DataFrame:
    """``seq, size, centre, log_expected``: the centre from which most copies are expected; a centre is its own."""
    expected = scored.join(reads, "centre").withColumn("log_expected", F.col("chance") + F.log("reads"))
    rank = F.struct((F.col("seq") == F.col("centre")).alias("own"), "log_expected", "reads", (-F.xxhash64("centre")).alias("tie"))
    top = expected.groupBy("seq").agg(F.max_by(F.struct("centre", "log_expected", (F.col("seq") == F.col("centre")).alias("own")), rank).alias("top"))
    joined = uniques.select("seq", "size").join(top, "seq", "left")
    return joined.select("seq", "size", "top.centre", "top.log_expected", F.coalesce("top.own", F.lit(False)).alias("own"))


def _split(uniques: DataFrame, rates: np.ndarray, distance: int, omega: float, compared: dict) -> DataFrame:
    """``seq, size, centre, ...`` when no sequence is significant any more under *rates*.

    *compared* keeps the pairs of centres and sequences from earlier calls, as they don't depend on rates.
    """
    log_limit = float(np.log(omega) - np.log(max(1, compared["n"])))
    centres = scored = best = None
    while True:
        open_ = uniques.filter("size > 1") if best is None else _tested(best.filter("not own"), log_limit)
        open_ = written(open_.select("seq", "size"), "denoise-open")
        if open_.isEmpty():
            break
        new = written(_largest(open_, distance).select(F.col("seq").alias("centre"), F.col("size").alias("reads")), "denoise-new")
        fresh = new if compared["pairs"] is None else new.join(compared["centres"], "centre", "left_anti")
        fresh = written(fresh, "denoise-fresh")
        if not fresh.isEmpty():
            around = _near(fresh.select(F.col("centre").alias("seq")), uniques, distance).select(F.col("seq").alias("centre"), F.col("other").alias("seq"))
            around = around.unionByName(fresh.select("centre", F.col("centre").alias("seq")))
            pairs = written(around.join(uniques, "seq"), "denoise-pairs")
            compared["pairs"] = pairs if compared["pairs"] is None else compared["pairs"].unionByName(pairs)
            known = fresh.select("centre")
            compared["centres"] = known if compared["centres"] is None else compared["centres"].unionByName(known)
        centres = new if centres is None else centres.unionByName(new)
        added = _scored(compared["pairs"].join(new.select("centre"), "centre", "left_semi"), rates)
        scored = written(added if scored is None else scored.unionByName(added), "denoise-scored")
        # New centres start with their own reads; a pass lets others move to them.
        first = _best(uniques, scored, centres).filter("centre is not null").groupBy("centre").agg(F.sum("size").alias("reads"))
        reads = written(first, "denoise-reads")
        best = written(_best(uniques, scored, reads), "denoise-best")
        centres = reads
    return best


def counted(best: DataFrame, reads: DataFrame) -> np.ndarray:
    """``[from, to, quality]``: letters of centres as they were read, over all assigned *reads* with their own qualities.

    (The mean quality of equal sequences is that of their right letters, so it would make a wrong letter's quality too rare.)
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(16 * QUALITIES, np.int64)
        for frame in frames:
            if len(frame):
                way = codes("".join(frame["centre"])) * 4 + codes("".join(frame["seq"]))
                q = np.frombuffer("".join(frame["qual"]).encode("latin-1", "replace"), dtype=np.uint8).astype(np.int64) - 33
                total += np.bincount(way * QUALITIES + q.clip(0, QUALITIES - 1), minlength=len(total))
        found = np.flatnonzero(total)
        yield pd.DataFrame({"at": found, "n": total[found]})

    pairs = valid(reads).select("seq", "qual").join(best.filter("centre is not null").select("seq", "centre"), "seq")
    rows = pairs.mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 1,024 at most
    out = np.zeros(16 * QUALITIES)
    for r in rows:
        out[r["at"]] = r["n"]
    return out.reshape(4, 4, QUALITIES)


def fitted_rates(counts: np.ndarray, prior: float = 10.0) -> np.ndarray:
    """Rates by *counts*, with *prior* letters of each kind and quality at the nominal rates."""
    return (counts + prior * nominal_rates()) / (counts.sum(axis=1, keepdims=True) + prior)


def learned(reads: DataFrame, max_distance: int = 6, omega: float = 1e-40, rounds: int = 10, tolerance: float = 0.01) -> tuple[DataFrame, np.ndarray]:
    """``seq, size, centre`` of all unique sequences of *reads*, and the rates, refitted until they change by less than *tolerance*."""
    uniques = written(unique_sequences(reads), "denoise-unique")
    compared = {"pairs": None, "centres": None, "n": uniques.count()}
    rates, best = nominal_rates(), None
    for _ in range(rounds):
        best = _split(uniques, rates, max_distance, omega, compared)
        if best is None:  # no sequence twice
            return uniques.select("seq", "size", F.lit(None).cast("string").alias("centre")), rates
        counts = counted(best, reads)
        now = fitted_rates(counts)
        seen = counts > 100
        settled = not seen.any() or np.abs(np.log(now[seen] / rates[seen])).max() < tolerance
        rates = now
        if settled:
            break
    return best.select("seq", "size", "centre"), rates


def denoised_reads(reads: DataFrame, **options) -> DataFrame:
    """*reads* (``seq, qual`` and more) with ``denoised``, the true sequence behind each (null: none is near)."""
    best, _ = learned(reads, **options)
    return reads.join(best.select("seq", F.col("centre").alias("denoised")), "seq", "left")


def variants(mapped: DataFrame) -> DataFrame:
    """``denoised, size``: the true sequences of :func:`denoised_reads` and their reads."""
    return mapped.filter("denoised is not null").groupBy("denoised").agg(F.count("*").alias("size"))
