"""Search of sequences over a stored index, without losing a hit.

*Index.*  A set of targets (``name, seq``) is stored as a table of its k-mers with their places and the letters next to them,
bucketed and sorted by k-mer, beside the letters bucketed by name and the k-mers' numbers.  A search joins the
bucketed table as it lies: only the query's side is shuffled.  A bucket is a task's share, so their number goes with the k-mers (:func:`buckets_for`).

*Seeds.*  An alignment of a query of length n whose columns match to a share of *identity* has at most
``d = floor((1 / identity - 1) * n)`` edits.  The query is cut into d + 1 pieces; one of them
is in the target as it is, and so is every k-mer of it.  From each piece the k-mer that is rarest in the index is asked for: d + 1
lookups a query find every hit (a k-mer that the index lacks rules its piece out).  A k-mer's places grow with the index, but the piece must be there
as well: letters beside the k-mer that differ end a seed in the join.  That needs pieces of k letters or more; shorter queries are told by :func:`too_short`.

*Windows.*  Where the queries are known, an index may leave out most k-mers: with a *window* of w it has the first of each w k-mers in a row by
the order of their hashes, about 2 / (w + 1) of all.  The first k-mer of a piece of w k-mers or more is the first of a window in every target that has the
piece, so no hit is lost (:func:`window_for`), a piece needs no counts to know its seed, and :func:`too_short` tells queries with shorter pieces.

*Verification.*  Around a seed's diagonal the query is aligned as a whole within a target, in a band of d places to both sides,
with affine gaps; many pairs at a time, place by place.  The best path's score, matches and columns travel with the score, so
nothing is traced back.

Both strands are searched by asking with the reverse complement as well.  Defined cases: null sequences
are left out; equal names are one query; ties go to the first target, then the plus strand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.functions.sequences import reverse_complement
from cubeloom.operators.clusters import greedy_centroids
from cubeloom.session import shared_dir, written

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2, -4, -10, -1
_LOW = -(1 << 30)
#: Letters to both sides that the index has of a k-mer, and k-mers in a bucket.
_BESIDE, _BUCKET = 8, 500_000
#: Pairs that are aligned at a time.
_TOGETHER = 2000
#: The widest window of an index.
_WIDEST = 64


@dataclass(frozen=True)
class Index:
    """A stored set: names of its tables, its word length and its window; the numbers of k-mers are there for windows of 1."""

    words: str
    letters: str
    numbers: str
    k: int
    window: int = 1


def _hashes(sequences: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for the *k* letters from each letter of the joined *sequences* on, the largest where a sequence has no more *k*; the sequences' lengths."""
    letters = np.frombuffer("".join(sequences).encode("ascii", "replace"), np.uint8)
    lengths = np.array([len(x) for x in sequences], np.int64)
    end = np.repeat(np.cumsum(lengths), lengths)
    out = np.zeros(len(letters), np.uint64)
    for j in range(k):
        out[: len(out) - j] = out[: len(out) - j] * np.uint64(0x9E3779B97F4A7C15) + letters[j:]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return np.where(np.arange(len(out)) + k <= end, out, np.iinfo(np.uint64).max), lengths


def window_places(sequences: list[str], k: int, window: int) -> list[np.ndarray]:
    """The places of the first k-mer of each *window* k-mers in a row, by their hashes, then from the left."""
    hashes, lengths = _hashes(sequences, k)
    began = np.cumsum(lengths) - lengths
    least, at = hashes.copy(), np.zeros(len(hashes), np.int64)
    for j in range(1, window):
        less = hashes[j:] < least[: len(hashes) - j]
        least[: len(less)][less], at[: len(less)][less] = hashes[j:][less], j
    place, of = np.arange(len(hashes)), np.repeat(np.arange(len(lengths)), lengths)
    whole = place - began[of] + window + k - 1 <= lengths[of]
    chosen = np.unique((place + at)[whole])
    parts = np.searchsorted(chosen, np.append(began, len(hashes)))
    return [chosen[a:b] - start for a, b, start in zip(parts[:-1], parts[1:], began)]


def first_places(pieces: list[str], k: int) -> np.ndarray:
    """The place of the first of all k-mers of each piece, by their hashes, then from the left; pieces have *k* letters or more."""
    hashes, lengths = _hashes(pieces, k)
    if not len(lengths):
        return lengths
    began = np.cumsum(lengths) - lengths
    first = np.flatnonzero(hashes == np.repeat(np.minimum.reduceat(hashes, began), lengths))
    return first[np.searchsorted(first, began)] - began


def _places(k: int, window: int = 1):
    if window > 1:

        @F.pandas_udf("array<int>")
        def places(seq: pd.Series) -> pd.Series:
            return pd.Series(window_places(seq.tolist(), k, window), dtype=object)

        return places("seq")
    n = F.length("seq")
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def buckets_for(targets: DataFrame, k: int, window: int = 1) -> int:
    """Buckets of about ``_BUCKET`` k-mers for an index of *targets*, 8 at least."""
    words = targets.agg(F.sum(F.greatest(F.length("seq") - (k - 1), F.lit(0)))).first()[0] or 0
    return min(100_000, max(8, -(-2 * words // ((window + 1) * _BUCKET))))


def window_for(queries: DataFrame, identity: float, k: int) -> int:
    """The widest window of an index that loses no hit of *queries* (``seq``)."""
    least = F.floor(F.length("seq") / (_edits(identity) + 1))
    shortest = queries.filter(least >= k).agg(F.min(least)).first()[0]
    return 1 if shortest is None else min(_WIDEST, int(shortest) - k + 1)


def _bucketed(df: DataFrame, key: str, buckets: int, table: str, path: str) -> None:
    # A task has a bucket, or each task would write a file for every bucket.
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)


def store(targets: DataFrame, k: int, buckets: int = 64, path: str | None = None, window: int = 1) -> Index:
    """Write the index of *targets* (``name, seq``) to *path* (default: the shared folder); of a *window* above 1 one k-mer only."""
    spark, tag = targets.sparkSession, f"index_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/{tag}"
    kept = targets.filter("name is not null and seq is not null").select("name", "seq")
    at = F.col("at")
    before, after = F.substring("seq", F.greatest(at - _BESIDE, F.lit(0)) + 1, F.least(at, F.lit(_BESIDE))), F.substring("seq", at + (k + 1), F.lit(_BESIDE))
    words = kept.select(F.col("name").alias("target"), "seq", F.explode(_places(k, window)).alias("at")).select(F.substring("seq", at + 1, F.lit(k)).alias("word"), "target", "at", before.alias("before"), after.alias("after"))
    index = Index(f"{tag}_words", f"{tag}_letters", f"{tag}_numbers", k, window)
    _bucketed(words, "word", buckets, index.words, f"{path}/words")
    _bucketed(kept.select(F.col("name").alias("target"), F.col("seq").alias("target_seq")), "target", buckets, index.letters, f"{path}/letters")
    if window == 1:
        _bucketed(spark.table(index.words).groupBy("word").agg(F.count("*").alias("n")), "word", buckets, index.numbers, f"{path}/numbers")
    return index


def opened(spark: SparkSession, path: str, k: int, buckets: int = 64, window: int = 1) -> Index:
    """The index that :func:`store` wrote to *path*, for another session."""
    tag = f"index_{uuid.uuid4().hex}"
    index = Index(f"{tag}_words", f"{tag}_letters", f"{tag}_numbers", k, window)
    parts = ((index.words, "words", "word string, target string, at int, before string, after string", "word"), (index.letters, "letters", "target string, target_seq string", "target"), (index.numbers, "numbers", "word string, n long", "word"))
    for table, part, columns, key in parts if window == 1 else parts[:2]:
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
    return index


def _edits(identity: float):
    return F.floor(F.lit(1 / identity - 1) * F.length("seq") + F.lit(1e-9)).cast("int")


def too_short(queries: DataFrame, index: Index, identity: float) -> DataFrame:
    """Queries whose pieces are shorter than the index's words: a search can't answer for them."""
    return queries.filter(F.floor(F.length("seq") / (_edits(identity) + 1)) < index.k + index.window - 1)


def seeds(queries: DataFrame, index: Index, identity: float) -> DataFrame:
    """``query, word, place, left, right``: the rarest k-mer of every piece of the queries (``query, seq``), with the piece's letters beside it.

    With a window it is the first k-mer by the order of the hashes.
    """
    n, d, k = F.length("seq"), _edits(identity), index.k
    border = lambda j: F.floor(n * j / (d + 1)).cast("int")
    if index.window > 1:
        part = lambda j: F.struct(border(j).alias("began"), F.substring("seq", border(j) + 1, border(j + 1) - border(j)).alias("letters"))
        cut = queries.filter(F.floor(n / (d + 1)) >= k + index.window - 1).select("query", F.explode(F.transform(F.sequence(F.lit(0), d), part)).alias("p")).select("query", "p.*")
        first = F.pandas_udf(lambda x: pd.Series(first_places(x.tolist(), k)), "int")
        at, beside = F.col("at"), lambda start, length: F.substring("letters", start, length)
        sides = beside(F.greatest(at - _BESIDE, F.lit(0)) + 1, F.least(at, F.lit(_BESIDE))), beside(at + (k + 1), F.lit(_BESIDE))
        return cut.withColumn("at", first("letters")).select("query", beside(at + 1, F.lit(k)).alias("word"), (F.col("began") + at).alias("place"), sides[0].alias("left"), sides[1].alias("right"))
    left = lambda i, lo: F.substring("seq", F.greatest(i - _BESIDE, lo) + 1, F.least(i - lo, F.lit(_BESIDE)))
    right = lambda i, hi: F.substring("seq", i + (k + 1), F.least(hi - i - k, F.lit(_BESIDE)))
    word = lambda i, j: F.struct(j.alias("piece"), i.alias("place"), F.substring("seq", i + 1, F.lit(k)).alias("word"), left(i, border(j)).alias("left"), right(i, border(j + 1)).alias("right"))
    piece = lambda j: F.transform(F.sequence(border(j), border(j + 1) - k), lambda i: word(i, j))
    long_enough = queries.filter(F.floor(n / (d + 1)) >= k)
    words = long_enough.select("query", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), d), piece))).alias("w")).select("query", "w.*")
    counted = words.join(words.sparkSession.table(index.numbers), "word", "left")
    # A k-mer that the index lacks counts 0, is its piece's rarest, and finds nothing: the piece is not in any target.
    rarest = counted.groupBy("query", "piece").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "place", "word", "left", "right")).alias("best"))
    return rarest.filter("best.n > 0").select("query", "best.word", "best.place", "best.left", "best.right")


def candidates(queries: DataFrame, index: Index, identity: float) -> DataFrame:
    """``query, target, diagonal``: where a seed of a query lies in a target; the index is joined in its buckets."""
    found = seeds(queries, index, identity).join(queries.sparkSession.table(index.words), "word").filter(F.endswith("before", F.col("left")) & F.startswith("after", F.col("right")))
    return found.groupBy("query", "target", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.lit(1).alias("one")).drop("one")


def aligned(queries: list[str], targets: list[str], diagonals: list[int], width: int) -> np.ndarray:
    """``[score, matches, columns, first, after]`` of each whole query in its target, within *width* of its diagonal.

    Targets' ends are free.  Columns count every letter of a gap; ``first`` and ``after`` bound the target's letters.
    The best score, then the most matches, then the first end is taken.
    """
    pairs, m = len(queries), max(map(len, queries))
    size = 2 * width + 1
    q = np.zeros((pairs, m), np.uint8)
    length, tlen = np.array([len(x) for x in queries]), np.array([len(x) for x in targets])
    for row, x in enumerate(queries):
        q[row, : len(x)] = np.frombuffer(x.encode("ascii", "replace"), np.uint8)
    flat = np.frombuffer("".join(targets).encode("ascii", "replace") + b"-", np.uint8)
    start, diagonal = np.cumsum(tlen) - tlen, np.array(diagonals)
    band = diagonal[:, None] + np.arange(-width, width + 1)[None, :]  # the target's letters that are used up where none of the query are
    # A state is one number: score, then matches, so that the larger number wins; columns and the start follow along.
    unit = 1 << 20
    fresh = np.where((band >= 0) & (band <= tlen[:, None]), 0, _LOW * unit)
    best, cols, first = fresh.astype(np.int64), np.zeros((pairs, size), np.int64), band.copy()
    down, dcols, dfirst = np.full((pairs, size), _LOW * unit, np.int64), cols.copy(), first.copy()
    out = np.zeros((pairs, 5), np.int64)
    for i in range(1, m + 1):
        at = band + i  # letters of the target that are used up in this row
        inside = (at >= 1) & (at <= tlen[:, None])
        letter = flat[np.where(inside, start[:, None] + at - 1, len(flat) - 1)]
        equal = (letter == q[:, i - 1, None]) & inside
        across = np.where(inside, best + np.where(equal, MATCH * unit + 1, MISMATCH * unit), _LOW * unit)
        # A gap in the target keeps its letters: the place before lies one to the right in the band.
        opened_, longer = best[:, 1:] + GAP_OPEN * unit, down[:, 1:] + GAP_EXTEND * unit
        take = longer > opened_
        ndown = np.full_like(down, _LOW * unit)
        ndown[:, :-1] = np.where(take, longer, opened_)
        ndown[(at < 0) | (at > tlen[:, None])] = _LOW * unit
        ndcols, ndfirst = dcols.copy(), dfirst.copy()
        ndcols[:, :-1] = np.where(take, dcols[:, 1:], cols[:, 1:]) + 1
        ndfirst[:, :-1] = np.where(take, dfirst[:, 1:], first[:, 1:])
        use = ndown > across
        now, ncols, nfirst = np.where(use, ndown, across), np.where(use, ndcols, cols + 1), np.where(use, ndfirst, first)
        # A gap in the query: from left to right along the band.
        run, rcols, rfirst = np.full(pairs, _LOW * unit, np.int64), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
        for j in range(1, size):
            opened_, longer = now[:, j - 1] + GAP_OPEN * unit, run + GAP_EXTEND * unit
            take = longer > opened_
            run, rcols, rfirst = np.where(take, longer, opened_), np.where(take, rcols, ncols[:, j - 1]) + 1, np.where(take, rfirst, nfirst[:, j - 1])
            use = (run > now[:, j]) & inside[:, j]
            now[:, j], ncols[:, j], nfirst[:, j] = np.where(use, run, now[:, j]), np.where(use, rcols, ncols[:, j]), np.where(use, rfirst, nfirst[:, j])
        best, cols, first, down, dcols, dfirst = now, ncols, nfirst, ndown, ndcols, ndfirst
        for row in np.flatnonzero(length == i):
            j = int(best[row].argmax())
            score = int(best[row, j])
            out[row] = (score // unit, score % unit, cols[row, j], first[row, j], band[row, j] + i)
    return out


_HITS = "query string, strand string, target string, score long, matches long, columns long, identity double, target_start long, target_end long, coverage double"


def hits(queries: DataFrame, index: Index, identity: float = 0.97, both_strands: bool = True, min_columns: int = 0) -> DataFrame:
    """All hits of *queries* (``name, seq``): whole queries within targets, ``matches / columns`` at least *identity*.

    Gives ``query, strand, target, score, matches, columns, identity, target_start, target_end`` (0-based, the end not included) and
    ``coverage`` (the share of the target that is aligned); the best alignment of each query, strand and target.
    """
    spark = queries.sparkSession
    named = queries.filter("name is not null and seq is not null").groupBy("name").agg(F.min("seq").alias("seq"))
    strands = [("+", F.col("seq"))] + ([("-", reverse_complement(F.col("seq")))] if both_strands else [])
    asked = None
    for sign, letters in strands:
        one = named.select(F.concat(F.lit(sign), "name").alias("query"), letters.alias("seq"))
        asked = one if asked is None else asked.unionByName(one)
    asked = written(asked, "asked")
    near = written(candidates(asked, index, identity), "candidates")
    sides = near.join(asked, "query").join(spark.table(index.letters), "target")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            widths = [int((1 / identity - 1) * len(s) + 1e-9) for s in frame["seq"]]
            for width, part in frame.groupby(pd.Series(widths, index=frame.index)):
                for lo in range(0, len(part), _TOGETHER):
                    some = part.iloc[lo : lo + _TOGETHER]
                    found = aligned(some["seq"].tolist(), some["target_seq"].tolist(), some["diagonal"].tolist(), int(width))
                    share = found[:, 1] / np.maximum(found[:, 2], 1)
                    covered = (found[:, 4] - found[:, 3]) / some["target_seq"].str.len().to_numpy()
                    made = pd.DataFrame({"query": some["query"].str[1:].tolist(), "strand": some["query"].str[0].tolist(), "target": some["target"].tolist(), "score": found[:, 0], "matches": found[:, 1], "columns": found[:, 2], "identity": share, "target_start": found[:, 3], "target_end": found[:, 4], "coverage": covered})
                    yield made[(found[:, 0] > _LOW // 2) & (share >= identity - 1e-12) & (found[:, 2] >= min_columns)]  # no path at all scores _LOW

    chosen = sides.select("query", "target", "diagonal", "seq", "target_seq").mapInPandas(run, _HITS)
    order = Window.partitionBy("query", "strand", "target").orderBy(F.desc("score"), F.desc("matches"), "target_start")
    return chosen.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def best_hits(found: DataFrame) -> DataFrame:
    """The best hit of each query: identity, then score, then the first target, then the plus strand."""
    order = Window.partitionBy("query").orderBy(F.desc("identity"), F.desc("score"), "target", "strand")
    return found.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def best_in(reads: DataFrame, targets: DataFrame, identity: float = 0.97, k: int = 12, **options) -> DataFrame:
    """:func:`best_hits` of *reads* in *targets* (``name, seq`` each); equal reads are asked and equal targets stored once, so that copies make no pairs.

    Of equal targets the first name is the best hit.
    """
    known = "name is not null and seq is not null"
    stored = written(targets.filter(known).groupBy("seq").agg(F.min("name").alias("name")), "stored")
    named = written(reads.filter(known).groupBy("name").agg(F.min("seq").alias("seq")), "reads")
    asked = written(named.groupBy("seq").agg(F.min("name").alias("name")), "asked-once")
    window = window_for(asked, identity, k)
    index = store(stored, k, buckets_for(stored, k, window), window=window)
    found = best_hits(hits(asked, index, identity, **options)).join(asked.withColumnRenamed("name", "query"), "query").drop("query")
    return named.join(found, "seq").drop("seq").withColumnRenamed("name", "query")


def remapped(reads: DataFrame, index: Index, identity: float = 0.97, **options) -> DataFrame:
    """Every read's name with its best target and strand (null: unmatched)."""
    best = best_hits(hits(reads, index, identity, **options)).select(F.col("query").alias("name"), "target", "strand", "identity")
    return reads.select("name").join(best, "name", "left")


def clustered(sequences: DataFrame, identity: float = 0.97, k: int = 8, both_strands: bool = True, less_columns: int = 10) -> DataFrame:
    """``name, centroid, strand`` of ``name, seq, size`` by greedy clustering over hits.

    A hit must align all but *less_columns* letters of the shortest sequence.  ``strand`` tells how a sequence lies to its centroid.
    """
    window = window_for(sequences, identity, k)
    index = store(sequences, k, buckets_for(sequences, k, window), window=window)
    shortest = sequences.agg(F.min(F.length("seq")).alias("n")).first()["n"] or 0
    links = written(hits(sequences, index, identity, both_strands, max(0, shortest - less_columns)).filter("query != target").select("query", "target", "strand"), "links")
    chosen = greedy_centroids(sequences, links.select("query", "target"))
    around = links.select(F.col("query").alias("name"), F.col("target").alias("centroid"), "strand").unionByName(links.select(F.col("target").alias("name"), F.col("query").alias("centroid"), "strand"))
    lies = around.groupBy("name", "centroid").agg(F.min("strand").alias("strand"))
    return chosen.join(lies, ["name", "centroid"], "left").select("name", "centroid", F.coalesce("strand", F.lit("+")).alias("strand"))
