"""Sequence and read operators: filters, statistics, dereplication, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions import sequences as sq
from cubeloom.functions.names import any_word


def by_name(reads: DataFrame, keywords: list[str] = (), ngwords: list[str] = (), converse: bool = False) -> DataFrame:
    """Reads whose name matches all *keywords* and no *ngword*, or with *converse* all others."""
    ok = F.lit(True)
    for word in keywords:
        ok = ok & any_word(F.col("name"), [word])
    ok = ok & ~any_word(F.col("name"), list(ngwords))
    return reads.filter(~ok if converse else ok)


def by_members(items: DataFrame, members: DataFrame, min_members: int) -> DataFrame:
    """Items (``name``) with *min_members* members (``otuname``) or more."""
    enough = members.groupBy(F.col("otuname").alias("name")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_members)
    return items.join(enough.select("name"), "name", "left_semi")


def trim_tail(reads: DataFrame, least: int, tail: int = 1) -> DataFrame:
    """Reads cut at the 3' end by quality."""
    cut = reads.withColumn("__n", sq.kept_length("qual", F.lit(least), F.lit(tail)))
    return cut.select(*[F.substring(c, F.lit(1), F.col("__n")).alias(c) if c in ("seq", "qual") else F.col(c) for c in reads.columns])


def by_length(reads: DataFrame, min_length: int = 1, max_length: int | None = None, truncate: bool = False) -> DataFrame:
    """Reads of *min_length* or more; longer ones than *max_length* go, or are truncated."""
    kept = reads.filter(F.length("seq") >= min_length)
    if max_length is None:
        return kept
    if not truncate:
        return kept.filter(F.length("seq") <= max_length)
    return kept.select(*[F.substring(c, F.lit(1), F.lit(max_length)).alias(c) if c in ("seq", "qual") else F.col(c) for c in kept.columns])


def by_quality(
    reads: DataFrame,
    max_errors: float | None = None,
    min_mean: float | None = None,
    low: int | None = None,
    max_low_share: float = 1.0,
    max_quality: int | None = None,
    cap: bool = True,
    max_ns: int | None = None,
    truncate_below: int | None = None,
) -> DataFrame:
    """Reads by expected errors, mean quality, share of low qualities, largest quality and number of N.

    *truncate_below* first cuts a read before its first quality below it.  A
    quality above *max_quality* ends the read with ``cap=False``; else it is capped
    in the reads that are left, after all gates.
    """
    out = reads
    if truncate_below is not None:
        first = F.array_position(F.transform(sq.qualities(F.col("qual")), lambda q: q < truncate_below), True)
        out = out.withColumn("__n", F.when(first > 0, first - 1).otherwise(F.length("qual")).cast("int"))
        out = out.select(*[F.substring(c, F.lit(1), F.col("__n")).alias(c) if c in ("seq", "qual") else F.col(c) for c in reads.columns])
    numbers = sq.qualities(F.col("qual"))
    if max_quality is not None and not cap:
        out = out.filter(~F.exists(numbers, lambda q: q > max_quality))
    if max_errors is not None:
        out = out.filter(sq.expected_errors(numbers) <= max_errors)
    if min_mean is not None:
        out = out.filter(sq.mean_quality(numbers) >= min_mean)
    if low is not None:
        out = out.filter(sq.low_share(numbers, low) <= max_low_share)
    if max_ns is not None:
        out = out.filter(F.length(F.regexp_replace("seq", "[^N]", "")) <= max_ns)
    if max_quality is not None and cap:
        out = out.withColumn("qual", sq.quality_string(F.transform(numbers, lambda q: F.least(q, F.lit(max_quality)))))
    return out


def both_mates(reads: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept reads (``rec_no, strand``) whose mate is kept as well; unpaired reads of one strand stay."""
    expected = reads.groupBy("rec_no").agg(F.count("*").alias("mates"))
    left = kept.groupBy("rec_no").agg(F.count("*").alias("left"))
    whole = expected.join(left, "rec_no").filter("mates = left").select("rec_no")
    return kept.join(whole, "rec_no", "left_semi")


def length_window(sequences: DataFrame, min_length: int = 100, max_length: int = 200000, drop_long: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sequences within the window, and the longer ones to be kept as they are (none with *drop_long*)."""
    inside = sequences.filter(F.length("seq").between(min_length, max_length))
    longer = sequences.filter(F.length("seq") > max_length)
    return inside, longer.limit(0) if drop_long else longer


def dereplicate(sequences: DataFrame) -> DataFrame:
    """``seq, size, representative``: equal sequences as one, with their number and first name."""
    return sequences.groupBy("seq").agg(F.count("*").alias("size"), F.min("name").alias("representative"))


def dereplicated_names(sequences: DataFrame, separator: str = "\x01") -> DataFrame:
    """``seq, names``: equal sequences as one with all names joined; meant for reference sets, as a name list is one value."""
    return sequences.groupBy("seq").agg(F.array_join(F.sort_array(F.collect_list("name")), separator).alias("names"))


def longest_per_key(hits: DataFrame, key: str = "acc", sequence: str = "seq") -> DataFrame:
    """The longest sequence of each key, the first of equal ones."""
    best = F.max_by(F.col(sequence), F.struct(F.length(sequence), F.col(sequence)))
    return hits.groupBy(key).agg(best.alias(sequence))


def clamped_least_length(sequences: DataFrame, low: int = 100, high: int = 10000) -> DataFrame:
    return sequences.agg(F.least(F.greatest(F.min(F.length("seq")), F.lit(low)), F.lit(high)).alias("min_length"))


def position_statistics(reads: DataFrame) -> DataFrame:
    """``pos, n, mean_quality, mean_errors``: qualities and mean expected errors up to each position."""
    long = reads.select("name", F.posexplode(sq.qualities(F.col("qual"))).alias("pos", "q"))
    upto = F.sum(F.pow(F.lit(10.0), -F.col("q") / 10.0)).over(Window.partitionBy("name").orderBy("pos"))
    return long.withColumn("errors", upto).groupBy("pos").agg(F.count("*").alias("n"), F.avg("q").alias("mean_quality"), F.avg("errors").alias("mean_errors"))


def error_table(reads: DataFrame, lengths: list[int], limits: list[float]) -> DataFrame:
    """``length, limit, n``: reads that are as long and have at most so many expected errors up to there."""
    prefix = F.explode(F.array(*map(F.lit, lengths))).alias("length")
    cut = reads.select("qual", prefix).filter(F.length("qual") >= F.col("length"))
    errors = cut.select("length", sq.expected_errors(F.slice(sq.qualities(F.col("qual")), F.lit(1), F.col("length"))).alias("errors"))
    long = errors.select("length", "errors", F.explode(F.array(*map(F.lit, limits))).alias("limit"))
    return long.groupBy("length", "limit").agg(F.count_if(F.col("errors") <= F.col("limit")).alias("n"))


def quality_statistics(reads: DataFrame) -> DataFrame:
    """``q, n``: bases of each quality."""
    return reads.select(F.explode(sq.qualities(F.col("qual"))).alias("q")).groupBy("q").agg(F.count("*").alias("n"))


def padded_pairs(pairs: DataFrame, padding: str = "ACGTACGTACGTACGT") -> DataFrame:
    """Pairs (``name, seq, qual, mate_seq, mate_qual``) as one read: forward, padding of quality ``~``, reverse complement."""
    return pairs.select(
        "name",
        F.concat("seq", F.lit(padding), sq.reverse_complement(F.col("mate_seq"))).alias("seq"),
        F.concat("qual", F.lit("~" * len(padding)), F.reverse("mate_qual")).alias("qual"),
    )


def cell_members(members: DataFrame, min_size: int = 1) -> DataFrame:
    """Members of items that have *min_size* of them or more."""
    large = members.groupBy("otuname").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return members.join(large.select("otuname"), "otuname", "left_semi")
