"""Spelling variants: words one edit apart, found in a positional q-gram inverted index with a count filter.

A word is padded at both ends and cut into 3-grams with their positions.  One
inserted, deleted or replaced code point changes at most three of the grams and
moves the others by at most one place, so two near words share at least
``max(length) - 1`` grams at positions that differ by at most one: the overlap bound.

1. *Dealing.*  Of any word's grams all but three survive an edit.  So two near
   words share one of the four grams of either that are rarest in all words
   (ties by gram, then position), and a word is sent to the postings of its four
   rarest grams only.  Counts of grams are a table bounded by the alphabet.
2. *Merging.*  A task holds the words of some postings and indexes all of their
   grams: lists by gram, length and position, sorted by word.  A word asks for
   its five shortest lists under the limits (same length or one longer, position
   at most one off); a heap merges them, and who is in too few of them goes.
3. *Count filter.*  All grams of the pairs that are left are counted against the bound.
4. *Verification.*  The letters themselves decide.

Postings of more than ``group`` words are split by the gram's place (from the
start, or from the end: an edit leaves one of both as it is) and by length, and
what is still larger by pairs of chunks, so that no task holds more than two chunks.

Work grows with the words and with how many share their rarest grams.  The words
are counted with partial sums before any shuffle, so a frequent word is one row
a task.  Forms are followed by doubling: the largest number of occurrences
bounds the chain, as each step has ten times the one before.

Defined cases: null or empty texts have no words; a null id is written as
nothing before the colon; repeated rows count each time; words of any length from two letters
on are whole (words of one letter share no gram and are near no other of one letter); an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch, bound_batches, lean

Q = 3
#: Grams that one edit may change, and the grams of which two near words must share one.
LOST = Q
PREFIX = LOST + 1
#: Lists that are merged for a word.
MERGED = 5
#: Codes of letters: 0 pads, 1 to 26 are a to z, 27 to 90 the letters from U+00C0 to U+00FF.
ALPHABET = 91
#: Lengths and positions count up to this in an index: beyond it they are no limit any more.
_CLIP = (1 << 20) - 1
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Grams:
    """The padded 3-grams of some words, one after another: ``code``, ``owner`` (the word's number), ``at`` (its position)."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.count = self.length + Q - 1
        self.start = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        padded = "".join("\0\0" + w for w in words) + "\0\0"
        point = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        other = np.where(point == 0, 0, 1 + point % (ALPHABET - 1))  # equal letters stay equal, which is all that a filter needs
        letter = np.where((point >= 97) & (point <= 122), point - 96, np.where((point >= 0xC0) & (point <= 0xFF), point - 0xC0 + 27, other))
        # The pads before the next word serve as those after this one.
        self.code = (letter[:-2] * ALPHABET + letter[1:-1]) * ALPHABET + letter[2:]
        self.owner = np.repeat(np.arange(len(words)), self.count)
        self.at = np.arange(len(self.code)) - np.repeat(self.start, self.count)


def corpus_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop: int = 31) -> DataFrame:
    """``word, n``: the words of all texts, counted.

    Runs of letters are lower-cased (A-Z only); where *drop* divides the crc32 of
    ``<doc_id>:<run>``, the code point at that number modulo the length is left out.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}+"), F.lit(0))).alias("run")
    runs = docs.select("doc_id", run).select("doc_id", F.translate("run", _CAPITALS, _SMALL).alias("run"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.select("run", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % drop == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How many words have each gram (once for every place); the table is bounded by the alphabet."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**Q, np.int64)
        for batch in _batches(rows):
            np.add.at(total, Grams(batch.column(0).to_pylist()).code, 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    counts = words.select("word").mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(ALPHABET**Q, np.int64)
    out[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def rarest(grams: Grams, counts: np.ndarray, k: int = PREFIX) -> np.ndarray:
    """The places in *grams* of each word's *k* rarest grams by *counts*."""
    order = np.lexsort((grams.at, grams.code, counts[grams.code], grams.owner))
    place = np.arange(len(order)) - np.repeat(grams.start, grams.count)
    return np.sort(order[place < k])


def _places(position: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Numbers of the four places of a gram: from the start and from the end, among words of its length and of one more."""
    position, behind, length = (np.minimum(x, _CLIP - 1) for x in (position, length - position, length))
    return [((anchor << 20) | (place + 1)) << 20 | (length + longer) for anchor, place in ((1, position), (2, behind + Q)) for longer in (0, 1)]


def _dealt(words: DataFrame, counts: np.ndarray, group: int) -> DataFrame:
    """``gram, place, word, n``: each word in the postings of its rarest grams, large postings by place too."""
    spark = words.sparkSession
    shipped = spark.sparkContext.broadcast(counts)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in _batches(rows):
            grams = Grams(batch.column(0).to_pylist())
            chosen = rarest(grams, known)
            code, owner, at = grams.code[chosen], grams.owner[chosen], grams.at[chosen]
            # More than *group* words have the gram: only then can its postings be that long.
            large = known[code] > group
            once = np.unique(owner[~large] * ALPHABET**Q + code[~large])
            parts = [(once % ALPHABET**Q, np.zeros(len(once), np.int64), once // ALPHABET**Q)]
            parts += [(code[large], place, owner[large]) for place in _places(at[large], grams.length[owner[large]])]
            code, place, owner = (np.concatenate(x) for x in zip(*parts))
            taken = batch.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(place), *taken.columns], names=["gram", "place", "word", "n"])

    return words.select("word", "n").mapInArrow(lean(run), "gram long, place long, word string, n long")


def _tiled(dealt: DataFrame, group: int, scratch: Scratch) -> DataFrame:
    """*dealt* with ``tile``: postings that are still larger than *group* are cut into chunks, and each pair of chunks is a tile."""
    large = dealt.groupBy("gram", "place").agg(F.count("*").alias("size")).filter(F.col("size") > group)
    # Written, so that Spark knows its size.
    chunks = scratch.write(large.select("gram", "place", F.ceil(F.col("size") / (group / 2)).cast("int").alias("chunks")), "variants-chunks")
    placed = dealt.join(chunks, ["gram", "place"], "left")
    mine = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    tiles = F.transform(other, lambda o: F.least(mine, o) * F.col("chunks") + F.greatest(mine, o))
    tile = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(tiles)
    return placed.select("gram", "place", F.explode(tile).alias("tile"), "word", "n")


def merged(lists: list[tuple[int, int]], ids: list[int], least: int) -> list[int]:
    """The numbers that the sorted runs ``ids[lo:hi]`` of *lists* hold *least* times or more: a heap of the runs' heads."""
    heads = [(ids[lo], lo, hi) for lo, hi in lists]
    heapq.heapify(heads)
    found, now, times = [], -1, 0
    while heads:
        head, lo, hi = heads[0]
        if head == now:
            times += 1
        else:
            now, times = head, 1
        if times == least:
            found.append(head)
        if lo + 1 < hi:
            heapq.heapreplace(heads, (ids[lo + 1], lo + 1, hi))
        else:
            heapq.heappop(heads)
    return found


def near(a: str, b: str) -> bool:
    """Whether *a* and *b* differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def overlap(grams: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many grams of the words *a* the words *b* have at a position at most one off."""
    count = grams.count[a]
    pair = np.repeat(np.arange(len(a)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    code = grams.code[grams.start[a][pair] + at]
    equal = np.zeros(len(pair), bool)
    for shift in (-1, 0, 1):
        there = at + shift
        inside = (there >= 0) & (there < grams.count[b][pair])
        equal |= inside & (grams.code[np.where(inside, grams.start[b][pair] + there, 0)] == code)
    return np.bincount(pair, weights=equal, minlength=len(a)).astype(np.int64)


def near_pairs(groups: np.ndarray, words: list[str]) -> list[tuple[int, int]]:
    """Pairs of numbers of *words* that are near and of one group, by the index of these words alone."""
    grams = Grams(words)
    _, key = np.unique(groups[grams.owner] * ALPHABET**Q + grams.code, return_inverse=True)
    length, at = np.minimum(grams.length, _CLIP - 1), np.minimum(grams.at, _CLIP - 1)

    def composite(key: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (((key << 20) | length) << 20) | at

    listed = composite(key, length[grams.owner], at)
    order = np.argsort(listed, kind="stable")  # within a list by word, as grams are
    listed, ids = listed[order], grams.owner[order]
    _, runs = np.unique(listed, return_index=True)
    ends = np.append(runs[1:], len(listed))

    def span(longer: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        size = length[grams.owner] + longer
        lo = np.searchsorted(listed, composite(key, size, np.maximum(at + low, 0)), "left")
        return lo, np.searchsorted(listed, composite(key, size, at + high), "right")

    spans = [span(0, -1, 1), span(1, 0, 1)]
    amount = sum(hi - lo for lo, hi in spans)
    # The shortest lists of each word; a word alone in all of them is done.
    rank = np.lexsort((amount, grams.owner))
    place = np.arange(len(rank)) - np.repeat(grams.start, grams.count)
    short = rank[place < MERGED]
    total = np.bincount(grams.owner[short], weights=amount[short], minlength=len(words))
    asks = total > np.bincount(grams.owner[short], minlength=len(words))
    short = short[asks[grams.owner[short]]]
    # Runs are sorted by word within one position, so every position is a list of its own.
    spread = [(np.searchsorted(runs, lo[short]).tolist(), np.searchsorted(runs, hi[short]).tolist()) for lo, hi in spans]
    runs, ends, ids, owners = runs.tolist(), ends.tolist(), ids.tolist(), grams.owner[short].tolist()
    a, b, i = [], [], 0
    while i < len(owners):
        j, word = i, owners[i]
        while j < len(owners) and owners[j] == word:
            j += 1
        for longer, (begin, end) in enumerate(spread):
            lists = [(runs[r], ends[r]) for x in range(i, j) for r in range(begin[x], end[x])]
            least = j - i - (LOST if not longer else LOST - 1)
            for other in merged(lists, ids, max(1, least)):
                if longer or other > word:
                    a.append(word)
                    b.append(other)
        i = j
    if not a:
        return []
    a, b = np.array(a), np.array(b)
    enough = overlap(grams, a, b) >= np.maximum(grams.length[a], grams.length[b]) - 1
    return [(x, y) for x, y in zip(a[enough].tolist(), b[enough].tolist()) if near(words[x], words[y])]


def _pairs(tiled: DataFrame, together: int = 20_000) -> DataFrame:
    """``a, b, na, nb``: near words and their numbers, each pair once for every posting that has both."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        groups = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        words, n = batch.column(3).to_pylist(), batch.column(4).to_numpy()
        pairs = near_pairs(groups, words)
        a, b = [x for x, _ in pairs], [y for _, y in pairs]
        columns = [pa.array([words[x] for x in a], pa.string()), pa.array([words[x] for x in b], pa.string()), pa.array(n[a].astype(np.int64)), pa.array(n[b].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "na", "nb"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _batches(rows):
            held.append(batch)
            if sum(b.num_rows for b in held) < together:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = np.stack([whole.column(i).to_numpy() for i in range(3)])
            last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            done = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if done:
                yield found(whole.slice(0, done))
            held = [whole.slice(done)]
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    sorted_rows = tiled.repartition("gram", "place", "tile").sortWithinPartitions("gram", "place", "tile")
    return sorted_rows.mapInArrow(lean(run), "a string, b string, na long, nb long")


def near_words(words: DataFrame, scratch: Scratch, group: int = 10_000) -> DataFrame:
    """``a, b, na, nb``: all pairs of different *words* (``word, n``) that are one edit apart, once each."""
    counts = _gram_counts(words)
    dealt = scratch.write(_dealt(words, counts, group), "variants-dealt")
    pairs = scratch.write(_pairs(_tiled(dealt, group, scratch)).distinct(), "variants-pairs")
    scratch.drop("variants-dealt")
    swapped = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "na", "nb")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
    return scratch.write(pairs.select(swapped.alias("p")).select("p.*").distinct(), "variants-near")


def group_variants(words: DataFrame, ratio: int = 10, group: int = 10_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of different *words* with their numbers (``word, n``).

    The form of a word is its near word of largest *n* (ties: smallest in code-point
    order) if that has *ratio* times the word's own; the root is the last form of a chain.
    """
    if ratio < 2:
        raise ValueError("a form must have at least twice the number of its word")
    spark = words.sparkSession
    bound_batches(spark, rows=10_000)
    scratch = Scratch(spark)
    words = scratch.write(words.select("word", "n"), "variants-words")
    pairs = near_words(words, scratch, group)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    around = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), best)
    large = -F.col("best.less") >= F.col("n") * ratio
    around = scratch.write(around.select("word", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")), "variants-around")
    links = scratch.write(around.filter("form is not null").select("word", F.col("form").alias("root")), "variants-links")
    while True:  # numbers grow tenfold a step and a round doubles the steps: a handful of rounds
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(further, "root", "left_semi").isEmpty():
            break
        links = scratch.replace(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-links")
    found = words.join(around, "word", "left").join(links, "word", "left")
    out = found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    return scratch.finish(out, "variants")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`group_variants` of the words of *docs* (:func:`corpus_words`)."""
    return group_variants(corpus_words(docs))
