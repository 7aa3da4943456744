"""Substring deduplication by recompression.

Texts are rewritten in rounds: runs of one symbol get one name, then the
symbols are dealt into left and right ones by a salted bit of their names and
each left-right pair gets one name.  Names are fingerprints of what they
stand for, shared by all tasks: a round needs no dictionary, so it is a map, and
the rounds of a text run one after another in one pass.  A symbol is *settled*
in a window of text if all words that decided it (its own and those beside it)
lie in the window; equal windows have the same settled symbols.  ``group``
settled neighbours of the highest round are named once more; every window of
``window`` words is represented by the smallest such name of the highest round
that has one.  A window without any, as within a long run, is named by its own words.

1. One pass over the texts: the distinct representatives of every document, written.
2. Symbols that different texts share reveal the candidates (a shuffle of
   symbol names; exact copies of a text are one text here).
3. Only the windows under shared symbols are verified: 128-bit names of their
   words are grouped, and the smallest document of each name is joined back.  A
   window is repeated if that document is smaller than its own.
4. The words of repeated windows are removed in one more pass.

A copy of a whole text that a smaller document has is removed as a whole (if it
has a window at all) and takes no part in step 3.

Scale: symbols and windows are counted with partial aggregation and joined by
key without a hint, from written tables, so a hot symbol is pre-aggregated and a
skewed join key is split by Spark.  Lists per document are bounded by its length.
All stages between two written tables can be recomputed from them.

Defined cases: a null text has no words; a text of fewer than ``window`` words
has no window and keeps all; rows with the same id are not smaller than each
other, so repeated rows stay alike; a null id is never smaller and never
judged; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch, bloom_joins, bound_batches, lean, text_bytes

_LAST = np.uint64(2**64 - 1)
_ROUND_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Names(dict):
    """128-bit fingerprint by word; emptied at 200,000 words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        name = self[word] = xxhash.xxh3_128_digest(word)
        return name


_NAMES = _Names()


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble the bits of 64-bit names."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fold(names: np.ndarray, width: int) -> np.ndarray:
    """The name of the *width* symbols from each position on (fewer at the end: undefined)."""
    out = np.zeros(len(names), dtype=np.uint64)
    for k in range(width):
        out[: len(names) - k] = (out[: len(names) - k] ^ names[k:]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def fold_at(names: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """As :func:`fold`, from the positions *place* only."""
    out = np.zeros(len(place), dtype=np.uint64)
    for k in range(width):
        out = (out ^ names[place + k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def one_round(names: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, total: int, salt: int):
    """A round of run and pair naming over texts one after another, of *total* words.

    ``[low, high)`` are the words that settle each symbol, *first* marks the
    first symbol of a text.  Both bounds grow along the symbols.
    """
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    if not new.all():
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(names)) - 1
        length = (last - at + 1).astype(np.uint64)
        names = np.where(length > 1, mix(names[at] + mix(length)), names[at])
        starts, low, high, first = starts[at], low[at], high[last], first[at]
    final = np.append(first[1:], True)
    # A run is settled with the symbols beside it; a text's edge never is.
    low = np.where(first, starts - 1, np.append(low[:1], low[:-1]))
    high = np.where(final, np.append(starts[1:], total) + 1, np.append(high[1:], high[-1:]))
    right = (mix(names ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
    joined = ~right & ~final
    joined[:-1] &= right[1:]
    # A left symbol is settled with what follows, a right one with what comes before.
    high, low = np.where(right | final, high, np.append(high[1:], high[-1:])), np.where(right & ~first, np.append(low[:1], low[:-1]), low)
    pair = np.flatnonzero(joined)
    names = names.copy()
    names[pair] = mix(names[pair] * np.uint64(3) + mix(names[pair + 1]))
    keep = np.ones(len(names), dtype=bool)
    keep[pair + 1] = False
    return names[keep], starts[keep], low[keep], high[keep], first[keep]


def least_in(rank: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest of ``rank[begin:end]`` for each of many ranges, the largest number for an empty one."""
    out = np.full(len(begin), _LAST, dtype=np.uint64)
    size, reach, table = end - begin, 1, rank
    longest = int(size.max(initial=0))
    while reach <= longest:
        chosen = np.flatnonzero((size >= reach) & (size < 2 * reach))
        out[chosen] = np.minimum(table[begin[chosen]], table[end[chosen] - reach])
        # Two halves of a range twice as long; ranges that would pass the end are never asked for.
        table = np.minimum(table[:-reach], table[reach:]) if len(table) > reach else table
        reach *= 2
    return out


def representatives(names: np.ndarray, doc: np.ndarray, window: int, group: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows (of word *names*, by document number *doc*) and the symbol that stands for each."""
    n, m = len(names), len(names) - window + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    words = np.arange(n + 1, dtype=np.int64)
    symbols = (names, words[:-1], words[:-1], words[1:], np.append(True, doc[1:] != doc[:-1]))
    levels = []
    for r in range(rounds):
        symbols = one_round(*symbols, n, _ROUND_SALTS[r % len(_ROUND_SALTS)])
        levels.append((symbols[0], symbols[2], symbols[3]))
    place = np.flatnonzero(doc[:m] == doc[window - 1 :])
    keys, open_ = np.full(len(place), _LAST, dtype=np.uint64), np.arange(len(place))
    for name, low, high in reversed(levels):
        many = len(name) - group + 1
        if many <= 0 or not len(open_):
            continue
        rank = mix(fold(name, group)[:many])
        # Symbols that are settled in a window lie one after another: those that need no word before it and none after it.
        before = np.cumsum(np.bincount(np.clip(low[:many] + 1, 0, m), minlength=m + 1))
        within = np.cumsum(np.bincount(np.clip(high[group - 1 :] - window, 0, m), minlength=m + 1))
        at = place[open_]
        keys[open_] = least_in(rank, before[at], within[at])
        open_ = open_[keys[open_] == _LAST]
    if len(open_):
        keys[open_] = mix(fold_at(names, place[open_], window))
    return place, keys


def _flat(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Words by text, the document number of each word, and the two halves of its name."""
    words = [raw.split() for raw in texts]
    sizes = [len(w) for w in words]
    both = np.frombuffer(b"".join(map(_NAMES.__getitem__, chain.from_iterable(words))), dtype="<u8").reshape(-1, 2)
    return sizes, np.repeat(np.arange(len(words)), sizes), both[:, 0].copy(), both[:, 1]


def document_symbols(docs: DataFrame, window: int, group: int, rounds: int) -> DataFrame:
    """``text_key, symbol``: the distinct symbols that stand for a text's windows, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, doc, names, _ = _flat(text_bytes(batch.column(1)))
            place, keys = representatives(names, doc, window, group, rounds)
            cuts = np.searchsorted(doc[place], np.arange(len(sizes) + 1))
            lists = [np.unique(keys[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:])]
            owner = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *lists]))], names=["text_key", "symbol"])

    return docs.select("text_key", "text").mapInArrow(lean(run), "text_key long, symbol long")


def candidate_windows(docs: DataFrame, window: int, group: int, rounds: int) -> DataFrame:
    """``name_a, name_b, doc_id, text_key, start`` of the windows whose symbol is among ``symbols``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, doc, short, upper = _flat(text_bytes(batch.column(2)))
            place, keys = representatives(short, doc, window, group, rounds)
            owner = doc[place]
            # Keys are told apart by their document; a chance agreement only adds a window to verify.
            wanted = batch.column(3)
            of = np.repeat(np.arange(len(sizes)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten().to_numpy().view(np.uint64)
            mask = np.isin(keys ^ mix(owner.astype(np.uint64)), flat ^ mix(of.astype(np.uint64)))
            place, owner = place[mask], owner[mask]
            begins = np.cumsum([0, *sizes])
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fold_at(short, place, window).view(np.int64)),
                    pa.array(fold_at(upper, place, window).view(np.int64)),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array((place - begins[owner]).astype(np.int32)),
                ],
                names=["name_a", "name_b", "doc_id", "text_key", "start"],
            )

    return docs.select("doc_id", "text_key", "text", "symbols").mapInArrow(lean(run), "name_a long, name_b long, doc_id long, text_key long, start int")


def cut_words(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, text_key, n_words, n_removed, text`` of ``doc_id, text_key, text, whole, starts``: what is left, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for raw, whole, starts in zip(text_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4)):
                words = raw.split()
                counts.append(len(words))
                if whole:
                    words = []
                elif starts.is_valid:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    places = np.array(starts.as_py(), dtype=np.int64)
                    np.add.at(change, places, 1)
                    np.add.at(change, places + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "text_key", "n_words", "n_removed", "text"],
            )

    return docs.select("doc_id", "text_key", "text", "whole", "starts").mapInArrow(lean(run), "doc_id long, text_key long, n_words long, n_removed long, text string")


def deduplicate(documents: DataFrame, window: int = 13, group: int = 2, rounds: int = 2) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_removed, text``.

    *text* has the words that stay, joined by one space; *text_key* is the ``xxhash64`` of the text before.
    """
    scratch = Scratch(documents.sparkSession)
    bound_batches(documents.sparkSession, rows=500)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))

    single = scratch.write(document_symbols(docs, window, group, rounds), "dedup-symbols")
    counted = single.groupBy("symbol").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"))
    shared = scratch.write(counted.filter("a != b"), "dedup-shared")
    with bloom_joins(documents.sparkSession, shared.count()):
        hits = scratch.write(single.join(shared.filter("a < b").select("symbol"), "symbol"), "dedup-hits")  # by itself, so that Spark can split a skewed symbol
    scratch.drop("dedup-symbols", "dedup-shared")
    wanted = hits.groupBy("text_key").agg(F.collect_set("symbol").alias("symbols"))

    # Copies of whole texts: the smallest document of a text stands for it.
    ids = docs.filter("doc_id is not null").select("doc_id", "text_key", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    first = scratch.write(ids.groupBy("text_key", "digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "dedup-texts")
    chosen = first.groupBy("text_key").agg(F.collect_set("first").alias("firsts")).join(wanted, "text_key").select(F.explode("firsts").alias("doc_id"), "text_key", "symbols")
    windows = scratch.write(candidate_windows(docs.join(chosen, ["doc_id", "text_key"]), window, group, rounds), "dedup-windows")

    scratch.drop("dedup-hits")
    names = ["name_a", "name_b"]
    least = windows.groupBy(*names).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    least = scratch.write(least, "dedup-least")
    found = scratch.write(windows.join(least, names).filter("least < doc_id").select("doc_id", "text_key", "start"), "dedup-repeated")
    scratch.drop("dedup-windows", "dedup-least")
    repeated = found.groupBy("doc_id", "text_key").agg(F.collect_list("start").alias("starts"))
    # Copies on one side, one row per text that has any on the other: Spark can split the copies of a text.
    several = first.filter("first < last").drop("last")
    copies = scratch.write(ids.join(several, ["text_key", "digest"]).filter("first < doc_id").select("doc_id", "text_key"), "dedup-copies").distinct()
    size = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    verdicts = scratch.write(
        repeated.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("starts", F.lit(None).cast("array<int>")).withColumn("whole", F.lit(True))),
        "dedup-verdicts",
    )
    scratch.drop("dedup-texts", "dedup-repeated", "dedup-copies")
    judged = docs.join(verdicts, ["doc_id", "text_key"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)) & (size >= window))
    return cut_words(judged, window)


def dedup_digests(documents: DataFrame, **options) -> DataFrame:
    """Per document its words, removed words and the digest of what is kept."""
    return deduplicate(documents, **options).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
