"""Benchmark decontamination with a distributed positional inverted index.

Index: the training documents are tokenised once, batch by batch.  Every batch
is a shard of the index with the postings of all its terms: for each term
(a 64-bit fingerprint of the word) the ordered positions of its tokens in the
shard, whose documents lie one after another with a free position between
them.  Shards are rows of a written table, so an index is as long as the
corpus, is never gathered anywhere, serves any test set, and survives a lost executor.

Search: a test item's windows (``window`` consecutive words; a shorter item is
one window) order their terms from the rarest in the whole corpus on; a window
with a term that the corpus lacks is left out.  In each shard the postings of
the windows' rarest terms, less their offsets, are the candidate starts; the
offset-adjusted postings of each further term are intersected with them, for all
windows of a block at a time, which makes the match exact.  ``span`` instead
finds the places where all terms of a window lie within that many words of one
document, in any order, anchored at the rarest.

Scale: building is one pass over the texts.  Term frequencies are partial sums
over the shards, for the terms of the test set only.  Windows, frequencies and
the items of a window stay Spark tables; windows are applied in blocks of about
``block_windows``: only one block at a time is on the driver and in a task, and
its matches are written before the next.  A block passes over the shards once, and a task has one shard in memory at a time:
a shard is a row group and an Arrow batch of its own.

Defined cases: a null or empty text has no words; an item without words has
no window; ids may be null or repeat (one result per document row; a repeated
item id is one item, a null one is left out); an empty table of documents gives an
empty result, an empty test set matches nothing; columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch, bound_batches, bounded_batches, lean, text_bytes

#: Bytes that belong to no word become spaces, A-Z becomes a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SHARD = "shard long, doc_ids array<long>, starts array<int>, sizes array<int>, terms array<long>, term_sizes array<int>, positions binary"
_HITS = "shard long, place int, spans array<struct<a:int,b:int>>, windows array<binary>"


def fold_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of letters and digits; all bytes beyond ASCII count as letters."""
    return raw.translate(_FOLD).split()


class _Terms(dict):
    """Signed 64-bit fingerprint by word; emptied at 200,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        term = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return term


_TERMS = _Terms()


def term_numbers(raw: bytes) -> np.ndarray:
    words = fold_words(raw)
    return np.fromiter(map(_TERMS.__getitem__, words), dtype=np.int64, count=len(words))


def build_index(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The shards of ``doc_id, text``, written."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            numbers = [term_numbers(raw) for raw in text_bytes(batch.column(1))]
            sizes = np.array(list(map(len, numbers)), dtype=np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1  # one free position after each document
            flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
            place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            terms, counts = np.unique(flat[order], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k], pa.int64()),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([terms], pa.list_(pa.int64())),
                    pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([place[order].astype("<i4").tobytes()], pa.binary()),
                ],
                names=["shard", "doc_ids", "starts", "sizes", "terms", "term_sizes", "positions"],
            )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.write(source.mapInArrow(lean(run), _SHARD), "positional-index", rows=1)


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, window, terms`` of the test items: a 128-bit name and the terms of every window, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, bytes, np.ndarray]] = []
            for item, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words, terms = fold_words(raw), term_numbers(raw)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    rows.append((item, xxhash.xxh3_128_digest(b" ".join(words[i : i + window])), terms[i : i + window]))
            items, names, terms = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(names, pa.binary()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "window", "terms"])

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    return source.mapInArrow(lean(run), "item_id long, window binary, terms array<long>").distinct()


def search_plans(index: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """``window, terms, offsets`` of the windows whose terms the corpus all has, the rarest term first."""
    asked = windows.select("window", "terms").distinct().select("window", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term"))
    asked = scratch.write(asked, "index-asked")
    postings = index.select(F.explode(F.arrays_zip("terms", "term_sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.term_sizes").alias("tokens"))
    frequency = postings.join(scratch.write(asked.select("term").distinct(), "index-terms"), "term", "left_semi").groupBy("term").agg(F.sum("tokens").alias("tokens"))
    order = F.sort_array(F.collect_list(F.struct("tokens", "offset", "term")))  # as long as a window
    plans = asked.join(scratch.write(frequency, "index-frequency"), "term").groupBy("window", "n").agg(order.alias("steps")).filter(F.size("steps") == F.col("n"))
    return plans.select("window", F.col("steps.term").alias("terms"), F.col("steps.offset").alias("offsets"))


class Block:
    """A block of search plans as arrays; windows shorter than the longest are padded."""

    def __init__(self, plans: pa.Table):
        self.names = plans.column("window").to_pylist()
        self.sizes = np.array([len(x) for x in plans.column("terms").to_pylist()], dtype=np.int64)
        width = int(self.sizes.max(initial=0))
        inside = np.arange(width) < self.sizes[:, None]
        self.terms, self.offsets = (np.zeros((len(self.names), width), dtype=np.int64) for _ in range(2))
        for out, column in ((self.terms, "terms"), (self.offsets, "offsets")):
            out[inside] = plans.column(column).combine_chunks().flatten().to_numpy()


class Shard:
    """The postings of one shard: terms, and the key ``term number << 32 | position`` of every token, in order."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray):
        self.terms, self.sizes = terms, sizes
        self.ends = np.cumsum(sizes)
        self.keys = (np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32) | positions

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in the shard, -1 for those that it lacks."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def anchors(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window and position of every posting of the windows' rarest terms, for windows whose terms the shard all has; the numbers of all terms."""
        number = np.full(block.terms.shape, -1)
        chosen = np.flatnonzero(self.number(block.terms[:, 0]) >= 0)
        number[chosen] = self.number(block.terms[chosen])
        inside = np.arange(number.shape[1]) < block.sizes[chosen, None]
        chosen = chosen[((number[chosen] >= 0) | ~inside).all(axis=1)]
        rarest = number[chosen, 0]
        count = self.sizes[rarest]
        place = np.repeat(self.ends[rarest] - np.cumsum(count), count) + np.arange(int(count.sum()))
        return np.repeat(chosen, count), self.keys[place] & 0xFFFFFFFF, number

    def has(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the term of each *number* has a token at each *position*."""
        wanted = (number << 32) | position
        return self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, start and end of every exact match."""
        window, place, number = self.anchors(block)
        start = place - block.offsets[window, 0] if len(window) else place
        window, start = window[start >= 0], start[start >= 0]
        for step in range(1, number.shape[1]):
            due = block.sizes[window] > step
            kept = ~due
            kept[due] = self.has(number[window[due], step], start[due] + block.offsets[window[due], step])
            window, start = window[kept], start[kept]
        return window, start, start + block.sizes[window]

    def spans(self, block: Block, span: int, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, start and end of all places where all terms lie within *span* words of one document."""
        window, place, number = self.anchors(block)
        doc = np.searchsorted(starts, place, side="right") - 1  # of the anchor
        found = [(window[:0], place[:0], place[:0])]
        for back in range(span):
            low = place - back
            high = np.minimum(low + span, stops[doc])
            ok = low >= starts[doc]
            for step in range(1, number.shape[1]):
                due = np.flatnonzero(ok & (block.sizes[window] > step))
                first = number[window[due], step] << 32
                at = np.searchsorted(self.keys, first | low[due])
                ok[due] = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] < (first | high[due]))
            found.append((window[ok], low[ok], high[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that many ranges cover together, ordered."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(low)) - 1
    return low[new], reach[last]


def search(index: DataFrame, block: Block, scratch: Scratch, span: int | None = None) -> DataFrame:
    """The matches of a block, written: per document (``shard, place``) with any its covered words and its windows."""
    shipped = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shipped.value
        for batch in batches:
            for k in range(batch.num_rows):
                starts, sizes, terms, term_sizes = (batch.column(i)[k].values.to_numpy().astype(np.int64) for i in range(1, 5))
                shard = Shard(terms, term_sizes, np.frombuffer(batch.column(5)[k].as_py(), dtype="<i4"))
                window, low, high = shard.phrases(plans) if span is None else shard.spans(plans, span, starts, starts + sizes)
                if not len(window):
                    continue
                doc = np.searchsorted(starts, low, side="right") - 1
                pairs = np.unique(doc * len(plans.names) + window)
                owner, name = pairs // len(plans.names), pairs % len(plans.names)
                places = np.unique(owner)
                a, b = merged(low, high)  # a free position parts documents, so no range holds two
                at = np.searchsorted(starts, a, side="right") - 1
                cuts = np.searchsorted(at, np.append(places, at[-1] + 1))
                spans = [[{"a": x, "b": y} for x, y in zip((a[i:j] - starts[p]).tolist(), (b[i:j] - starts[p]).tolist())] for p, i, j in zip(places, cuts, cuts[1:])]
                cuts = np.searchsorted(owner, np.append(places, owner[-1] + 1))
                names = [[plans.names[i] for i in name[x:y]] for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(places), batch.column(0)[k].as_py()), pa.int64()),
                        pa.array(places, pa.int32()),
                        pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        pa.array(names, pa.list_(pa.binary())),
                    ],
                    names=["shard", "place", "spans", "windows"],
                )

    found = index.select("shard", "starts", "sizes", "terms", "term_sizes", "positions").mapInArrow(lean(run), _HITS)
    with bounded_batches(index.sparkSession, rows=1):  # a shard has megabytes
        found = scratch.write(found, "index-hits")
    shipped.unpersist()
    return found


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, span: int | None = None, block_windows: int = 50_000) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` of every document: exact phrases, or with *span* proximity matches."""
    scratch = Scratch(documents.sparkSession)
    index = build_index(documents, scratch)
    windows = scratch.write(item_windows(benchmark, window), "index-windows")
    plans = scratch.write(search_plans(index, windows, scratch), "index-plans")
    blocks = -(-plans.count() // block_windows)
    hits = None
    for k in range(blocks):
        block = Block(plans.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).toArrow())
        if not block.names:
            continue
        found = search(index, block, scratch, span)
        hits = found if hits is None else hits.unionByName(found)
    docs = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("place", "x")).select("shard", "place", F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").cast("long").alias("n_words"))
    none = F.array().cast("array<long>")
    if hits is None:
        return scratch.finish(docs.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids")), "index")
    key = ["shard", "place"]
    # Words covered: each range, in order, adds what lies beyond the ranges before it.
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("words"))
    step = lambda seen, x: F.struct(F.greatest(seen["reach"], x["b"]).alias("reach"), (seen["words"] + F.greatest(x["b"] - F.greatest(seen["reach"], x["a"]), F.lit(0))).alias("words"))
    covered = hits.groupBy(*key).agg(F.aggregate(F.sort_array(F.flatten(F.collect_list("spans"))), zero, step, lambda x: x["words"]).alias("n_hit"))
    owners = hits.select(*key, F.explode("windows").alias("window")).join(windows.select("window", "item_id"), "window").select(*key, "item_id").distinct()
    items = owners.groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    found = docs.join(covered, key, "left").join(items, key, "left")
    return scratch.finish(found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids")), "index")


def decontamination_digests(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document its words, hit words and the digest of the items found in it."""
    found = find_contamination(documents, benchmark)
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
