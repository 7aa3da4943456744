"""Packing documents into sequences of a fixed length by cutting-stock column generation.

A document is its tokens and a closing id.  Pieces of the whole capacity come first,
what is left over is an item to be packed.

1. *Histogram.*  How many items of each length there are: at most ``capacity``
   numbers, all that the driver sees of the documents.
2. *Linear program.*  The least number of sequences over patterns (numbers of items by length that fit a
   sequence) that use up all items, by the revised simplex method.  It starts from a
   first-fit solution, and a knapsack over the lengths prices the columns: the dual
   values are the lengths' prices, and a pattern worth more than one sequence comes in.  It
   ends when the number is within ``gap``, or half a sequence, of the bound that the prices prove.
3. *Rounding.*  Patterns are rounded down.  Items over are a stream of tokens,
   which fills the room that patterns leave, then sequences of its own, and the last of
   it sequences of powers of two.  If the room is larger than the stream, sequences
   of the patterns with most room become stream, until it isn't.  So no sequence is padded, and only items of the stream are cut.
4. *Assignment.*  Items are ranked by length: ranges are sorted by themselves and their
   sizes give the offsets.  A rank's slot in the plan gives its sequence and place; the
   plan is a table of the patterns' entries.  Only the ids of items in the stream are read again.

Ranks have a last key, so a length that a third of the items have is spread over
many ranges.  The plan's size depends on the capacity, not on the documents.

Defined cases: a null or empty text is its closing id alone; rows are documents of
their own, whether or not ids repeat or are null; texts of any length are whole; an
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch, bound_batches, lean

CLOSING = 1
#: Words whose ids a task remembers (twice so many at most), and words that are encoded at a time.
_REMEMBERED, _TOGETHER = 250_000, 20_000


# tokens


#: Fixed value: the pattern by which the tokenizer cuts words; what it doesn't match is dropped.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII punctuation but for the apostrophe, which contractions begin with.
_MARKS = r"!-&(-/:-@\[-`{-~"
_BORDERS = (rf"([A-Za-z0-9])([{_MARKS}])", rf"([{_MARKS}])([A-Za-z0-9])")


class Encoder:
    """Ids of texts by a tokenizer that lower-cases, cuts by ``_PATTERN`` and drops white space.

    Nothing is joined across ASCII white space, nor across a border of an ASCII letter
    or digit and a mark, so a text's ids are those of its words one after another.  Each
    different word is encoded once and then remembered, as long as it was met lately.
    Texts that hold a special token's letters are cut at white space only.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = json.loads(definition)
        steps = [known["pre_tokenizer"], *known["pre_tokenizer"].get("pretokenizers", [])]
        if not any(x.get("pattern") == {"Regex": _PATTERN} and x["behavior"] == "Removed" and x["invert"] for x in steps):
            raise ValueError("packing needs a tokenizer that drops white space")
        if not any(x["type"] == "Lowercase" for x in [known["normalizer"], *known["normalizer"].get("normalizers", [])]):
            raise ValueError("packing needs a tokenizer that lower-cases")
        self.model = Tokenizer.from_str(definition)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [(t.content, i) for i, t in self.model.get_added_tokens_decoder().items()]
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _coded(self, words: list[str]) -> list[bytes]:
        """The packed ids of *words*: they are encoded in one go, with a special token between, but for words that hold one."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if not any(content in w for content, _ in self.special)] if self.special else []
        if plain:
            between, number = self.special[0]
            ids = np.array(self.model.encode_batch_fast([between.join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            borders = [-1, *np.flatnonzero(ids == number).tolist(), len(ids)]
            packed = ids.tobytes()
            out = {w: packed[4 * lo + 4 : 4 * hi] for w, lo, hi in zip(plain, borders, borders[1:], strict=False) if len(borders) == len(plain) + 1}
        rest = [w for w in words if w not in out]
        for word, coded in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False)):
            out[word] = np.array(coded.ids, dtype="<u4").tobytes()
        return [out[w] for w in words]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each of different *words* as packed 32-bit numbers."""
        found = {w: x for w in words if (x := self.lately.get(w) or self.before.get(w)) is not None}
        new = [w for w in words if w not in found]
        for at in range(0, len(new), _TOGETHER):
            some = new[at : at + _TOGETHER]
            found.update(zip(some, self._coded(some)))
        self.lately.update(found)
        if len(self.lately) > _REMEMBERED:
            self.before, self.lately = self.lately if len(self.lately) < 2 * _REMEMBERED else {}, {}
        return [found[w] for w in words]

    def _prepared(self, texts: pa.Array) -> pa.Array:
        """*texts* in small letters and with borders of words as spaces, where no special token is near."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = texts.take(pa.array(np.arange(len(texts))))  # no slice: Arrow's lower-casing forgets where one begins
        plain = texts
        for pattern in _BORDERS:
            plain = pc.replace_substring_regex(plain, pattern, r"\1 \2")
        plain = pc.ascii_lower(plain)
        for content, _ in self.special:
            plain = pc.if_else(pc.match_substring(texts, content), texts, plain)
        return plain

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of *texts* (null: none) one after another, and the number of each text's ids."""
        lists = pc.ascii_split_whitespace(self._prepared(texts))
        coded = lists.values.dictionary_encode()
        packed = self.words(coded.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        length = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
        start = np.cumsum(length) - length
        which = coded.indices.to_numpy(zero_copy_only=False)
        many = length[which]
        upto = np.concatenate(([0], np.cumsum(many)))
        out = ids[np.repeat(start[which] - upto[:-1], many) + np.arange(upto[-1])] if len(which) else ids[:0]
        offsets = lists.offsets.to_numpy()
        return out, upto[offsets[1:]] - upto[offsets[:-1]]


_encoders: dict[str, Encoder] = {}


def pieces(df: DataFrame, definition: str, capacity: int) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids_crc32, ids`` of *df* (``doc_id, text``): documents cut at multiples of *capacity*."""
    shipped = df.sparkSession.sparkContext.broadcast(definition)
    doc_id = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shipped.value not in _encoders:
            _encoders.clear()
            _encoders[shipped.value] = Encoder(shipped.value)
        encoder = _encoders[shipped.value]
        for batch in batches:
            ids, counts = encoder.encode(batch.column(1))
            owner, start, length, total, crc, packed = [], [], [], [], [], []
            at = 0
            for row, n in enumerate(counts.tolist()):
                whole = ids[at : at + n].tobytes() + CLOSING.to_bytes(4, "little")
                at += n
                for begin in range(0, n + 1, capacity):
                    part = whole[4 * begin : 4 * (begin + capacity)]
                    owner.append(row)
                    start.append(begin)
                    length.append(len(part) // 4)
                    total.append(n + 1)
                    crc.append(zlib.crc32(part))
                    packed.append(part)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return df.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {doc_id}, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


# the linear program


def best_patterns(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack: the largest worth of items that fit each room up to *capacity*, and an item of such a choice (0: leave one free).

    *price* is by length (index 0 unused); lengths that can't be taken have ``-inf``.
    """
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = price[1 : room + 1] + best[room - 1 :: -1][:room]
        at = int(worth.argmax())
        if worth[at] > best[room - 1]:
            best[room], pick[room] = worth[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, pick


def _read_off(pick: np.ndarray, room: int) -> list[int]:
    """The items of the best choice for *room*."""
    items = []
    while room > 0:
        length = int(pick[room])
        if length:
            items.append(length)
        room -= length or 1
    return items


def _first_fit(demand: np.ndarray, lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a feasible basis: the longest items that fit, repeated until a length is used up.

    A column has the length that it uses up and none that was used up before, so the columns are independent.
    """
    m, left, open_ = len(lengths), demand.astype(float), list(range(len(lengths)))
    columns = np.zeros((m, m))
    amount = np.zeros(m)
    for j in range(m):
        room, top, column = capacity, len(open_), np.zeros(m)
        while top and room:
            top = bisect_right(open_, room, hi=top, key=lambda i: lengths[i])
            if top:
                i = open_[top - 1]
                column[i] = room // lengths[i]
                room -= int(column[i]) * lengths[i]
                top -= 1
        used = np.flatnonzero(column)
        ratio = left[used] / column[used]
        gone = used[int(ratio.argmin())]
        amount[j] = max(0.0, float(ratio.min()))
        left[used] -= amount[j] * column[used]
        columns[:, j] = column
        open_.remove(int(gone))
    return columns, amount


def solve(histogram: dict[int, int], capacity: int, gap: float = 1e-3, slack: float = 0.5, offered: int = 64) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns with their (fractional) amounts that use up *histogram* (length: number), and a proven lower bound.

    Column generation: a round prices by one knapsack, offers the *offered* best
    patterns, and pivots until none of them helps.  It ends when the sum of amounts is within
    ``gap`` of the bound or *slack* sequences (which rounding loses anyway).
    """
    lengths = sorted(n for n, d in histogram.items() if d)
    if not lengths:
        return [], 0.0
    demand = np.array([histogram[n] for n in lengths], float)
    at = {n: i for i, n in enumerate(lengths)}
    m = len(lengths)
    basis, amount = _first_fit(demand, lengths, capacity)
    bound = float(demand @ np.array(lengths)) / capacity
    inverse, pivots = None, 0
    while amount.sum() > bound + max(gap * bound, slack):
        if inverse is None:
            inverse = np.linalg.inv(basis)
        dual = inverse.sum(axis=0)
        price = np.full(capacity + 1, -np.inf)
        price[lengths] = np.where(dual > 0, dual, -np.inf)
        best, pick = best_patterns(price, capacity)
        bound = max(bound, float(demand @ dual) / max(1.0, best[capacity]))  # prices, scaled so that no pattern is worth more than one
        if amount.sum() <= bound + max(gap * bound, slack) or best[capacity] <= 1 + 1e-9:
            break
        worth = sorted(((price[n] + best[capacity - n], n) for n in lengths if price[n] + best[capacity - n] > 1 + 1e-9), reverse=True)[:offered]
        pool = np.zeros((len(worth), m))
        for row, (_, n) in enumerate(worth):
            for item in (n, *_read_off(pick, capacity - n)):
                pool[row, at[item]] += 1
        before = pivots
        while True:
            gain = pool @ inverse.sum(axis=0)
            row = int(gain.argmax())
            if gain[row] <= 1 + 1e-9:
                break
            change = inverse @ pool[row]
            grows = change > 1e-9
            if not grows.any():
                break
            ratio = np.where(grows, amount / np.where(grows, change, 1), np.inf)
            leaves = int(ratio.argmin())
            step = max(0.0, float(ratio[leaves]))
            amount = np.maximum(amount - step * change, 0)
            amount[leaves] = step
            basis[:, leaves] = pool[row]
            pivot = inverse[leaves] / change[leaves]
            inverse -= np.outer(change, pivot)
            inverse[leaves] = pivot
            pivots += 1
            pool[row] = 0
            if pivots % 200 == 0:
                inverse = np.linalg.inv(basis)
                amount = np.maximum(inverse @ demand, 0)
        if pivots == before:
            break
    return [({lengths[i]: int(basis[i, j]) for i in np.flatnonzero(basis[:, j])}, float(amount[j])) for j in range(m) if amount[j] > 0], bound


# the plan


@dataclass
class Plan:
    """Where items go, by their place in the order of lengths.

    ``slots`` rows: first place, length, items in a sequence, first sequence, offset in it, start in the stream (-1: none).
    ``segments`` rows: start in the stream, tokens in a sequence, first sequence, offset in it.
    """

    slots: np.ndarray
    segments: np.ndarray


def rounded(patterns: list[tuple[dict[int, int], float]], histogram: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns a whole number of times, together within *histogram*."""
    whole = [[p, int(x + 1e-6)] for p, x in patterns]
    used: dict[int, int] = {}
    for p, times in whole:
        for n, a in p.items():
            used[n] = used.get(n, 0) + a * times
    for entry in whole:  # a large amount may be rounded a little too high
        over = max((-(-(used[n] - histogram[n]) // a) for n, a in entry[0].items() if used[n] > histogram[n]), default=0)
        over = min(over, entry[1])
        entry[1] -= over
        for n, a in entry[0].items():
            used[n] -= a * over
    return [(p, times) for p, times in whole if times]


def planned(histogram: dict[int, int], capacity: int, gap: float = 1e-3) -> Plan:
    """The plan of all items: rounded patterns, the stream for the rest."""
    chosen = [(p, times, capacity - sum(n * a for n, a in p.items())) for p, times in rounded(solve(histogram, capacity, gap)[0], histogram)]
    left = dict(histogram)
    for p, times, _ in chosen:
        for n, a in p.items():
            left[n] -= a * times
    stream, room = sum(n * d for n, d in left.items()), sum(times * free for _, times, free in chosen)
    kept = []
    for p, times, free in sorted(chosen, key=lambda x: -x[2]):  # most room first
        undone = min(times, -(-(room - stream) // capacity)) if room > stream else 0
        for n, a in p.items():
            left[n] += a * undone
        stream, room = stream + undone * (capacity - free), room - undone * free
        if times > undone:
            kept.append((p, times - undone, free))
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    segments, sequence, at = [], 0, 0
    for p, times, free in kept:
        offset = 0
        for n, a in sorted(p.items()):
            entries.setdefault(n, []).append((a * times, a, sequence, offset))
            offset += n * a
        if free:
            segments.append((at, free, sequence, offset))
            at += free * times
        sequence += times
    full = (stream - at) // capacity
    if full:
        segments.append((at, capacity, sequence, 0))
        at, sequence = at + full * capacity, sequence + full
    for bit in reversed(range(capacity.bit_length())):
        if (stream - at) >> bit & 1:
            segments.append((at, 1 << bit, sequence, 0))
            at, sequence = at + (1 << bit), sequence + 1
    slots, place, begin = [], 0, 0
    for n in sorted(histogram):
        for many, a, base, offset in entries.get(n, []):
            slots.append((place, n, a, base, offset, -1))
            place += many
        if left[n]:
            slots.append((place, n, 1, 0, 0, begin))
            place, begin = place + left[n], begin + n * left[n]
    return Plan(np.array(slots, np.int64).reshape(-1, 6), np.array(segments, np.int64).reshape(-1, 4))


def cuts(plan: Plan, at: int, length: int) -> list[tuple[int, int, int, int]]:
    """``start, length, sequence, offset`` of the parts of an item whose tokens begin at *at* of the stream."""
    out, done = [], 0
    while done < length:
        segment = plan.segments[np.searchsorted(plan.segments[:, 0], at + done, "right") - 1]
        number, inside = divmod(at + done - int(segment[0]), int(segment[1]))
        take = min(int(segment[1]) - inside, length - done)
        out.append((done, take, int(segment[2]) + number, int(segment[3]) + inside))
        done += take
    return out


# Spark


def _assigned(ranged: DataFrame, offsets: dict[int, int], plan: Plan) -> DataFrame:
    """*ranged* with ``sequence_id, offset`` by the plan, or the place in the stream (``at``; else -1)."""
    shipped = ranged.sparkSession.sparkContext.broadcast((offsets, plan))
    kept = ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    fields = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, plan = shipped.value
        for batch in batches:
            ranges = batch.column(len(kept)).to_numpy()
            found, which = np.unique(ranges, return_inverse=True)
            place = np.array([known[int(r)] for r in found], np.int64)[which] + batch.column(len(kept) + 1).to_numpy()
            slot = plan.slots[np.searchsorted(plan.slots[:, 0], place, "right") - 1]
            first, length, many, base, offset, stream = slot.T
            number, inside = np.divmod(place - first, many)
            columns = [base + number, offset + inside * length, np.where(stream >= 0, stream + (place - first) * length, -1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, columns)], names=[*kept, "sequence_id", "offset", "at"])

    return ranged.select(*kept, "range", "inside").mapInArrow(lean(run), ", ".join(f"{c} {fields[c]}" for c in kept) + ", sequence_id long, offset long, at long")


def _cut(stream: DataFrame, plan: Plan) -> DataFrame:
    """The parts of the items in the stream, with the checksums of their ids."""
    shipped = stream.sparkSession.sparkContext.broadcast(plan)
    doc_id = stream.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, lengths, positions, packed = (batch.column(i).to_pylist() for i in (1, 2, 4, 5))
            owner, rows = [], []
            for row, (start, length, at, ids) in enumerate(zip(starts, lengths, positions, packed)):
                for begin, n, sequence, offset in cuts(shipped.value, at, length):
                    owner.append(row)
                    rows.append((start + begin, n, zlib.crc32(ids[4 * begin : 4 * (begin + n)]), sequence, offset))
            start, length, crc, sequence, offset = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5))
            taken = batch.take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), start, length, crc, taken.column(3), sequence, offset], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    chosen = stream.select("doc_id", "start", "length", "doc_tokens", "at", "ids")
    return chosen.mapInArrow(lean(run), f"doc_id {doc_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 2048, gap: float = 1e-3) -> DataFrame:
    """Sequences of at most *capacity* tokens of *df* (``doc_id, text``): a row for each piece.

    Gives ``doc_id, start`` (the document's ids before it), ``length, ids_crc32``
    (of the ids as little-endian 32-bit numbers), ``doc_tokens, sequence_id, offset``.
    Every sequence has *capacity* tokens, or a power of two of them.
    """
    spark = df.sparkSession
    bound_batches(spark, rows=4000, size=16 << 20)
    scratch = Scratch(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    # A piece's number is the same whenever the written rows are read.
    found = scratch.write(pieces(df, definition, capacity).withColumn("piece", F.monotonically_increasing_id()), "packing-pieces", compression="zstd")
    rows = found.drop("ids").repartitionByRange("length", "piece").sortWithinPartitions("length", "piece")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # counts the rows of a partition in its order
    ranged = scratch.write(rows.withColumn("range", F.spark_partition_id()).withColumn("inside", number), "packing-ranged")
    histogram = {int(r["length"]): int(r["count"]) for r in ranged.groupBy("length").count().collect()}  # at most capacity rows
    offsets, total = {}, 0
    for r in sorted(ranged.groupBy("range").count().collect(), key=lambda r: r["range"]):  # as many as partitions
        offsets[int(r["range"])], total = total, total + int(r["count"])
    plan = planned(histogram, capacity, gap)
    assigned = scratch.write(_assigned(ranged, offsets, plan), "packing-assigned")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # Few items are in the stream as a rule; Spark reads from the written table how many.
    stream = scratch.write(assigned.filter("at >= 0").select("piece", "doc_id", "start", "length", "doc_tokens", "at"), "packing-stream")
    cut = _cut(stream.join(found.select("piece", "ids"), "piece"), plan)
    return scratch.finish(assigned.filter("at < 0").select(*columns).unionByName(cut.select(*columns)), "packing")
