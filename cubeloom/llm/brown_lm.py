"""Language-model scores by a Brown class bigram model.

A token's probability is that of its class after the class before it, times
that of the word in its class; a text ends with an end token, which also
stands before its first word.

1. One pass encodes the texts in chunks: a chunk has its own list of distinct
   words with their training counts, and its texts as numbers into that list.
   The chunks are written; texts aren't read again.
2. The chunks' words are summed into the training counts of all words, written.
3. Frequent words (``unit_share`` of the training tokens or more, so at most
   ``1 / unit_share`` of them) and the endings of the others, ``ENDINGS`` of
   them, are clustered first: Spark sums each one's neighbours by class, the driver
   (units times classes numbers, bounded as the units are) moves each unit
   to the class that raises the likelihood of the class bigrams most, in rounds until few move.
4. Exchange of all other words seen ``min_count`` times or more, each by its own
   neighbours: one pass over the chunks lists the classes of the units beside every word,
   and each word moves to the class that raises the likelihood most.  Words are dealt into
   shares, and a share moves them lot by lot against class bigrams that its moves change
   (:func:`exchanged_words`).  Words seen less often keep the class of their ending.
5. Classes and counts return to the chunks by one join on words; class bigrams
   are counted again over all training texts, and the chunks are scored.

Transitions are smoothed towards class frequencies with ``prior`` counts.
Emissions are discounted absolutely in each class; the mass goes to the
words unseen in it, as many as were seen and one more.  Both sum to one.

Scale: shuffles carry a chunk's distinct words, not tokens.  A word's
counts are pre-aggregated by chunk, and so are the classes beside it (two numbers a
class and side at most); in step 4 a partition is sorted and read as a
stream, whatever one word's part in it, and shares grow in number with the words.  A chunk's size is bounded by
``chunk_rows`` rows and the Arrow batch limit.

Defined cases: a null text is empty and has its end token only; ids may be
null (trained on) or repeat (one row each); without training texts all counts
are 0 and any token has base probability 1; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch, bound_batches, crc_fold, lean, text_bytes

ENDINGS = 512
#: Words that are exchanged are dealt into shares of about so many, and those into so many lots.
SHARE_WORDS, LOTS = 30_000, 256
_END = ENDINGS  # the end token's unit; units of their own follow
_CHUNK = "chunk_id long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words array<binary>, counts array<int>, endings array<short>"


class _Local(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def ending_of(word: bytes) -> int:
    """The unit of rare words with this ending (two last bytes, and whether all letters are ASCII)."""
    return zlib.crc32(word[-2:] + (b"" if word.isascii() else b"~")) % ENDINGS


def encode_chunks(documents: DataFrame, chunk_rows: int) -> DataFrame:
    """The texts of ``doc_id, held_out, text`` in chunks of numbered words."""
    bound_batches(documents.sparkSession, rows=chunk_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            local = _Local()
            held = np.array(batch.column(1).to_pylist(), dtype=bool)
            numbers = []
            for raw in text_bytes(batch.column(2)):
                words = raw.lower().split()
                numbers.append(np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words)))
            sizes = np.array(list(map(len, numbers)), dtype=np.int32)
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            counts = np.bincount(flat[~np.repeat(held, sizes)], minlength=len(local)).astype(np.int32)
            words = list(local)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k], pa.int64()),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([flat.astype("<i4").tobytes()], pa.binary()),
                    pa.array([words], pa.list_(pa.binary())),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([[ending_of(w) for w in words]], pa.list_(pa.int16())),
                ],
                names=["chunk_id", "doc_ids", "held", "sizes", "tokens", "words", "counts", "endings"],
            )

    return documents.mapInArrow(lean(run), _CHUNK)


def with_ends(values: np.ndarray, sizes: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """*values* of texts one after another with *end* after each text; where each text begins."""
    stops = np.cumsum(sizes)
    return np.insert(values, stops, end), stops - sizes + np.arange(len(sizes))


def unit_bigrams(chunks: DataFrame, units: dict[bytes, int], n_units: int, buffer: int = 2_000_000) -> DataFrame:
    """``a, b, n``: how often unit *b* follows unit *a* in training texts, summed."""
    shipped = chunks.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, keys, counts = shipped.value.get, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((keys // n_units).astype(np.int32)), pa.array((keys % n_units).astype(np.int32)), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            for held, sizes, tokens, words, endings in zip(*(batch.column(i) for i in range(5))):
                sizes, held = np.array(sizes.as_py(), dtype=np.int64), np.array(held.as_py(), dtype=bool)
                unit = np.array([find(w, e) for w, e in zip(words.as_py(), endings.as_py())], dtype=np.int64)
                flat = np.frombuffer(tokens.as_py(), dtype="<i4")[~np.repeat(held, sizes)]
                if held.all():
                    continue
                line, _ = with_ends(unit[flat] if len(flat) else np.zeros(0, np.int64), sizes[~held], _END)
                pairs, n = np.unique(np.concatenate([[_END], line[:-1]]) * n_units + line, return_counts=True)
                keys, where = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > buffer:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
        yield rows()

    needed = chunks.select("held", "sizes", "tokens", "words", "endings")
    return needed.mapInArrow(lean(run), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_round(classes: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, movable: np.ndarray, n_classes: int) -> int:
    """Move every movable unit to its best class, the others standing still; how many moved.

    ``after[u, c]`` and ``before[u, c]`` count the class-*c* neighbours of unit *u*
    on either side, ``own[u]`` its bigrams with itself.  *classes* is changed in place.
    """
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, classes, after)
    moved = 0
    for u in movable:
        a = classes[u]
        right, left = after[u].copy(), before[u].copy()
        right[a] -= own[u]
        left[a] -= own[u]
        rest = table.copy()
        rest[a] -= right
        rest[:, a] -= left
        rest[a, a] -= own[u]
        rest = np.maximum(rest, 0)
        rows, columns = rest.sum(axis=1), rest.sum(axis=0)
        gain = (_xlogx(rest + right) - _xlogx(rest)).sum(axis=1) + (_xlogx(rest.T + left) - _xlogx(rest.T)).sum(axis=1)
        corner = np.diagonal(rest)
        gain += _xlogx(corner + right + left + own[u]) + _xlogx(corner) - _xlogx(corner + right) - _xlogx(corner + left)
        total_right, total_left = right.sum() + own[u], left.sum() + own[u]
        gain -= _xlogx(rows + total_right) - _xlogx(rows) + _xlogx(columns + total_left) - _xlogx(columns)
        gain[-1] = -np.inf  # the end token's own class
        b = int(np.argmax(gain))
        if b == a or gain[b] <= gain[a] + 1e-9:
            continue
        rest[b] += right
        rest[:, b] += left
        rest[b, b] += own[u]
        table, classes[u] = rest, b
        moved += 1
    return moved


def exchange_clustering(bigrams: DataFrame, weight: np.ndarray, n_classes: int, max_rounds: int) -> np.ndarray:
    """The class of each unit; the last class holds the end token alone."""
    spark = bigrams.sparkSession
    order = np.lexsort((np.arange(len(weight)), -weight))
    order = order[order != _END]
    classes = np.zeros(len(weight), dtype=np.int64)
    classes[order] = np.arange(len(order)) % n_classes
    classes[_END] = n_classes
    movable = [u for u in order if weight[u] > 0]
    own = np.zeros(len(weight))
    for a, n in bigrams.filter("a = b").select("a", "n").collect():
        own[a] = n
    for _ in range(max_rounds):
        place = F.broadcast(spark.createDataFrame(list(enumerate(classes.tolist())), "unit int, class int"))  # as many rows as units
        tables = []
        for unit, other in (("a", "b"), ("b", "a")):
            out = np.zeros((len(weight), n_classes + 1))
            sums = bigrams.join(place, bigrams[other] == place["unit"]).groupBy(F.col(unit).alias("u"), "class").agg(F.sum("n").alias("n"))
            found = sums.toPandas()
            out[found["u"], found["class"]] = found["n"]
            tables.append(out)
        if exchange_round(classes, *tables, own, movable, n_classes + 1) <= 0.01 * len(movable):
            break
    return classes


def neighbour_classes(chunks: DataFrame, unit_class: dict[bytes, int], ending_class: np.ndarray, n_classes: int) -> DataFrame:
    """``word, n, around``: for every chunk and training word that is no unit, how often it is there, and the classes of units beside it.

    *around* packs ``code, count`` as 32-bit numbers; the code is the class, plus *n_classes* for the one before the word.
    Words that are no units themselves may move in the same round and are no evidence.
    """
    shipped = chunks.sparkSession.sparkContext.broadcast((unit_class, ending_class))
    end = n_classes - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, by_ending = shipped.value
        for batch in batches:
            for held, sizes, tokens, words, endings in zip(*(batch.column(i) for i in range(5))):
                held, sizes, words = np.array(held.as_py(), dtype=bool), np.array(sizes.as_py(), dtype=np.int64), words.as_py()
                flat = np.frombuffer(tokens.as_py(), dtype="<i4")[~np.repeat(held, sizes)].astype(np.int64)
                if not len(flat):
                    continue
                known = np.array([units.get(w, -1) for w in words], dtype=np.int64)
                own = np.where(known >= 0, known, by_ending[np.array(endings.as_py(), dtype=np.int64)])
                line, _ = with_ends(own[flat], sizes[~held], end)
                place, _ = with_ends(flat, sizes[~held], -1)
                free = (place >= 0) & (known[np.maximum(place, 0)] < 0)
                before, fixed_before = np.concatenate([[end], line[:-1]]), np.concatenate([[True], ~free[:-1]])
                after, fixed_after = np.append(line[1:], end), np.append(~free[1:], True)
                right, left = np.flatnonzero(free & fixed_after), np.flatnonzero(free & fixed_before)
                keys = np.concatenate([place[right] * (2 * n_classes) + after[right], place[left] * (2 * n_classes) + n_classes + before[left]])
                keys, count = np.unique(keys, return_counts=True)
                total = np.bincount(place[free], minlength=len(words))
                listed = np.flatnonzero(total)
                packed = np.stack([keys % (2 * n_classes), count], axis=1).astype("<i4").tobytes()
                cuts = np.searchsorted(keys, np.append(listed, len(words)) * (2 * n_classes)) * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in listed], pa.binary()), pa.array(total[listed], pa.int64()), pa.array([packed[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())],
                    names=["word", "n", "around"],
                )

    return chunks.select("held", "sizes", "tokens", "words", "endings").mapInArrow(lean(run), "word binary, n long, around binary")


def best_classes(word: np.ndarray, code: np.ndarray, count: np.ndarray, own: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The class of most likelihood for each of many words, the class bigrams standing still.

    ``word, code, count``: entries in the order of words, as in :func:`neighbour_classes`;
    *own*: the classes now; *both*: by code, the bigrams of each class with that neighbour.
    A word is taken out of its own class first, so staying is judged as moving is.
    """
    n, classes = len(own), both.shape[1]
    ends = both.reshape(2, classes, classes).sum(axis=1)
    gain, once = np.zeros((n, classes)), _xlogx(both + 1) - _xlogx(both)
    for lot in np.array_split(np.arange(len(word)), len(word) // 20_000 + 1):
        if not len(lot):
            continue
        w, c, k = word[lot], code[lot], count[lot].astype(float)
        change = once[c]
        several = np.flatnonzero(k > 1)
        cells = both[c[several]]
        change[several] = _xlogx(cells + k[several, None]) - _xlogx(cells)
        rest = np.maximum(both[c, own[w]] - k, 0)
        change[np.arange(len(lot)), own[w]] = _xlogx(rest + k) - _xlogx(rest)
        cut = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        np.add.at(gain, w[cut], np.add.reduceat(change, cut, axis=0))
    for side in range(2):
        of_side = (code >= classes) == bool(side)
        total = np.bincount(word[of_side], weights=count[of_side], minlength=n)
        rest = np.repeat(ends[side][None, :], n, axis=0)
        rest[np.arange(n), own] = np.maximum(rest[np.arange(n), own] - total, 0)
        gain -= _xlogx(rest + total[:, None]) - _xlogx(rest)
    gain[:, -1] = -np.inf  # the end token's own class
    best = gain.argmax(axis=1)
    stay = gain[np.arange(n), own] >= gain[np.arange(n), best] - 1e-9
    return np.where(stay, own, best)


def exchanged_words(around: DataFrame, ending_class: np.ndarray, both: np.ndarray, min_count: int, shares: int) -> DataFrame:
    """``word, class`` of the words of *around* that were seen *min_count* times or more.

    Words are dealt by hash into *shares* of ``LOTS`` lots.  A share goes
    through its lots in turn and moves a lot at a time; as every other share does the like, the
    bigrams that a move changes count *shares* times in the share's own table.
    """
    shipped = around.sparkSession.sparkContext.broadcast((ending_class, both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_ending, start = shipped.value
        classes = start.shape[1]
        share, lot, table = -1, -1, start.copy()
        words: list[bytes] = []  # of the lot so far
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def decided() -> pa.RecordBatch:
            word, code = keys // (2 * classes), keys % (2 * classes)
            chosen = np.flatnonzero(np.array(totals) >= min_count)
            names = [words[i] for i in chosen]
            own = by_ending[np.array([ending_of(w) for w in names], dtype=np.int64)]
            inside = np.isin(word, chosen)
            word, code, count = np.searchsorted(chosen, word[inside]), code[inside], counts[inside]
            best = best_classes(word, code, count, own, table)
            np.add.at(table, (code, own[word]), -shares * count)
            np.add.at(table, (code, best[word]), shares * count)
            np.maximum(table, 0, out=table)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(best, pa.int32())], names=["word", "class"])

        totals: list[int] = []
        for batch in batches:
            of_share, of_lot, name, n, packed = (batch.column(i).to_pylist() for i in range(5))
            at = 0
            while at < len(name):
                if (of_share[at], of_lot[at]) != (share, lot):
                    if words:
                        yield decided()
                    if of_share[at] != share:
                        table = start.copy()
                    share, lot, words, totals = of_share[at], of_lot[at], [], []
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                end = at
                number = []
                while end < len(name) and of_lot[end] == lot and of_share[end] == share:
                    if not words or words[-1] != name[end]:
                        words.append(name[end])
                        totals.append(0)
                    totals[-1] += n[end]
                    number.append(len(words) - 1)
                    end += 1
                entries = np.frombuffer(b"".join(packed[at:end]), dtype="<i4").reshape(-1, 2)
                fresh = np.repeat(np.array(number, dtype=np.int64), [len(x) // 8 for x in packed[at:end]]) * (2 * classes) + entries[:, 0]
                keys, where = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, entries[:, 1]])).astype(np.int64)
                at = end
        if words:
            yield decided()

    hashed = F.xxhash64("word")
    dealt = around.select(F.pmod(hashed, F.lit(shares)).cast("int").alias("share"), F.pmod(F.shiftright(hashed, 20), F.lit(LOTS)).cast("int").alias("lot"), "word", "n", "around")
    return dealt.repartition("share").sortWithinPartitions("share", "lot", "word").mapInArrow(lean(run), "word binary, class int")


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs of a fitted model; all of it is bounded by the numbers of endings and classes."""

    by_ending: np.ndarray  # class of unseen words
    transitions: np.ndarray  # log10 P(class | class before)
    total: np.ndarray  # training tokens by class
    discount: np.ndarray  # by class
    unseen: np.ndarray  # log10 P(one unseen word | class)
    train_tokens: int
    end_count: int
    distinct: int


def emissions(model: ClassModel, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log10 P(word | class) of words with training counts *n* in classes *own*."""
    seen = np.log10(np.maximum(n - model.discount[own], 1e-9) / np.maximum(model.total[own], 1))
    return np.where(n > 0, seen, model.unseen[own])


def unit_classes(chunks: DataFrame, vocabulary: DataFrame, tokens: int, ends: int, unit_share: float, n_classes: int, max_rounds: int, scratch: Scratch) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Classes of the frequent words, of the endings, and by code (as in :func:`neighbour_classes`) the bigrams of each class with units beside it."""
    frequent = sorted((bytes(w), n) for w, n in vocabulary.filter(F.col("n") >= unit_share * max(tokens, 1)).select("word", "n").collect())
    units = {w: _END + 1 + i for i, (w, _) in enumerate(frequent)}
    n_units = _END + 1 + len(units)
    weight = np.zeros(n_units)
    for ending, n in vocabulary.filter(F.col("n") < unit_share * max(tokens, 1)).groupBy("ending").agg(F.sum("n")).collect():
        weight[ending] = n
    for w, n in frequent:
        weight[units[w]] = n
    weight[_END] = ends
    bigrams = scratch.write(unit_bigrams(chunks, units, n_units), "brown-bigrams")
    classes = exchange_clustering(bigrams, weight, n_classes, max_rounds)
    place = F.broadcast(chunks.sparkSession.createDataFrame(list(enumerate(classes.tolist())), "unit int, class int"))  # as many rows as units
    both = np.zeros((2 * (n_classes + 1), n_classes + 1))
    for side, (word, unit) in enumerate((("a", "b"), ("b", "a"))):
        pairs = bigrams.filter(F.col(unit) >= _END).join(place.select(F.col("unit").alias(unit), F.col("class").alias("x")), unit).join(place.select(F.col("unit").alias(word), F.col("class").alias("y")), word)
        for x, y, n in pairs.groupBy("x", "y").agg(F.sum("n")).collect():
            both[x + side * (n_classes + 1), y] = n
    scratch.drop("brown-bigrams")
    return {w: int(classes[u]) for w, u in units.items()}, classes[:ENDINGS].copy(), both


def class_bigrams(labelled: DataFrame, n_classes: int) -> np.ndarray:
    """How often each class follows each in training texts; the last is the end token's."""
    size = n_classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for held, sizes, tokens, classes in zip(*(batch.column(i) for i in range(4))):
                held, sizes = np.array(held.as_py(), dtype=bool), np.array(sizes.as_py(), dtype=np.int64)
                if held.all():
                    continue
                flat = np.frombuffer(tokens.as_py(), dtype="<i4")[~np.repeat(held, sizes)]
                own = np.frombuffer(classes.as_py(), dtype="<i2").astype(np.int64)
                line, _ = with_ends(own[flat], sizes[~held], n_classes)
                total += np.bincount(np.concatenate([[n_classes], line[:-1]]) * size + line, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    table = np.zeros((size, size))
    found = labelled.select("held", "sizes", "tokens", "classes").mapInArrow(lean(run), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for a, b, n in found.collect():
        table[a, b] = n
    return table


_LABELLED = "doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, classes binary, counts binary"


def labelled_chunks(chunks: DataFrame, known: DataFrame, by_ending: np.ndarray) -> DataFrame:
    """The chunks with the class and the training count of each of their words in place of the words.

    *known* has ``chunk_id, at, n, class`` of the chunks' words that were seen in training.
    """
    shipped = chunks.sparkSession.sparkContext.broadcast(by_ending)
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("classes", pa.binary()), ("counts", pa.binary())])

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        endings = np.array(chunk.column("endings")[0].as_py(), dtype=np.int64)
        own, n = shipped.value[endings].astype("<i2"), np.zeros(len(endings), dtype="<i8")
        at = found.column("at").to_numpy()
        own[at], n[at] = found.column("class").to_numpy(), found.column("n").to_numpy()
        return chunk.select(["doc_ids", "held", "sizes", "tokens"]).append_column("classes", pa.array([own.tobytes()], pa.binary())).append_column("counts", pa.array([n.tobytes()], pa.binary())).cast(schema)

    left = chunks.select("chunk_id", "doc_ids", "held", "sizes", "tokens", "endings").groupBy("chunk_id")
    right = known.select(F.col("chunk_id").alias("of_chunk"), "at", "n", "class").groupBy("of_chunk")
    return left.cogroup(right).applyInArrow(run, _LABELLED)


def fit(labelled: DataFrame, words: DataFrame, by_ending: np.ndarray, tokens: int, ends: int, distinct: int, n_classes: int, prior: float) -> ClassModel:
    """The model of the classes in *labelled*; *words* has ``class, n`` of all training words."""
    sums = np.zeros((n_classes + 1, 4))
    for c, *x in words.groupBy("class").agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).collect():
        sums[c] = x
    sums[-1] = (ends, 1, ends == 1, ends == 2)
    table = class_bigrams(labelled, n_classes)
    share = (sums[:, 0] + 1) / (sums[:, 0] + 1).sum()
    transitions = np.log10((table + prior * share) / (table.sum(axis=1, keepdims=True) + prior))
    total, kinds, once, twice = sums.T
    discount = np.where(once > 0, np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9), 0.5)
    unseen = np.log10(np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0) / (kinds + 1))
    discount[-1] = 0.0
    return ClassModel(by_ending, transitions, total, discount, unseen, int(tokens), int(ends), int(distinct) + (ends > 0))


def score_chunks(labelled: DataFrame, model: ClassModel) -> DataFrame:
    """The scores of all texts of *labelled* chunks."""
    shipped = labelled.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        end = len(m.transitions) - 1
        for batch in batches:
            for doc_ids, held, sizes, tokens, classes, counts in zip(*(batch.column(i) for i in range(6))):
                sizes, own, n = np.array(sizes.as_py(), dtype=np.int64), np.frombuffer(classes.as_py(), dtype="<i2"), np.frombuffer(counts.as_py(), dtype="<i8").astype(float)
                emit, base = emissions(m, n, own), np.log10((n + 1) / (m.train_tokens + m.distinct + 1))
                flat = np.frombuffer(tokens.as_py(), dtype="<i4")
                line, starts = with_ends(own[flat].astype(np.int64), sizes, end)
                step = m.transitions[np.concatenate([[end], line[:-1]]), line] + with_ends(emit[flat], sizes, 0.0)[0]
                plain = with_ends(base[flat], sizes, np.log10((m.end_count + 1) / (m.train_tokens + m.distinct + 1)))[0]
                seen = with_ends((n > 0)[flat], sizes, m.end_count > 0)[0]
                score = np.add.reduceat(step, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids.as_py(), pa.int64()),
                        pa.array(held.as_py(), pa.bool_()),
                        pa.array(sizes + 1),
                        pa.array(np.add.reduceat(seen.astype(np.int64), starts)),
                        pa.array(np.full(len(sizes), m.train_tokens, dtype=np.int64)),
                        pa.array(np.add.reduceat(plain, starts)),
                        pa.array(score),
                        pa.array(10 ** np.minimum(-score / (sizes + 1), 300.0)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return labelled.mapInArrow(lean(run), schema)


def score_documents(
    documents: DataFrame,
    folds: int = 7,
    held_fold: int = 2,
    unit_share: float = 1e-4,
    min_count: int = 2,
    n_classes: int = 64,
    prior: float = 20.0,
    max_rounds: int = 10,
    chunk_rows: int = 4000,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", folds) == held_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    chunks = scratch.write(encode_chunks(docs, chunk_rows), "brown-chunks", "zstd")
    listed = chunks.select(F.explode(F.arrays_zip("words", "counts", "endings")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").cast("long").alias("n"), F.col("x.endings").alias("ending"))
    vocabulary = scratch.write(listed.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"), F.max("ending").alias("ending")), "brown-words", "zstd")
    ends = chunks.select(F.explode("held").alias("held")).filter("not held").count()
    count, distinct = vocabulary.agg(F.sum("n"), F.count("*")).first()
    tokens = (count or 0) + ends

    units, by_ending, both = unit_classes(chunks, vocabulary, tokens, ends, unit_share, n_classes, max_rounds, scratch)
    bound_batches(spark, rows=10_000)  # rows of words, not of chunks
    moved = exchanged_words(neighbour_classes(chunks, units, by_ending, n_classes + 1), by_ending, both, min_count, max(1, distinct // SHARE_WORDS))
    frequent = spark.createDataFrame([(bytearray(w), c) for w, c in units.items()], "word binary, class int")  # at most 1 / unit_share rows
    classes = scratch.write(moved.unionByName(frequent), "brown-classes", "zstd")
    endings = F.broadcast(spark.createDataFrame(list(enumerate(by_ending.tolist())), "ending short, by_ending int"))  # ENDINGS rows
    words = vocabulary.join(classes, "word", "left").join(endings, "ending").select("word", "n", F.coalesce("class", "by_ending").alias("class"))
    words = scratch.write(words, "brown-known", "zstd")
    scratch.drop("brown-words", "brown-classes")
    places = chunks.select("chunk_id", F.posexplode("words").alias("at", "word"))
    # Written by itself, so that the shuffles of the join are gone when those of the chunks begin.
    placed = scratch.write(places.join(words, "word").select("chunk_id", "at", "n", "class"), "brown-placed", "zstd")
    labelled = scratch.write(labelled_chunks(chunks, placed, by_ending), "brown-labelled", "zstd")
    scratch.drop("brown-chunks", "brown-placed")
    model = fit(labelled, words, by_ending, tokens, ends, distinct, n_classes, prior)
    return scratch.finish(score_chunks(labelled, model), "brown")
