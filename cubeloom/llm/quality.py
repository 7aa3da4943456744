"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text becomes a sparse vector: its words hashed into ``n_hash`` slots (log
counts, unit length), and its structure statistics (sizes, shares
of kinds of letters, repetition) and metadata (``n_chars``, where the table has
it), each put in one of ``n_bins`` bins whose edges are quantiles of the training sample.  The score is

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

the pair term in linear time by the sum-of-squares identity,
``0.5 * (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2)``, through a logistic link.

Fit: on the ``max_rows`` labelled training ids with the smallest hash
(a documented bound; labels only from training rows), one row each: of rows that
repeat an id the one whose vector is smallest, chosen on the executors.  Their vectors, at
most ``max_rows`` of them, go to the driver, where mini-batches with adaptive
steps fit the machine; a fixed seed makes the fit repeatable.  Scoring is one
map over all documents with the parameters broadcast (``n_hash + 32 * n_bins``
rows of ``rank + 1`` numbers, whatever the data).

Defined cases: a null text is an empty one, and is scored; ids may be null or
repeat (one score each; a null id is never trained on); a table without usable
labels gives every text the score of an untrained machine (0.5); labels other
than 0 and 1 or null are ignored, and so is an id with both; an empty table gives an empty table; further
columns are not read, and language, source and id are no inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import bound_batches, crc_fold, lean, text_bytes

_SEPARATORS = bytes(range(9, 14)) + b" "
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>{}[]\\^~=+@_/",
    "mark": b"!?",
    "stop": b".,;:",
    "line": b"\n",
    "space": _SEPARATORS,
    "high": bytes(range(128, 256)),
}
#: One row of 0/1 per kind of byte: counts by kind are one product with the counts by byte.
_KIND_ROWS = np.array([[b in kind for b in range(256)] for kind in _KINDS.values()], dtype=np.float64)
N_STATS = 21


def metadata(documents: DataFrame):
    """The column of a document's metadata: ``n_chars`` as a number, 0 where there is none."""
    column = F.col("n_chars").try_cast("double") if "n_chars" in documents.columns else F.lit(0.0)
    return F.greatest(F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def structure(raw: bytes, words: list[bytes], meta: float) -> list[float]:
    """Structure statistics of a text (all 0 for an empty one) and its metadata."""
    n = len(words)
    if not n:
        return [0.0] * (N_STATS - 1) + [np.log1p(meta)]
    kinds = _KIND_ROWS @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip(_SEPARATORS)]
    ends = [w[-1:] for w in words]
    single = sum(len(w) == 1 for w in words)
    return [
        np.log1p(size),
        np.log1p(n),
        np.log1p(len(lines)),
        *(kinds / size),
        size / n,
        distinct / n,
        pairs / max(n - 1, 1),
        same / n,
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        single / n,
        sum(e in _ODD_ENDS for e in ends) / n,
        max(map(len, words)) / size,
        np.log1p(meta),
    ]


_ODD_ENDS = {bytes([b]) for b in b"!#*$%&|<>@=+~^_"}


@dataclass(frozen=True)
class Machine:
    """Parameters of a fitted machine."""

    n_hash: int
    edges: np.ndarray  # (N_STATS, n_bins - 1)
    bias: float
    weights: np.ndarray  # (width,)
    factors: np.ndarray  # (width, rank)


class _Slots(dict):
    """Hash slot by word; emptied when it has 200,000 words."""

    def __init__(self, n_hash: int):
        super().__init__()
        self.n_hash = n_hash

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        slot = self[word] = zlib.crc32(word) % self.n_hash
        return slot


_SLOTS: dict[int, _Slots] = {}


def vectors(texts: list[bytes], metas: list[float], n_hash: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of the hashed words of *texts*, and their structure statistics."""
    slots = _SLOTS.setdefault(n_hash, _Slots(n_hash))
    keys, stats = [], []
    for k, (raw, meta) in enumerate(zip(texts, metas)):
        words = raw.lower().split()
        stats.append(structure(raw, words, meta))
        if words:
            keys.append(np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=len(words)) + k * n_hash)
    if not keys:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(float), np.array(stats).reshape(-1, N_STATS)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, value = key // n_hash, np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    return row, key % n_hash, value / norm[row], np.array(stats)


def binned(stats: np.ndarray, edges: np.ndarray, n_hash: int) -> np.ndarray:
    """The slot of every statistic's bin: one column per statistic."""
    n_bins = edges.shape[1] + 1
    return np.stack([n_hash + j * n_bins + np.searchsorted(edges[j], stats[:, j]) for j in range(N_STATS)], axis=1) if len(stats) else np.zeros((0, N_STATS), dtype=np.int64)


def scores(machine: Machine, texts: list[bytes], metas: list[float]) -> np.ndarray:
    """The machine's probability of a good text, by the sum-of-squares identity."""
    row, slot, value, stats = vectors(texts, metas, machine.n_hash)
    bins = binned(stats, machine.edges, machine.n_hash)
    n = len(texts)
    v = machine.factors
    linear = machine.bias + machine.weights[bins].sum(axis=1)
    total, squares = v[bins].sum(axis=1), (v[bins] ** 2).sum(axis=(1, 2))
    if len(row):
        linear += np.bincount(row, weights=machine.weights[slot] * value, minlength=n)
        for k in range(v.shape[1]):
            part = v[slot, k] * value
            total[:, k] += np.bincount(row, weights=part, minlength=n)
            squares += np.bincount(row, weights=part * part, minlength=n)
    margin = linear + 0.5 * ((total**2).sum(axis=1) - squares)
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def _fit(rows: list, n_hash: int, n_bins: int, rank: int, epochs: int, seed: int) -> Machine:
    rng = np.random.default_rng(seed)
    width = n_hash + N_STATS * n_bins
    weights, factors, bias = np.zeros(width), rng.normal(0, 0.01, (width, rank)), 0.0
    stats = np.array([r["stats"] for r in rows]).reshape(-1, N_STATS)
    if not len(rows) or len({r["label"] for r in rows}) < 2:
        return Machine(n_hash, np.zeros((N_STATS, n_bins - 1)), 0.0, weights, np.zeros((width, rank)))
    edges = np.quantile(stats, np.linspace(0, 1, n_bins + 1)[1:-1], axis=0).T.copy()
    bins = binned(stats, edges, n_hash)
    label = np.array([r["label"] for r in rows], dtype=float)
    slots = [np.concatenate([np.frombuffer(r["slots"], dtype="<i4"), b]) for r, b in zip(rows, bins)]
    values = [np.concatenate([np.frombuffer(r["values"], dtype="<f4"), np.ones(N_STATS)]) for r in rows]
    grad_w, grad_v, grad_b = np.full(width, 1e-6), np.full((width, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            slot = np.concatenate([slots[i] for i in batch])
            x = np.concatenate([values[i] for i in batch])
            at = np.repeat(np.arange(len(batch)), [len(slots[i]) for i in batch])
            vx = factors[slot] * x[:, None]
            total = np.zeros((len(batch), rank))
            np.add.at(total, at, vx)
            margin = bias + np.bincount(at, weights=weights[slot] * x, minlength=len(batch))
            margin += 0.5 * ((total**2).sum(axis=1) - np.bincount(at, weights=(vx**2).sum(axis=1), minlength=len(batch)))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[batch]) / len(batch)
            used, place = np.unique(slot, return_inverse=True)
            g_w = np.bincount(place, weights=error[at] * x) + 1e-5 * weights[used]
            g_v = np.zeros((len(used), rank))
            np.add.at(g_v, place, (error[at] * x)[:, None] * (total[at] - vx))
            g_v += 1e-5 * factors[used]
            grad_w[used] += g_w**2
            grad_v[used] += g_v**2
            grad_b += error.sum() ** 2
            weights[used] -= 0.1 * g_w / np.sqrt(grad_w[used])
            factors[used] -= 0.03 * g_v / np.sqrt(grad_v[used])
            bias -= 0.1 * error.sum() / np.sqrt(grad_b)
    return Machine(n_hash, edges, float(bias), weights, factors)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 6000, n_hash: int = 1 << 13, n_bins: int = 8, rank: int = 6, epochs: int = 4, seed: int = 7) -> Machine:
    """Fit on at most *max_rows* labelled rows whose crc32 fold (of five) isn't 0."""
    bound_batches(documents.sparkSession)
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other")).filter("label = other")
    chosen = marks.filter(crc_fold("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "label")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), metadata(documents).alias("meta")).join(F.broadcast(chosen), "doc_id")  # at most max_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, slot, value, stats = vectors(text_bytes(batch.column(1)), batch.column(2).to_pylist(), n_hash)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(3),
                    pa.array([slot[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([s.tolist() for s in stats], pa.list_(pa.float64())),
                ],
                names=["doc_id", "label", "slots", "values", "stats"],
            )

    sample = texts.select("doc_id", "text", "meta", "label").mapInArrow(lean(run), "doc_id long, label int, slots binary, values binary, stats array<double>")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("slots", "values", "stats", "label")).alias("row")).select("doc_id", "row.*")
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    return _fit(rows, n_hash, n_bins, rank, epochs, seed)


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row."""
    bound_batches(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(shipped.value, text_bytes(batch.column(1)), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), metadata(documents).alias("meta")).mapInArrow(lean(run), "doc_id long, score double")


def keep_good(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of *documents*, with all their columns, whose text scores *threshold* or more."""
    bound_batches(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(machine)
    names, at, width = documents.columns, documents.columns.index("text"), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = scores(shipped.value, text_bytes(batch.column(at)), batch.column(width).to_pylist()) >= threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:width], names=names).filter(pa.array(good))

    # Columns go by number, whatever their names are.
    numbered = documents.select("*", metadata(documents)).toDF(*(f"c{i}" for i in range(width + 1)))
    return numbered.mapInArrow(lean(run), documents.schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    scored = score(documents, fit(documents, labels, **options))
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
