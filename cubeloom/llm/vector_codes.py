"""Vector code compression: a product quantiser over distinct integer parts.

Components become integers, a vector is cut into equal consecutive parts, and
each part's place in a codebook of its position is its code.

1. *Distinct parts.*  Equal parts of a position are one row with a weight, counted
   with partial sums before the shuffle: a vector that a third of the rows have is
   a row a task.
2. *Weighted Lloyd.*  The codebooks (positions times entries, bounded by
   parameters) are shipped; a task assigns its distinct parts and adds weighted
   sums, at most one row for an entry and axis; Spark adds these up, and the new
   entries come back.  No round touches the vectors.
3. *Joining back.*  The codes and errors of distinct parts are joined to the
   vectors' parts by position and value, and a vector's parts are added up: a code takes
   its own byte of a number, so this is a sum too.  Parts that more than one in
   ``_HEAVY`` of all vectors have are at most ``_HEAVY`` a position; they are
   broadcast, and all others are joined by shuffle.  Error sums of labels go the same way.

All arithmetic is in integers: results don't depend on partitions.

Defined cases: vectors that are null, have null or non-finite components,
another length than the kept vector with the smallest id, or components
of ``LIMIT`` or more (their errors would not fit a long) are dropped.  The length must be a
multiple of the parts, or the vector is dropped.  Null ids are
kept but never begin a codebook (if all are null, there is none and no row); repeated rows are rows of their own, and of equal
ids the smaller vector begins a codebook first.  With fewer vectors than entries
codebooks are shorter.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch, bound_batches, lean

#: Integers of vectors are below this.
LIMIT = 1 << 26
#: A value that more than one row in so many has is heavy: there are at most so many of them.
_HEAVY = 2000
#: Rows that are compared with a codebook at a time.
_TOGETHER = 4000


def integer_vectors(df: DataFrame, scale: int, parts: int) -> DataFrame:
    """``vec_id, label, dim, parts``: vectors as integers, each part packed (big-endian, 4 bytes a component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            column = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(column.type.value_type))
            offsets, values = column.offsets.to_numpy(), column.values
            x = np.floor(np.nan_to_num(values.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf) * scale)
            bad = np.concatenate(([0], np.cumsum(~(np.abs(x) < LIMIT))))
            length = np.diff(offsets)
            fit = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (length > 0) & (length % parts == 0)
            packed = np.where(np.isfinite(x), x, 0).clip(-LIMIT, LIMIT).astype(">i4").tobytes()
            kept = np.flatnonzero(fit)
            cut = []
            for i in kept.tolist():
                lo, step = int(offsets[i]) * 4, int(length[i]) // parts * 4
                cut.append([packed[lo + p * step : lo + (p + 1) * step] for p in range(parts)])
            taken = batch.take(pa.array(kept))
            columns = [taken.column(0), taken.column(1), pa.array(length[kept], pa.int64()), pa.array(cut, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dim", "parts"])

    ids = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select("vec_id", "label", "embedding").mapInArrow(lean(run), f"vec_id {ids['vec_id']}, label {ids['label']}, dim long, parts array<binary>")


def _unpacked(parts: pa.Array) -> np.ndarray:
    """Packed parts of one length as rows of integers."""
    found = parts.to_pylist()
    return np.frombuffer(b"".join(found), dtype=">i4").astype(np.int64).reshape(len(found), -1)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the first) and its squared distance."""
    codes, errors = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), _TOGETHER):
        apart = rows[at : at + _TOGETHER, None, :] - book[None]
        squared = (apart * apart).sum(axis=2)
        codes[at : at + _TOGETHER] = best = squared.argmin(axis=1)
        errors[at : at + _TOGETHER] = squared[np.arange(len(best)), best]
    return codes, errors


def _first_books(vectors: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """The codebooks ``[part, entry, component]`` of the smallest ids; None without vectors."""
    order = [F.col("vec_id"), *[F.col("parts")[p] for p in range(parts)]]
    first = vectors.filter("vec_id is not null").orderBy(*order).limit(entries).select("parts").collect()
    if not first:
        return None
    return np.stack([np.frombuffer(b"".join(bytes(r["parts"][p]) for r in first), dtype=">i4").astype(np.int64).reshape(len(first), -1) for p in range(parts)])


def _refitted(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round of weighted Lloyd: the floor of each entry's mean, entries without parts as they are."""
    shipped = distinct.sparkSession.sparkContext.broadcast(books)
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        total = np.zeros((n_parts, n_entries, width + 1), np.int64)  # the last axis is the weight
        for batch in batches:
            position, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for p in range(n_parts):
                mine = np.flatnonzero(position == p)
                if len(mine):
                    rows = _unpacked(batch.column(1).take(pa.array(mine)))
                    codes, _ = nearest(rows, known[p])
                    np.add.at(total[p], codes, np.column_stack((rows * weight[mine, None], weight[mine])))
        used = np.argwhere(total)
        columns = [pa.array(used[:, i], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total[tuple(used.T)], pa.int64())], names=["p", "entry", "axis", "total"])

    sums = distinct.select("p", "part", "n").mapInArrow(lean(run), "p int, entry int, axis int, total long")
    total = np.zeros((n_parts, n_entries, width + 1), object)
    for r in sums.groupBy("p", "entry", "axis").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # as many as the books have numbers
        total[r["p"], r["entry"], r["axis"]] = int(r["total"])
    out = books.copy()
    for p, entry in zip(*np.nonzero(total[:, :, width])):
        out[p, entry] = [int(x) // total[p, entry, width] for x in total[p, entry, :width]]
    shipped.unpersist()
    return out


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """``p, part, n, code, error`` of all distinct parts."""
    shipped = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            position = batch.column(0).to_numpy()
            codes, errors = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
            for p in range(len(known)):
                mine = np.flatnonzero(position == p)
                if len(mine):
                    codes[mine], errors[mine] = nearest(_unpacked(batch.column(1).take(pa.array(mine))), known[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes), pa.array(errors)], names=["p", "part", "n", "code", "error"])

    return distinct.select("p", "part", "n").mapInArrow(lean(run), "p int, part binary, n long, code long, error long")


def _joined_back(exploded: DataFrame, coded: DataFrame, vectors: int) -> DataFrame:
    """*exploded* (``p, part``) with ``code, error``: heavy parts by broadcast, the others by shuffle."""
    heavy = coded.filter(F.col("n") * _HEAVY > vectors).select("p", "part", "code", "error")
    light = coded.filter(F.col("n") * _HEAVY <= vectors).select("p", "part", "code", "error")
    marked = exploded.join(F.broadcast(heavy), ["p", "part"], "left")
    done = marked.filter("code is not null")
    return done.unionByName(marked.filter("code is null").drop("code", "error").join(light, ["p", "part"]).select(*done.columns))


def compress(df: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Codes of the vectors of *df* (``vec_id, embedding, label``).

    Gives ``vec_id, label, code`` (hex, two digits a part), ``error`` (squared distances of integers, summed over
    parts), ``label_error`` (summed over equal labels) and ``codebooks_sha256``.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    bound_batches(spark, rows=4000)
    scratch = Scratch(spark)
    # A row's number is the same whenever the written rows are read.
    vectors = scratch.write(integer_vectors(df, scale, parts).withColumn("row", F.monotonically_increasing_id()), "codes-vectors")
    least = vectors.filter("vec_id is not null").agg(F.min(F.struct("vec_id", "dim")).alias("least")).select("least.dim").first()["dim"]
    numbered = vectors.filter(F.col("dim") == F.lit(least))
    books = _first_books(numbered, entries, parts)
    if books is None:  # nothing begins a codebook
        empty = numbered.limit(0).select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
        return scratch.finish(empty, "codes")
    exploded = numbered.select("row", "vec_id", "label", F.posexplode("parts").alias("p", "part"))
    distinct = scratch.write(exploded.groupBy("p", "part").agg(F.count("*").alias("n")), "codes-distinct")
    for _ in range(rounds):
        books = _refitted(distinct, books)
    coded = scratch.write(_coded(distinct, books), "codes-coded")
    joined = _joined_back(exploded, coded, numbered.count())
    word, place = F.floor(F.col("p") / 8).cast("int"), F.col("p") % 8
    words = range(-(-parts // 8))
    # Eight codes fill a long: each has a byte of its own, so their sum is their concatenation.
    packed = [F.sum(F.when(word == w, F.call_function("shiftleft", F.col("code"), (F.lit(56) - place * 8).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"word_{w}") for w in words]
    summed = scratch.write(joined.groupBy("row", "vec_id", "label").agg(F.sum("error").alias("error"), *packed), "codes-summed")
    digits = F.concat(*[F.lpad(F.hex(F.col(f"word_{w}")), 16, "0") for w in words])
    labels = scratch.write(summed.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "codes-labels")
    coded_rows = summed.select("vec_id", "label", F.lower(F.substring(digits, 1, 2 * parts)).alias("code"), "error")
    text = ",".join(str(x) for x in books.reshape(-1).tolist())
    out = _with_label_errors(coded_rows, labels, summed.count())
    return scratch.finish(out.withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest())), "codes")


def _with_label_errors(rows: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """*rows* with the error of their label (nulls are one label): heavy labels by broadcast, the others by shuffle."""
    heavy = labels.filter(F.col("n") * _HEAVY > total).select(F.col("label").alias("other"), "label_error")
    light = labels.filter(F.col("n") * _HEAVY <= total).select(F.col("label").alias("other"), "label_error")
    marked = rows.join(F.broadcast(heavy), F.col("label").eqNullSafe(F.col("other")), "left").drop("other")
    done = marked.filter("label_error is not null")
    rest = marked.filter("label_error is null").drop("label_error")
    return done.unionByName(rest.join(light, F.col("label").eqNullSafe(F.col("other"))).drop("other").select(*done.columns))


def code_digests(df: DataFrame) -> DataFrame:
    """:func:`compress` of *df* with the columns of the query."""
    return compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
