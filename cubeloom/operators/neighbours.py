"""Neighbourhood searches over a table of verified hits (``query, acc, score``).

Scores are numbers that grow with similarity; gates on length and coverage
are applied by :func:`gated` before.  Ties are kept wherever a score decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.session import written


def gated(hits: DataFrame, min_length: int = 50, min_coverage: float = 0.5, min_identity: float | None = None) -> DataFrame:
    """Hits that are long enough, cover enough of the query and (if asked for) are identical enough."""
    kept = hits.filter((F.col("length") >= min_length) & (F.col("qcov") >= min_coverage))
    return kept if min_identity is None else kept.filter(F.col("pident") >= min_identity)


def best_per_accession(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query", "acc").agg(F.max("score").alias("score"))


def k_nearest(hits: DataFrame, k: int) -> DataFrame:
    """The best *k* distinct accessions of each query, and all that tie with the last of them."""
    order = Window.partitionBy("query").orderBy(F.desc("score"))  # Spark keeps the best k of a query in each task before it shuffles
    return best_per_accession(hits).withColumn("place", F.rank().over(order)).filter(F.col("place") <= k).drop("place")


def nearest(hits: DataFrame) -> DataFrame:
    """The best hits of each query, ties kept."""
    return k_nearest(hits, 1)


def nearest_borderline(hits: DataFrame) -> DataFrame:
    """``query, nn_score, borderline_score``: the best score and the best one strictly below it (null: none)."""
    top = best_per_accession(hits).groupBy("query").agg(F.max("score").alias("nn_score"))
    scored = best_per_accession(hits).join(top, "query")
    return scored.groupBy("query", "nn_score").agg(F.max(F.when(F.col("score") < F.col("nn_score"), F.col("score"))).alias("borderline_score"))


def nearest_centric(hits: DataFrame, reference_hits: DataFrame, min_neighbours: int = 2) -> DataFrame:
    """``query, acc``: neighbours of a query's nearest neighbour.

    *reference_hits* holds the hits among accessions, an accession being its own
    hit.  The borderline is the nearest neighbour's best accession that scores
    strictly below its score with the query; its neighbours are those that score
    the borderline or more with it.  With fewer than *min_neighbours* the best
    ones of the nearest neighbour are taken, ties kept.  Several nearest
    neighbours are taken together.
    """
    nn = nearest(hits).select("query", F.col("acc").alias("nn"), F.col("score").alias("nn_score"))
    near = best_per_accession(reference_hits).select(F.col("query").alias("nn"), "acc", "score")
    around = nn.join(near, "nn")
    border = around.filter("score < nn_score").groupBy("query", "nn").agg(F.max("score").alias("border"))
    inside = around.join(border, ["query", "nn"], "left").filter("score >= coalesce(border, nn_score)").select("query", "acc").distinct()
    enough = inside.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= min_neighbours).select("query")
    fallback = k_nearest(around.join(enough, "query", "left_anti").select("query", "acc", "score"), min_neighbours).select("query", "acc")
    return inside.join(enough, "query", "left_semi").unionByName(fallback).distinct()


def query_centric(hits: DataFrame, reference_hits: DataFrame, min_neighbours: int = 2) -> DataFrame:
    """``query, acc``: hits that score no less with the query than its borderline accessions do.

    The borderline is found as in :func:`nearest_centric`; all accessions that tie for
    it count, the best of their scores with the query is the limit, and they are
    neighbours themselves.  With fewer than *min_neighbours* the best hits are taken, ties kept.
    """
    own = written(best_per_accession(hits), "own-hits")
    border = borderline(own, reference_hits)
    limit = border.join(own, ["query", "acc"]).groupBy("query").agg(F.max("score").alias("least"))
    inside = own.join(limit, "query").filter("score >= least").select("query", "acc").unionByName(border).distinct()
    enough = inside.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= min_neighbours).select("query")
    fallback = k_nearest(own.join(enough, "query", "left_anti"), min_neighbours).select("query", "acc")
    return inside.join(enough, "query", "left_semi").unionByName(fallback).distinct()


def borderline(hits: DataFrame, reference_hits: DataFrame) -> DataFrame:
    """``query, acc``: the accessions that tie for the borderline of each query, as :func:`query_centric` takes it."""
    nn = nearest(hits).select("query", F.col("acc").alias("nn"), F.col("score").alias("nn_score"))
    near = best_per_accession(reference_hits).select(F.col("query").alias("nn"), F.col("acc").alias("other"), F.col("score").alias("nn_other"))
    around = nn.join(near, "nn").filter("nn_other < nn_score")
    border = around.join(around.groupBy("query", "nn").agg(F.max("nn_other").alias("nn_border")), ["query", "nn"]).filter("nn_other = nn_border")
    return border.select("query", F.col("other").alias("acc")).distinct()


def vector_hits(queries: DataFrame, vectors: DataFrame, scale: int = 1_000_000, best: int | None = None, block: int = 512, chunk: int = 8192) -> DataFrame:
    """``query, acc, score`` of stated queries (``query, vector``) against all ``acc, vector``: scaled dot products.

    Queries are packed in blocks of about *block*, vectors in chunks of at most *chunk*; Spark joins each block with
    each chunk, and a pair is a product of two matrices.  Asked for less than all hits, a pair gives those
    from the lowest of these scores on (and perhaps more of it):

    * with *best*, the *best* highest distinct scores of the query in the chunk, among which the highest of all are;
    * with a column ``floor`` (long, may be null), scores of at least that;
    * with a column ``below`` (long, may be null), the highest score in the chunk that is less, among which is the highest of all that are less.
    """
    limits = [F.col(c).cast("long") if c in queries.columns else F.lit(None).cast("long") for c in ("floor", "below")]
    asked = written(queries.select(F.col("query").cast("long").alias("name"), "vector", limits[0].alias("floor"), limits[1].alias("below")), "queries")
    dealt = asked.repartition(max(1, -(-asked.count() // block)), F.xxhash64("name", "floor", "below"))
    blocks = written(dealt.mapInArrow(_packed(block, True), "names binary, floors binary, belows binary, matrix binary"), "query-blocks")
    listed = vectors.select(F.col("acc").cast("long").alias("name"), "vector")
    chunks = written(listed.mapInArrow(_packed(chunk, False), "accs binary, vectors binary"), "vector-chunks")
    pairs = chunks.join(blocks)  # every block with every chunk: the search is that product
    every = best is None and not {"floor", "below"} & set(queries.columns)
    return pairs.mapInArrow(_hits_of(scale, best, every), "query long, acc long, score long")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


#: Stand for a missing floor, which no score reaches, and for a missing limit, below which there is none.
_NO_FLOOR, _NO_LIMIT = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _packed(most: int, limited: bool):
    """Rows ``name, vector`` (and ``floor, below`` if *limited*) as bytes of numbers, at most *most* a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        names = ["names", "floors", "belows", "matrix"] if limited else ["accs", "vectors"]

        def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            columns = [table.column(0).to_numpy()]
            if limited:
                columns += [table.column(c).fill_null(v).to_numpy() for c, v in (("floor", int(_NO_FLOOR)), ("below", int(_NO_LIMIT)))]
            columns.append(_matrix(table.column("vector")))
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=names)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == most:
                    yield row(held)
                    held, n = [], 0
        if held:
            yield row(held)

    return run


def _least(scores: np.ndarray, best: int | None, floors: np.ndarray, belows: np.ndarray) -> np.ndarray:
    """The lowest score of each row that :func:`vector_hits` gives."""
    least = floors.copy()
    if best is not None:
        some = min(scores.shape[1], 4 * best)
        top = np.partition(scores, scores.shape[1] - some, axis=1)[:, -some:]
        for i, row in enumerate(top):
            levels = np.unique(row)
            if len(levels) < best and some < scores.shape[1]:  # ties fill the top
                levels = np.unique(scores[i])
            least[i] = min(least[i], levels[max(0, len(levels) - best)])
    if (belows != _NO_LIMIT).any():
        under = np.where(scores < belows[:, None], scores, _NO_LIMIT).max(axis=1)
        least = np.where(under != _NO_LIMIT, np.minimum(least, under), least)
    return least


def _scaled(products: np.ndarray, scale: int) -> np.ndarray:
    """Halves go away from 0; the ninth decimal settles what differs by the order of sums."""
    scores = np.round(products * scale, 9)
    return (np.sign(scores) * np.floor(np.abs(scores) + 0.5)).astype(np.int64)


def _hits_of(scale: int, best: int | None, every: bool, lot: int = 1 << 20):
    """Hits of pairs of a chunk and a block, about *lot* scores at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in zip(*batch.columns):
                accs, vectors, names, floors, belows, probes = (np.frombuffer(x.as_buffer(), t) for x, t in zip(pair, (np.int64, np.float64, np.int64, np.int64, np.int64, np.float64)))
                vectors, probes = vectors.reshape(len(accs), -1).T, probes.reshape(len(names), -1)
                step = max(1, lot // len(accs))
                for k in range(0, len(names), step):
                    some = slice(k, k + step)
                    scores = _scaled(probes[some] @ vectors, scale)
                    if every:
                        at, to = np.divmod(np.arange(scores.size), scores.shape[1])
                    else:
                        at, to = np.nonzero(scores >= _least(scores, best, floors[some], belows[some])[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(names[some][at]), pa.array(accs[to]), pa.array(scores[at, to])], names=["query", "acc", "score"])

    return run


def pair_scores(pairs: DataFrame, vectors: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """``query, acc, score`` of stated *pairs* (``query, acc``) of *vectors* (``acc, vector``)."""
    one = vectors.select(F.col("acc").alias("query"), F.col("vector").alias("u"))
    both = pairs.select("query", "acc").join(one, "query").join(vectors.select("acc", F.col("vector").alias("v")), "acc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                products = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_scaled(products, scale))], names=["query", "acc", "score"])

    return both.select(F.col("query").cast("long"), F.col("acc").cast("long"), "u", "v").mapInArrow(run, "query long, acc long, score long")


def cached_first(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours known to *cache* (``key, acc``; a null accession: known to have none), and the queries to search.

    *queries* has ``query, key``, the key being the sequence's hash.
    """
    known = queries.join(cache, "key").filter("acc is not null").select("query", "acc")
    return known, queries.join(cache.select("key").distinct(), "key", "left_anti")


def merged_caches(caches: list[DataFrame], prefer: str = "small", stop: bool = False) -> DataFrame:
    """``key, acc`` of several caches; where they differ for a key, the smaller or larger set, the first on a tie.

    With *stop* a difference is an error at run time.
    """
    sets = None
    for i, cache in enumerate(caches):
        part = cache.groupBy("key").agg(F.sort_array(F.collect_set("acc")).alias("accs")).withColumn("cache", F.lit(i))
        sets = part if sets is None else sets.unionByName(part)
    size = F.size("accs") if prefer == "small" else -F.size("accs")
    grouped = sets.groupBy("key").agg(F.min_by("accs", F.struct(size, "cache")).alias("accs"), F.count_distinct("accs").alias("kinds"))
    if stop:
        grouped = grouped.filter(F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("caches differ for "), "key"))).otherwise(F.lit(True)))
    return grouped.select("key", F.explode_outer("accs").alias("acc"))


def candidates_by_bucket(hits: DataFrame, path: str, most: int = 10000, buckets: int = 64) -> None:
    """Each query's best *most* hits, written in buckets of queries, so that a later search reads its own bucket only."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "acc")
    kept = best_per_accession(hits).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")
    kept.withColumn("bucket", F.pmod(F.xxhash64("query"), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(path)
