"""Similarity clustering of sequences.

The native tools' algorithms aren't part of the engine's contract.  These are
its own, and what holds of their results is said with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.alignment import Scores, align_many, same
from cubeloom.session import with_places, with_running, written

#: Letters of queries in a block and of targets in a chunk; chunks of the first range.
_BLOCK, _CHUNK, _FIRST = 1 << 17, 1 << 19, 4
#: Places of words that are counted at a time, and pairs of a query that are aligned at a time.
_POSTINGS, _TOGETHER = 2_000_000, 16


def kmers(sequence: Column, k: int) -> Column:
    """The distinct *k*-mers of a sequence."""
    n = F.length(sequence) - (k - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(sequence, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def identities(a: list[str], b: list[str], scores: Scores = Scores(match=2, mismatch=-4, gap_open=-20, gap_extend=-2)) -> list[float]:
    """Of each pair the share of equal columns of the overlap; a gap run counts as one column."""
    return [_identity(x, y) for x, y in align_many(a, b, scores)]


def _identity(x: str, y: str) -> float:
    lead = max(len(x) - len(x.lstrip("-")), len(y) - len(y.lstrip("-")))
    stop = min(len(x.rstrip("-")), len(y.rstrip("-")))
    equal = columns = 0
    before = ""
    for c, d in zip(x[lead:stop], y[lead:stop]):
        gap = "x" if c == "-" else "y" if d == "-" else ""
        if not gap or gap != before:
            columns += 1
        equal += not gap and same(c, d)
        before = gap
    return equal / columns if columns else 0.0


def shared_kmer_hits(queries: DataFrame, targets: DataFrame, k: int = 8, min_shared: int = 2, min_identity: float = 0.97) -> DataFrame:
    """``query, target, identity``: pairs (``name, seq`` each) with shared *k*-mers whose alignment is identical enough.

    A pair must share *min_shared* distinct k-mers; all k-mers take part, so a
    frequent one costs its pairs (Spark splits a skewed one).
    """
    q = queries.select(F.col("name").alias("query"), F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    t = targets.select(F.col("name").alias("target"), F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    pairs = q.join(t, "kmer").filter("query != target").groupBy("query", "target").agg(F.count("*").alias("n")).filter(F.col("n") >= min_shared)
    sides = pairs.join(queries.select(F.col("name").alias("query"), F.col("seq").alias("a")), "query").join(targets.select(F.col("name").alias("target"), F.col("seq").alias("b")), "target")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"query": frame["query"], "target": frame["target"], "identity": identities(frame["a"].tolist(), frame["b"].tolist())})

    return sides.select("query", "target", "a", "b").mapInPandas(run, "query string, target string, identity double").filter(F.col("identity") >= min_identity)


def _words(strings: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the string and of the word of all *k*-mers."""
    letters = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in strings], np.int64)
    alphabet, rank = np.unique(letters, return_inverse=True)
    word, most = np.zeros(max(0, len(letters) - k + 1), np.int64), 1
    for j in range(k):
        if most * len(alphabet) >= 1 << 40:
            known, word = np.unique(word, return_inverse=True)
            most = len(known)
        word, most = word * len(alphabet) + rank[j : j + len(word)], most * len(alphabet)
    n = np.maximum(lengths - k + 1, 0)
    of = np.repeat(np.arange(len(lengths)), n)
    return of, word[np.arange(len(of)) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(n) + n, n)]


def sharing(queries: list[str], targets: list[str], k: int, min_shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query and target, in this order, of the pairs that share *min_shared* distinct *k*-mers; some queries at a time."""
    of, word = _words(queries + targets, k)
    if not len(of):
        return
    both = np.unique(word * (len(queries) + len(targets)) + of)  # a sequence counts once for a word
    word, of = both // (len(queries) + len(targets)), both % (len(queries) + len(targets))
    asks = of < len(queries)
    look, asked, word, of = word[asks], of[asks], word[~asks], of[~asks] - len(queries)
    order = np.argsort(asked, kind="stable")
    look, asked = look[order], asked[order]
    first, after = np.searchsorted(word, look), np.searchsorted(word, look, side="right")
    amount = after - first
    lot = (np.cumsum(amount) - 1) // _POSTINGS
    # Lots end with a query, whose words have no more places than the targets have letters.
    borders = np.unique(np.append(np.searchsorted(asked, asked[np.flatnonzero(np.diff(lot)) + 1]), [0, len(asked)]))
    for lo, hi in zip(borders[:-1], borders[1:]):
        n = amount[lo:hi]
        rows = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.sort(np.repeat(asked[lo:hi], n) * len(targets) + of[rows])
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        pairs = key[start[np.diff(np.append(start, len(key))) >= min_shared]]
        yield pairs // len(targets), pairs % len(targets)


def best_of_chunk(queries: list[tuple[str, str]], targets: list[tuple[str, str]], k: int, min_shared: int, min_identity: float) -> Iterator[tuple[str, str, float]]:
    """The best match of each query among *targets*, which are in the order of their names; behind an identity of 1 nothing is aligned."""
    for query, target in sharing([s for _, s in queries], [s for _, s in targets], k, min_shared):
        other = np.array([queries[q][0] != targets[t][0] for q, t in zip(query.tolist(), target.tolist())], dtype=bool)
        query, target = query[other], target[other]
        asked, at = np.unique(query, return_index=True)
        stop = np.append(at[1:], len(query))
        share, best = np.full(len(asked), -1.0), np.zeros(len(asked), np.int64)
        live, together = np.arange(len(asked)), 1
        while len(live):
            n = np.minimum(together, stop[live] - at[live])
            begin = np.cumsum(n) - n
            rows = np.repeat(at[live] - begin, n) + np.arange(n.sum())
            got = np.array(identities([queries[q][1] for q in query[rows].tolist()], [targets[t][1] for t in target[rows].tolist()]))
            top = np.lexsort((rows, -got, np.repeat(live, n)))[begin]
            better = got[top] > share[live]  # of equal ones the first name
            share[live[better]], best[live[better]] = got[top[better]], target[rows[top[better]]]
            at[live] += n
            live, together = live[(share[live] < 1) & (at[live] < stop[live])], min(2 * together, _TOGETHER)
        for q, t, x in zip(asked.tolist(), best.tolist(), share.tolist()):
            if x >= min_identity:
                yield queries[q][0], targets[t][0], x


def best_shared_kmer_match(queries: DataFrame, targets: DataFrame, k: int = 8, min_shared: int = 2, min_identity: float = 0.97) -> DataFrame:
    """``query, target, identity``: the :func:`best_match` of :func:`shared_kmer_hits`, whose pairs are neither written nor shuffled.

    Targets are taken in the order of their names, in ranges as long as all before.  A query leaves with an identity of
    1, as no later name is better; one without is compared with all targets.  In a range common
    words of a block of queries and a chunk of targets are counted in arrays, and each hands on one row a query.  Names are unique.
    """
    known = "name is not null and seq is not null"
    amount = F.length("seq").cast("long")
    placed = with_running(targets.filter(known).select("name", "seq"), [F.col("name"), F.col("seq")], amount, "end")
    chunk = F.expr(f"(end - length(seq)) div {_CHUNK}").alias("chunk")
    chunks = written(placed.groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct("name", "seq"))).alias("targets")), "chunks")
    last = chunks.agg(F.max("chunk")).first()[0]
    left = written(queries.filter(known).select("name", "seq"), "asked")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for some, against in zip(frame["queries"], frame["targets"]):
                found = best_of_chunk([(x["name"], x["seq"]) for x in some], [(x["name"], x["seq"]) for x in against], k, min_shared, min_identity)
                yield pd.DataFrame(list(found), columns=["query", "target", "identity"])

    hits, lo, hi = None, 0, _FIRST
    while True:
        letters = left.agg(F.sum(amount)).first()[0] or 0
        blocks = -(-letters // _BLOCK)
        within = chunks.filter((F.col("chunk") >= lo) & (F.col("chunk") < hi))
        asked = left.groupBy(F.pmod(F.xxhash64("name"), F.lit(max(1, blocks))).alias("block")).agg(F.collect_list(F.struct("name", "seq")).alias("queries"))
        # Every open query with every target of the range.
        pairs = asked.join(within).repartition(max(1, min(blocks * (min(hi, (last or 0) + 1) - lo), 100_000)), "block", "chunk")
        found = written(pairs.select("queries", "targets").mapInPandas(run, "query string, target string, identity double"), "matches")
        hits = found if hits is None else hits.unionByName(found)
        if not letters or last is None or hi > last:
            return best_match(hits)
        left = written(left.join(found.filter("identity = 1").select(F.col("query").alias("name")).distinct(), "name", "left_anti"), "asked")
        lo, hi = hi, 2 * hi


def best_match(hits: DataFrame) -> DataFrame:
    """The best target of each query, the first name on a tie."""
    order = Window.partitionBy("query").orderBy(F.desc("identity"), "target")
    return hits.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def greedy_centroids(sequences: DataFrame, links: DataFrame) -> DataFrame:
    """``name, centroid`` of ``name, size`` by greedy clustering over ``query, target`` links.

    In the order of size (then name) a sequence becomes a centroid unless it is
    linked to an earlier centroid, and joins the first of these.  Done in waves:
    what has no open earlier neighbour is decided; each wave is a written
    table.  The result doesn't depend on partitions, and no two centroids are linked.
    """
    order = sequences.select("name", F.struct((-F.col("size")).alias("s"), F.col("name").alias("n")).alias("place"))
    both = links.select(F.col("query").alias("a"), F.col("target").alias("b")).unionByName(links.select(F.col("target").alias("a"), F.col("query").alias("b"))).distinct()
    ranked = both.join(order.select(F.col("name").alias("a"), F.col("place").alias("pa")), "a").join(order.select(F.col("name").alias("b"), F.col("place").alias("pb")), "b")
    earlier = written(ranked.filter("pb < pa").select(F.col("a").alias("name"), "b", "pb"), "earlier")
    state = written(order.select("name", "place", F.lit(None).cast("string").alias("centroid")), "centroids")
    while True:
        around = earlier.join(state.select(F.col("name").alias("b"), F.col("centroid").alias("bc")), "b")
        seen = around.groupBy("name").agg(
            F.min(F.when(F.col("bc") == F.col("b"), F.struct("pb", "b"))).alias("first_centroid"),
            F.min(F.when(F.col("bc").isNull(), F.col("pb"))).alias("first_open"),
        )
        joined = state.join(seen, "name", "left")
        # The first centroid is final once no earlier neighbour before it is open.
        joins = F.col("first_centroid").isNotNull() & (F.col("first_open").isNull() | (F.col("first_centroid.pb") < F.col("first_open")))
        alone = F.col("first_centroid").isNull() & F.col("first_open").isNull()
        chosen = F.coalesce("centroid", F.when(joins, F.col("first_centroid.b")), F.when(alone, F.col("name")))
        state = written(joined.select("name", "place", chosen.alias("centroid")), "centroids")
        if state.filter("centroid is null").isEmpty():
            return state.select("name", "centroid")


def numbered_clusters(clusters: DataFrame, prefix: str = "otu") -> DataFrame:
    """``centroid, cluster, size``: clusters named by their place by size, then name."""
    sizes = clusters.groupBy("centroid").agg(F.count("*").alias("size"))
    placed = with_places(sizes, [F.desc("size"), F.col("centroid")])
    width = len(str(placed.count()))
    return placed.select("centroid", F.concat(F.lit(prefix + "_"), F.lpad(F.col("place").cast("string"), width, "0")).alias("cluster"), "size")


def containment_clusters(sequences: DataFrame, k: int = 12) -> DataFrame:
    """``name, container``: the longest sequence (then first name) of the same ``taxid`` that contains it, itself if none does.

    A contained sequence shares its first *k*-mer with its container; shorter ones than *k* only find equals.
    """
    heads = sequences.select("name", "taxid", F.col("seq").alias("inner"), F.substring("seq", F.lit(1), F.lit(k)).alias("kmer"))
    grams = sequences.select(F.col("name").alias("outer"), "taxid", F.col("seq").alias("whole"), F.explode(F.when(F.length("seq") >= k, kmers(F.col("seq"), k)).otherwise(F.array("seq"))).alias("kmer"))
    inside = heads.join(grams, ["taxid", "kmer"]).filter(F.contains("whole", F.col("inner")))
    order = Window.partitionBy("name").orderBy(F.length("whole").desc(), "outer")
    return inside.withColumn("r", F.row_number().over(order)).filter("r = 1").select("name", F.col("outer").alias("container"))


def merged_within_taxon(sequences: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, taxid, seq, members``: containment clusters with their longest sequence and number of members."""
    grouped = containers.groupBy("container").agg(F.count("*").alias("members"))
    return grouped.join(sequences.select(F.col("name").alias("container"), "taxid", "seq"), "container").select("container", "taxid", "seq", "members")


def denoised(sequences: DataFrame, links: DataFrame, alpha: float = 2.0) -> DataFrame:
    """``name, denoised`` of ``name, size``: abundance-skew denoising over links with ``distance``.

    A sequence is noise of a larger one at ``distance`` differences if its size is
    at most ``size / 2 ** (alpha * distance + 1)`` of that; it goes to the
    largest such one, chains are followed by greedy order.
    """
    sizes = sequences.select("name", "size")
    far = links.join(sizes.select(F.col("name").alias("query"), F.col("size").alias("qs")), "query").join(sizes.select(F.col("name").alias("target"), F.col("size").alias("ts")), "target")
    skewed = far.filter(F.col("qs") <= F.col("ts") / F.pow(F.lit(2.0), alpha * F.col("distance") + 1)).select("query", "target")
    return greedy_centroids(sequences, skewed).withColumnRenamed("centroid", "denoised")


def _part(sequence: Column, side: Column, n: Column) -> Column:
    """The fingerprint (128 bits) of the first (``side`` true) or last *n* letters."""
    letters = F.when(side, F.substring(sequence, F.lit(1), n)).otherwise(F.substring(sequence, F.length(sequence) - n + 1, n))
    return F.struct(side.alias("head"), n.alias("n"), F.xxhash64(letters).alias("h"), F.xxhash64(F.lit(1), letters).alias("g"))


def _holders(parents: DataFrame, probes: DataFrame) -> DataFrame:
    """``part, holders``: the five largest parents (then first names) that begin or end with each part of *probes*."""
    asked = [(r["head"], r["n"]) for r in probes.select("part.head", "part.n").distinct().collect()]
    places = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(n).alias("n")) for h, n in sorted(asked)]) if asked else F.array().cast("array<struct<h:boolean,n:int>>")
    fits = parents.select("parent", "parent_size", F.col("seq"), F.explode(F.filter(places, lambda p: p["n"] <= F.length("seq"))).alias("p"))
    parts = fits.select(_part(F.col("seq"), F.col("p.h"), F.col("p.n")).alias("part"), F.struct((-F.col("parent_size")).alias("s"), F.col("parent"), F.xxhash64("seq").alias("letters")).alias("holder"))
    near = parts.join(probes.select("part").distinct(), "part", "left_semi")
    # Limits of five are taken in each task before the shuffle, so a part that all parents have makes few rows.
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("holder"))).filter("r <= 5")
    return top.groupBy("part").agg(F.sort_array(F.collect_list("holder")).alias("holders"))


def _held(probes: DataFrame, parents: DataFrame, min_skew: float) -> DataFrame:
    """``name, at`` with ``lefts`` and ``rights``: the largest parents of each probed break's two sides."""
    found = probes.join(_holders(parents, probes), "part")
    fit = F.filter("holders", lambda p: (p["parent"] != F.col("name")) & (-p["s"] >= min_skew * F.col("size")))
    sides = found.select("name", "at", "part.head", fit.alias("fit")).filter(F.size("fit") > 0)
    return sides.groupBy("name", "at").agg(F.max(F.when(F.col("head"), F.col("fit"))).alias("lefts"), F.max(F.when(~F.col("head"), F.col("fit"))).alias("rights"))


def _pair() -> Column:
    """The first left and right parent (``l, r``) with different letters; null if there are none."""
    both = F.flatten(F.transform("lefts", lambda x: F.transform(F.col("rights"), lambda y: F.struct(x.alias("l"), y.alias("r")))))
    return F.get(F.filter(both, lambda p: p["l"]["letters"] != p["r"]["letters"]), F.lit(0))


def two_parent_chimeras(sequences: DataFrame, min_skew: float = 2.0) -> DataFrame:
    """``name, left_parent, right_parent``: sequences that begin as one larger sequence and end as another.

    A parent of a sequence (``name, seq, size``) has *min_skew* times its size and
    any length.  A sequence is a chimera if at some break the letters before it begin one parent
    and those after it end a parent with other letters, and no parent begins or ends with all of it.  Of several
    breaks the one nearest the middle (then the first) is taken, of several parents the largest (then first name).

    The middle is tried first: a break after it needs a parent with the first half, one before
    it a parent with the second half, so only sequences with either half are tried at their other breaks.
    Parts of sequences are matched to the few largest parents that have them, so rows grow with the letters, not with pairs.
    """
    n, mid = F.length("seq"), F.expr("length(seq) div 2").cast("int")
    whole = sequences.select(F.col("name").alias("parent"), F.col("size").alias("parent_size"), "seq")
    copies = Window.partitionBy("seq").orderBy(F.desc("parent_size"), "parent")
    # Two of equal sequences suffice: one may be the sequence that is asked for.
    parents = whole.withColumn("r", F.row_number().over(copies)).filter("r <= 2").drop("r")
    bounds = sequences.agg(F.min("size").alias("least"), F.max("size").alias("most"))
    parents = written(parents.join(F.broadcast(bounds)).filter(F.col("parent_size") >= min_skew * F.col("least")).select("parent", "parent_size", "seq"), "parents")
    asked = sequences.join(F.broadcast(bounds)).filter((n >= 2) & (F.col("most") >= min_skew * F.col("size"))).select("name", "size", "seq")

    def sides(at: Column) -> Column:
        return F.array(F.struct(at.alias("at"), _part(F.col("seq"), F.lit(True), at).alias("part")), F.struct(at.alias("at"), _part(F.col("seq"), F.lit(False), n - at).alias("part")))

    ends = F.array(*[F.struct(F.lit(0).alias("at"), _part(F.col("seq"), F.lit(h), n).alias("part")) for h in (True, False)])
    probes = written(asked.select("name", "size", F.explode(F.concat(sides(mid), ends)).alias("p")).select("name", "size", "p.at", "p.part"), "probes")
    held = _held(probes, parents, min_skew).withColumn("pair", _pair())
    first = held.groupBy("name").agg(
        F.max(F.when(F.col("at") > 0, F.col("pair"))).alias("pair"),
        F.max(F.col("at") == 0).alias("whole"),
        F.max((F.col("at") > 0) & F.col("lefts").isNotNull()).alias("has_left"),
        F.max((F.col("at") > 0) & F.col("rights").isNotNull()).alias("has_right"),
    )
    first = written(first.filter("not whole"), "middles")
    rest = asked.join(first.filter("pair is null").select("name", "has_left", "has_right"), "name")
    breaks = F.filter(F.sequence(F.lit(1), n - 1), lambda at: (F.col("has_left") & (at > mid)) | (F.col("has_right") & (at < mid)))
    more = rest.select("name", "size", F.explode(F.flatten(F.transform(breaks, sides))).alias("p")).select("name", "size", "p.at", "p.part")
    lengths = rest.select("name", mid.alias("mid"))
    others = _held(written(more, "probes"), parents, min_skew).withColumn("pair", _pair()).filter("pair is not null").join(lengths, "name")
    others = others.groupBy("name").agg(F.min_by("pair", F.struct(F.abs(F.col("at") - F.col("mid")), "at")).alias("pair"))
    found = first.filter("pair is not null").select("name", "pair").unionByName(others)
    return found.select("name", F.col("pair.l.parent").alias("left_parent"), F.col("pair.r.parent").alias("right_parent"))


def spike_in_variants(hits: DataFrame) -> DataFrame:
    """``query, target, identity``: the best spike-in of each item from ``query, target, cigar``.

    Identity counts matches over columns of a CIGAR with ``=``/``X`` letters, a gap run being one column.
    """
    runs = F.regexp_extract_all("cigar", F.lit(r"(\d*[=XMID])"), F.lit(1))
    amount = lambda r: F.when(F.length(r) > 1, F.substring(r, F.lit(1), F.length(r) - 1).cast("int")).otherwise(1)
    equal = F.aggregate(runs, F.lit(0), lambda s, r: s + F.when(F.endswith(r, F.lit("=")), amount(r)).otherwise(0))
    columns = F.aggregate(runs, F.lit(0), lambda s, r: s + F.when(r.rlike("[ID]$"), 1).otherwise(amount(r)))
    scored = hits.select("query", "target", F.when(F.col("cigar") == "=", 1.0).otherwise(equal / F.nullif(columns, F.lit(0))).alias("identity"))
    order = Window.partitionBy("query").orderBy(F.desc("identity"), "target")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def cleaned_reference(sequences: DataFrame, max_count: int | None = None, max_share: float = 0.0) -> DataFrame:
    """Reference sequences without chimeras of one another: checked again until few enough are found."""
    now = written(sequences, "reference")
    while True:
        found = written(two_parent_chimeras(now).select("name"), "chimeras")
        n = found.count()
        if n == 0 or (max_count is not None and n <= max_count) or n <= max_share * now.count():
            return now
        now = written(now.join(found, "name", "left_anti"), "reference")


def without_chimeras(members: DataFrame, flagged: list[DataFrame]) -> DataFrame:
    """Members of items (``otuname``) that no list of chimeras (``name``) has."""
    for names in flagged:
        members = members.join(names.select(F.col("name").alias("otuname")).distinct(), "otuname", "left_anti")
    return members
