"""Similarity join of word-shingle sets by parity sketches.

A document's set holds its distinct shingles of ``shingle`` lower-cased words (a
shorter text is one shingle).  Two documents link if the Jaccard similarity of
their sets is ``percent`` / 100 or more; sets of ``a`` and ``b`` shingles then
differ in at most ``(a + b) * (100 - percent) / (100 + percent)`` of them.

1. Documents with equal sets are one node, named by its smallest id.
2. Set sizes fall into bands; a pair belongs to the band of its smaller set.
   With ``d`` the largest difference that a linked pair of the band may have, a
   sketch has ``d + 1 + slack`` blocks of parity bits;
   every shingle flips one bit of one block.  The Hamming distance of two
   sketches is at most the difference of the sets, so a linked pair has
   ``slack + 1`` equal blocks or more (pigeonhole).  The blocks are very wide
   (2**64 bits); a block is held as the XOR of its set bits' fingerprints.  A
   set is sketched for its own band and for lower ones that a smaller partner can be in.
   Every set leaves out its ``slack`` most popular blocks, ordered by how many
   sets have them: the least popular of a pair's equal blocks has ``slack``
   before it on both sides, so both keep it.  Empty and common blocks go that way.
3. Equal blocks join sets into groups.  Instead of all pairs of a group, all
   its members are verified against one leader (the set with the most popular
   blocks).  Verification intersects the sets themselves.
4. While a group still has members of different components, up to
   ``leaders`` more of its members (four times as many each round, so that the
   rounds stay few), from its smaller components first, are
   compared with the members of other components: by short sketches of 1024
   bits, whose Hamming distance again is at most the difference of the sets;
   pairs that pass are verified.  When no group is left, no
   link between different components can exist, so the components are exact.

Scale: blocks that only one text has are dropped by a partial aggregation
before anything is joined, most of them by a Bloom filter of bounded size before they are shuffled again, and so are texts
that are in no group before sets are computed of the others; groups that
are done, and sets that no open pair asks for, don't travel in later rounds; a round compares at most its number of leaders times
a group's members, inside the join, and emits only pairs that short sketches let pass; leaders are picked by a limited rank that Spark applies before the
shuffle; skewed groups are split by Spark's skew join (no hints); sets are
computed again for the members of groups only, and joined to the pairs.

Defined cases: a null or empty text has an empty set, linked with nothing, not
even with its copies; rows that share an id are one node; a null id is linked
with nothing and is its own (null) component; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch, binary_list, bloom_joins, bound_batches, lean, text_bytes
from cubeloom.llm.components import components
from cubeloom.llm.substring_dedup import mix

BAND_RATIO = 1.6
_FACTOR = np.uint64(0x9FB21C651E98DF25)


class _Names(dict):
    """64-bit fingerprint by word; emptied at 200,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name


_NAMES = _Names()


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text as ordered 64-bit fingerprints."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    names = np.fromiter(map(_NAMES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ names[k : k + len(out)]) * _FACTOR
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def bands(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower edges of the bands up to the largest of *sizes*, and the largest difference of a linked pair whose smaller set is in the band."""
    edges = [1]
    while edges[-1] <= max(1, int(sizes.max(initial=1))):
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    low = np.array(edges)
    top = low[1:] - 1
    return low[:-1], (top + top * 100 // percent) * (100 - percent) // (100 + percent)


def slack_of(differ: np.ndarray) -> np.ndarray:
    """Blocks that a sketch has beyond the pigeonhole's need: an eighth, and one."""
    return 1 + differ // 8


def block_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set number, key and band of every sketch block of *sets*; a band's number is packed with its slack."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    low, differ = bands(sizes, percent)
    own = np.searchsorted(low, sizes, side="right") - 1
    reach = np.searchsorted(low, -(-sizes * percent // 100), side="right") - 1  # the band of the smallest partner
    numbers, keys, packed = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for down in range(int((own - reach).max(initial=0)) + 1):
        chosen = np.flatnonzero((sizes > 0) & (own - down >= reach))
        chosen = chosen[differ[own[chosen] - down] > 0]
        if not len(chosen):
            continue
        band = own[chosen] - down
        slack = slack_of(differ[band])
        blocks = differ[band] + 1 + slack
        offset = np.cumsum(blocks) - blocks
        flat = np.concatenate([sets[i] for i in chosen])
        of = np.repeat(np.arange(len(chosen)), sizes[chosen])
        place = offset[of] + (flat % blocks[of].astype(np.uint64)).astype(np.int64)
        sketch = np.zeros(int(blocks.sum()), dtype=np.uint64)
        np.bitwise_xor.at(sketch, place, mix(flat ^ _FACTOR))
        owner = np.repeat(np.arange(len(chosen)), blocks)
        label = (band[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(sketch)) - offset[owner]).astype(np.uint64)
        numbers.append(chosen[owner])
        keys.append(mix(sketch ^ mix(label + np.uint64(1))))
        packed.append((band << 20 | slack)[owner])
    return np.concatenate(numbers), np.concatenate(keys), np.concatenate(packed)


def sketches(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A row for every sketch block of a document (one with a null block if it has none): ``doc_id, text_key, n_shingles, set_a, set_b, head, block, band``.

    Set size, 128-bit name of the set, whether the row is the document's first, key and band of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw, shingle) for raw in text_bytes(batch.column(2))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            names = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            number, key, band = block_keys(sets, percent)
            without = np.setdiff1d(np.arange(len(sets)), number)
            number = np.concatenate([number, without])
            order = np.argsort(number, kind="stable")
            missing = order >= len(key)
            found = np.where(missing, 0, order)
            number = number[order]
            at = pa.array(number)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            key, band = (key, band) if len(key) else (np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(sizes[number]),
                    pa.array(names[number, 0]),
                    pa.array(names[number, 1]),
                    pa.array(np.append(True, number[1:] != number[:-1])[: len(number)]),
                    pa.array(key[found].view(np.int64), mask=missing),
                    pa.array(band[found].astype(np.int32), mask=missing),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "head", "block", "band"],
            )

    return docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, head boolean, block long, band int")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """``set_a, shingles, n, bits``: the sets themselves, packed, their sizes and short sketches, of ``set_a, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw, shingle) for raw in text_bytes(batch.column(1))]
            short = np.zeros((len(sets), 16), dtype=np.uint64)
            for row, found in zip(short, sets):
                place = mix(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(54)
                np.bitwise_xor.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(list(short.view(np.int64)), pa.list_(pa.int64())),
                ],
                names=["set_a", "shingles", "n", "bits"],
            )

    return docs.select("set_a", "text").mapInArrow(lean(run), "set_a long, shingles binary, n long, bits array<long>")


def _may_link(n: str, bits: str, m: str, other_bits: str, percent: int) -> Column:
    """Whether two sets' sizes and short sketches let them link: the Hamming distance is no more than the largest difference."""
    apart = F.aggregate(F.zip_with(bits, other_bits, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    small, large = F.least(n, m), F.greatest(n, m)
    return (100 * small >= percent * large) & (apart * (100 + percent) <= (small + large) * (100 - percent))


def verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The linked ones of *pairs* (``left, right``, both a ``set_a``); short sketches decide first, then the sets themselves."""
    short = [sizes.select(F.col("set_a").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")) for side in ("left", "right")]
    pairs = pairs.join(short[0], "left").join(short[1], "right").filter(_may_link("n_left", "bits_left", "n_right", "bits_right", percent)).select("left", "right")
    # Written, so that Spark knows how few sets are asked for; the others don't travel.
    pairs = scratch.replace(pairs, "join-near")
    asked = pairs.select(F.col("left").alias("set_a")).unionByName(pairs.select(F.col("right").alias("set_a"))).distinct()
    sets = scratch.replace(sets.join(scratch.replace(asked, "join-asked"), "set_a", "left_semi").select("set_a", "shingles"), "join-asked-sets")
    sides = pairs.join(sets.select(F.col("set_a").alias("left"), F.col("shingles").alias("x")), "left")
    sides = sides.join(sets.select(F.col("set_a").alias("right"), F.col("shingles").alias("y")), "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(binary_list(batch.column(2)), binary_list(batch.column(3))):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["left", "right"])

    return sides.select("left", "right", "x", "y").mapInArrow(lean(run), "left long, right long")


def _leaders(members: DataFrame, done: DataFrame | None, most: int) -> DataFrame:
    """``block, leader, other`` (the leader's component), ``place`` of *members* (``block, set_a, component``): up to *most* + 1 of each group that has several components.

    The largest component of a group needs no leaders; *done* has those of rounds before.  A group with
    a leader in place *most* + 1 has members left for a further round.
    """
    parts = members.groupBy("block", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("block").agg(F.max(F.struct("size", "component")).alias("largest"), F.count("*").alias("kinds")).filter("kinds > 1")
    small = parts.join(mixed.select("block", F.col("largest.component").alias("main")), "block").filter("component != main").drop("main")
    few = members.join(small, ["block", "component"])
    if done is not None:
        few = few.join(done, ["block", "set_a"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("block").orderBy("size", "component", "set_a"))
    chosen = few.withColumn("place", rank).filter(F.col("place") <= most + 1)
    return chosen.select("block", F.col("set_a").alias("leader"), F.col("component").alias("other"), "place")


def _led_pairs(members: DataFrame, chosen: DataFrame, short: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of leaders and members of other components in their groups that short sketches let link."""
    inside = members.join(chosen.select("block").distinct(), "block").join(short, "set_a")
    inside = scratch.replace(inside.select("block", "set_a", "component", "n", "bits"), "join-mixed")
    led = chosen.join(short.select(F.col("set_a").alias("leader"), F.col("n").alias("m"), F.col("bits").alias("own_bits")), "leader")
    possible = (inside["block"] == led["block"]) & (F.col("component") != F.col("other")) & _may_link("n", "bits", "m", "own_bits", percent)
    return led.join(inside, possible).select(F.least("leader", "set_a").alias("left"), F.greatest("leader", "set_a").alias("right")).distinct()


def near_duplicates(documents: DataFrame, shingle: int = 3, percent: int = 90, leaders: int = 256) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    bound_batches(spark, rows=500)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketched = scratch.write(sketches(docs, shingle, percent), "join-sketches")
    heads = scratch.write(sketched.filter("head").select("doc_id", "text_key", "n_shingles", "set_a", "set_b"), "join-named")
    named = heads.filter("doc_id is not null and n_shingles > 0")
    first = named.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    nodes = scratch.write(first.select("set_a", "set_b", F.col("first.doc_id").alias("node"), F.col("first.text_key").alias("text_key")), "join-nodes")

    blocks = sketched.filter("doc_id is not null and block is not null").select("set_a", "block", "band")
    counted = blocks.groupBy("block").agg(F.min("set_a").alias("a"), F.max("set_a").alias("b"), F.count("*").alias("popularity"))
    shared = scratch.write(counted.filter("a != b").select("block", "popularity"), "join-shared")
    common = blocks.join(shared.filter("popularity > 1"), "block").groupBy("block", "set_a", "band").agg(F.max("popularity").alias("popularity"))
    place = F.row_number().over(Window.partitionBy("set_a", "band").orderBy(F.desc("popularity"), "block"))  # no more rows than a set has blocks
    kept = common.withColumn("place", place).filter(F.col("place") > F.col("band").bitwiseAND(F.lit((1 << 20) - 1)))
    with bloom_joins(spark, shared.count()):
        groups = scratch.write(kept.select("block", "set_a", "popularity"), "join-groups")
    scratch.drop("join-sketches", "join-shared")
    members = scratch.write(groups.groupBy("set_a").agg(F.max("popularity").alias("popularity")).join(nodes, "set_a"), "join-members")
    asked = members.filter("popularity > 1").select(F.col("node").alias("doc_id"), "text_key", "set_a")  # all of them, as a group's block has two sets
    with bloom_joins(spark, members.count()):  # texts that are no member's don't travel
        found = docs.join(asked, ["doc_id", "text_key"]).select("set_a", "text").dropDuplicates(["set_a"])
        sets = scratch.write(sets_of(found, shingle), "join-sets")
    node_of = scratch.write(members.groupBy("set_a").agg(F.min("node").alias("node")), "join-node-of")

    scores = groups.groupBy("set_a").agg(F.sum("popularity").alias("score"))
    leader = groups.join(scores, "set_a").groupBy("block").agg(F.max(F.struct("score", "set_a")).alias("top"), F.count("*").alias("members")).select("block", F.col("top.set_a").alias("leader"), "members")
    led = scratch.write(groups.select("block", "set_a").join(leader, "block"), "join-led")
    pairs = led.filter("set_a != leader").select(F.least("leader", "set_a").alias("left"), F.greatest("leader", "set_a").alias("right")).distinct()
    sizes = scratch.write(sets.select("set_a", "n", "bits"), "join-sizes")
    # A group of two is done with its one pair.
    done, parts, left = None, None, led.filter("members > 2")
    while True:
        found = verified(pairs, sets, sizes, percent, scratch)
        found = found.join(node_of.select(F.col("set_a").alias("left"), F.col("node").alias("a")), "left").join(node_of.select(F.col("set_a").alias("right"), F.col("node").alias("b")), "right").select("a", "b")
        found = scratch.replace(found, "join-links")
        if parts is None or not found.isEmpty():
            # Stars of the rounds before stand for their links.
            links = found if parts is None else found.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
            parts = components(links, scratch)
        if left is None:
            break
        placed = node_of.join(parts, "node", "left").select("set_a", F.coalesce("component", "node").alias("component"))
        current = scratch.replace(left.select("block", "set_a").join(placed, "set_a"), "join-current")
        chosen = scratch.write(_leaders(current, done, leaders), "join-leaders")
        if chosen.isEmpty():
            break
        now = chosen.filter(F.col("place") <= leaders).drop("place")
        pairs = scratch.replace(_led_pairs(current, now, sizes, percent, scratch), "join-pairs")
        # A group whose members outside its largest component have all led is done; so is one with a single component.
        further = chosen.filter(F.col("place") > leaders).select("block")
        left = None if further.isEmpty() else scratch.replace(current.select("block", "set_a").join(further, "block"), "join-left")
        used = now.select("block", F.col("leader").alias("set_a"))
        done = used if done is None else done.unionByName(used)
        leaders *= 4
    # One row per set on the one side, written; the copies of a set are on the other, where Spark can split a skewed key.
    scratch.drop("join-mixed", "join-current", "join-leaders", "join-left", "join-near", "join-asked", "join-asked-sets", "join-led", "join-sizes", "join-sets", "join-groups", "join-pairs", "join-links")
    owners = scratch.write(nodes.join(parts, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component_id")), "join-owners")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    linked = heads.filter(~alone).select("doc_id", "n_shingles", "set_a", "set_b").join(owners, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    return scratch.finish(linked.unionByName(heads.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "join")
