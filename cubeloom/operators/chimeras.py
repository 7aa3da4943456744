"""Chimeras with mismatches: sequences that follow one parent up to a break and another one after it.

1. *Candidates.*  A sequence is cut into chunks; for each chunk the parents that share most of its
   k-mers (then the larger, then the first name) are its candidates.
2. *Votes.*  Candidates are laid beside the sequence by the best path over shifts (an insertion or deletion shifts what follows).  For parents A (left) and B (right), a place where
   the sequence agrees with its side's parent only is a yes, with the other's only a no, and with neither an
   abstention.  A side scores ``yes / (no_weight * (no + prior) + abstain)``, a break the product of both sides.
3. *Decision.*  The best break of the best two candidates makes a chimera if the score, the gain of the
   model over the closer parent and the differences of each side are large enough.

``denovo`` takes larger sequences that are no chimeras themselves for parents.  Who is one depends on larger sequences
only, so repeating the decision with what was found before ends, at the latest when the longest chain of parents is
done.  ``against_reference`` takes the sequences of another table.

Work: a sequence's k-mers times the parents that have them, counted in blocks of sequences and parents; a block hands on
the best parents of each chunk only, so that pairs are neither written nor shuffled.  At most *per_chunk* candidates a chunk are aligned.
Defined cases: sequences shorter than a chunk needs have no candidates and are no chimeras; null sequences are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.session import written


@dataclass(frozen=True)
class Rules:
    """When a model is a chimera.  *exact*: the model must be the sequence itself, and no parent is."""

    min_score: float = 0.3
    min_differences: int = 3
    min_divergence: float = 1.0
    no_weight: float = 5.0
    prior: float = 1.4
    exact: bool = False


#: Parents that are laid beside their sequences at a time, and sequences that are decided at a time.
_PATHS, _QUERIES = 4096, 256
_COLUMNS = "name string, left_parent string, right_parent string, break_at int, score double, divergence double, left_differences int, right_differences int"


def beside(sequence: str, others: list[str], reach: int = 16, switch: int = 4) -> np.ndarray:
    """For each of *others* the letters that lie at the places of *sequence* (a row each, 0 for none).

    Each lies at a shift of at most *reach* that may change from place to place, so that most letters agree, where a change
    costs *switch* of them: the best path over shifts, all others at a time.  Those of the same length with at most one letter in fifty different lie as they are.
    """
    return beside_all([sequence], [others], reach, switch)[0]


def beside_all(sequences: list[str], groups: list[list[str]], reach: int = 16, switch: int = 4) -> list[np.ndarray]:
    """:func:`beside` of each of *sequences* with its group, the paths of all those of one length at a time."""
    out, hard = [], {}
    for which, (sequence, others) in enumerate(zip(sequences, groups)):
        own = np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)
        n = len(own)
        out.append(np.zeros((len(others), n), np.uint8))
        for row, other in enumerate(others):
            found = np.frombuffer(other.encode("ascii", "replace"), np.uint8)
            if len(found) == n and (found != own).mean() <= 0.02:
                out[-1][row] = found
            else:
                letters = np.zeros(n + 2 * reach, np.uint8)
                letters[reach : reach + min(len(found), n + reach)] = found[: n + reach]
                hard.setdefault(n, []).append((which, row, own, letters))
    for n, rows in hard.items():
        for lo in range(0, len(rows), _PATHS):
            some = rows[lo : lo + _PATHS]
            laid = _paths(np.stack([r[2] for r in some]), np.stack([r[3] for r in some]), n, reach, switch)
            for (which, row, _, _), letters in zip(some, laid):
                out[which][row] = letters
    return out


def _paths(own: np.ndarray, padded: np.ndarray, n: int, reach: int, switch: int) -> np.ndarray:
    moved = np.lib.stride_tricks.sliding_window_view(padded, n, axis=1)  # other, shift, place
    equal = np.ascontiguousarray(np.moveaxis(moved == own[:, None, :], 2, 0))
    score = np.full(equal.shape[1:], -switch, np.int32)
    score[:, reach] = 0  # no shift to begin with
    came = np.empty((n, *score.shape), np.int8)
    rows, stay = np.arange(len(own)), np.arange(2 * reach + 1, dtype=np.int8)
    for i in range(n):
        top = score.argmax(axis=1)
        jump = (score[rows, top] - switch)[:, None]
        came[i] = np.where(jump > score, top[:, None].astype(np.int8), stay)
        np.maximum(score, jump, out=score)
        score += equal[i]
    at = score.argmax(axis=1)
    out = np.zeros((len(own), n), np.uint8)
    for i in range(n - 1, -1, -1):
        out[:, i] = padded[rows, at + i]
        at = came[i][rows, at].astype(np.int64)
    return out


def best_model(sequence: str, others: list[str], rules: Rules, laid: np.ndarray | None = None) -> tuple | None:
    """``(left, right, break, score, divergence, left differences, right differences)`` of the best model, None if no two parents make one.

    Breaks are places from 1 to the last; of equal scores the first parents and break are taken.  *laid* is :func:`beside` where it is known.
    """
    own = np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)
    if len(others) < 2 or len(own) < 2:
        return None
    agrees = (beside(sequence, others) if laid is None else laid) == own
    total = agrees.sum(axis=1)
    # All pairs of parents at once: counts of places up to each break.
    a, b = agrees[:, None], agrees[None]
    yes, no, neither = (np.cumsum(x, axis=2, dtype=np.int32) for x in (a & ~b, ~a & b, ~a & ~b))
    y, n, z = no[:, :, -1:] - no, yes[:, :, -1:] - yes, neither[:, :, -1:] - neither  # on the right the roles are swapped
    scores = ((yes / (rules.no_weight * (no + rules.prior) + neither)) * (y / (rules.no_weight * (n + rules.prior) + z)))[:, :, :-1]
    scores[np.arange(len(others)), np.arange(len(others))] = 0
    flat = scores.reshape(len(others), -1)
    tops = flat.argmax(axis=1)
    best = None
    for first, top in enumerate(tops.tolist()):
        score = float(flat[first, top])
        if score > 0 and (best is None or score > best[3] + 1e-12):
            best = (first, *divmod(top, len(own) - 1), score)
    if best is not None:
        left, right, at, score = best
        model = int(agrees[left][: at + 1].sum() + agrees[right][at + 1 :].sum())
        closer = int(max(total[left], total[right]))
        divergence = 100.0 * (model - closer) / closer if closer else 0.0
        sides = (int(x[left, right, at] + v[left, right, at] + w[left, right, at]) for x, v, w in ((yes, no, neither), (y, n, z)))
        best = (left, right, at + 1, score, divergence, *sides, model, int(total.max()))
    if best is None:
        return None
    *found, model, closest = best
    if rules.exact:
        good = model == len(own) and closest < len(own)
    else:
        good = found[3] >= rules.min_score and found[4] >= rules.min_divergence and min(found[5:]) >= rules.min_differences
    return tuple(found) if good else None


def _numbered(letters: np.ndarray, k: int, alphabet: np.ndarray) -> np.ndarray:
    """A number for the *k* letters from each place of *letters* on, or the letters themselves where numbers don't suffice."""
    base = len(alphabet)
    if base**k >= 1 << 62:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters, k)).view(f"S{k}").ravel()
    rank = np.zeros(256, np.int64)
    rank[alphabet] = np.arange(base)
    of, n = rank[letters], len(letters) - k + 1
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out * base + of[j : j + n]
    return out.astype(np.uint16) if base**k <= 1 << 16 else out


def _words(letters: np.ndarray, lengths: np.ndarray, k: int, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the sequence, place and word of all k-mers; *letters* are those of all sequences."""
    n = np.maximum(lengths - k + 1, 0)
    of = np.repeat(np.arange(len(lengths)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(lengths) - lengths)[of] + place
    return of, place, _numbered(letters, k, alphabet)[start] if len(of) else np.zeros(0, np.uint16)


def best_shared(queries: list[str], sizes: np.ndarray, parents: list[str], parent_sizes: np.ndarray, k: int, chunks: int, skew: float | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, chunk, parent and number of common k-mers of the *most* parents that share most with each chunk (then the first).

    Parents are given from the largest to the smallest; *skew* times as large as the query they must be.
    """
    flat = [np.frombuffer("".join(x).encode("ascii", "replace"), np.uint8) for x in (queries, parents)]
    alphabet = np.unique(np.concatenate(flat))
    lengths = [np.array([len(x) for x in side], np.int64) for side in (queries, parents)]
    of, _, word = _words(flat[1], lengths[1], k, alphabet)
    asked, place, look = _words(flat[0], lengths[0], k, alphabet)
    if not len(of) or not len(asked):
        return (np.zeros(0, np.int64),) * 4
    order = np.argsort(word, kind="stable")
    word, of = word[order], of[order]
    new = np.append(True, (word[1:] != word[:-1]) | (of[1:] != of[:-1]))  # a parent counts once for a word
    word, of = word[new], of[new].astype(np.uint32)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    known, after = word[first], np.append(first[1:], len(word))
    at = np.minimum(np.searchsorted(known, look), len(known) - 1)
    segment = asked * chunks + place * chunks // (lengths[0][asked] - k + 1)
    hit = known[at] == look
    both = np.unique(segment[hit] * len(known) + at[hit])  # a word counts once for a chunk
    segment, at = both // len(known), both % len(known)
    amount = (after - first)[at]
    allowed = np.full(len(queries), len(parents)) if skew is None else np.searchsorted(-parent_sizes, -skew * sizes, side="right")
    # Lots end with a segment, and their segments times parents fit a small table.
    lot, row = (np.cumsum(amount) - 1) // _POSTINGS, segment // max(1, _CELLS // len(parents))
    found = []
    borders = np.unique(np.concatenate([np.searchsorted(segment, segment[np.flatnonzero(np.diff(lot)) + 1]), np.flatnonzero(np.diff(row)) + 1, [0, len(segment)]]))
    last = np.zeros(0, np.int32)
    for lo, hi in zip(borders[:-1], borders[1:]):
        n, base = amount[lo:hi], segment[lo]
        rows = np.repeat(first[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat((segment[lo:hi] - base) * len(parents), n) + of[rows]
        most_parents = allowed[segment[lo:hi] // chunks]
        if (most_parents < len(parents)).any():
            key = key[of[rows] < np.repeat(most_parents, n)]
        if not len(key):
            continue
        cells = int(segment[hi - 1] - base + 1) * len(parents)
        if cells > len(last):
            last = np.zeros(cells, np.int32)
        # Most pairs share one word. One number of each pair stays in the table, what else has the pair is counted.
        number = np.arange(len(key), dtype=np.int32)
        last[key] = number
        one = last[key] == number
        pair, shared = np.unique(key[~one], return_counts=True)
        shared += 1
        # Segments with too few of them are filled up with pairs of one word.
        enough = np.bincount(pair // len(parents), minlength=cells // len(parents)) >= most
        if not enough.all():
            single = key[one]
            single = np.setdiff1d(single[~enough[single // len(parents)]], pair, assume_unique=True)
            pair, shared = np.append(pair, single), np.append(shared, np.ones(len(single), shared.dtype))
            order = np.argsort(pair)
            pair, shared = pair[order], shared[order]
        if not len(pair):
            continue
        whose, parent = pair // len(parents), pair % len(parents)
        # The least number that the best of a segment have.
        top = int(shared.max()) + 1
        above = np.bincount(whose * top + shared, minlength=(int(whose[-1]) + 1) * top).reshape(-1, top)[:, ::-1].cumsum(axis=1)
        least = np.maximum(top - 1 - (above >= most).argmax(axis=1), 1)
        least[above[:, -1] < most] = 1
        good = shared >= least[whose]
        whose, parent, shared = whose[good], parent[good], shared[good]
        order = np.lexsort((parent, -shared, whose))
        whose, parent, shared = whose[order], parent[order], shared[order]
        begins = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
        inside = np.arange(len(whose)) - np.repeat(begins, np.diff(np.append(begins, len(whose))))
        keep = inside < most
        found.append((whose[keep] + base, parent[keep], shared[keep]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    whose, parent, shared = (np.concatenate(x) for x in zip(*found))
    return whose // chunks, whose % chunks, parent, shared


#: Places of words that are counted at a time, chunks times parents of their table, and sequences of a block.
_POSTINGS, _CELLS, _BLOCK = 2_000_000, 1 << 20, 8_192


def _packed(sequences: DataFrame, columns: list[str], most: int) -> DataFrame:
    """*columns* of *sequences* as lists, at most *most* rows in one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            while n >= most:
                whole = pd.concat(held)
                yield pd.DataFrame({c: [whole[c].iloc[:most].tolist()] for c in columns})
                held, n = [whole.iloc[most:]], n - most
        if n:
            whole = pd.concat(held)
            yield pd.DataFrame({c: [whole[c].tolist()] for c in columns})

    kinds = dict(sequences.dtypes)
    dealt = written(sequences.select(*columns), "chimera-sequences")
    dealt = dealt.repartition(max(1, -(-dealt.count() // most)))
    return written(dealt.mapInPandas(run, ", ".join(f"{c} array<{kinds[c]}>" for c in columns)), "chimera-blocks")


def candidates(queries: DataFrame, parents: DataFrame, k: int, chunks: int, per_chunk: int, skew: float | None) -> DataFrame:
    """``query, parent``: for each chunk of *queries* the *per_chunk* parents, *skew* times as large, that share most of its k-mers (then the larger, then the first name)."""
    # Equal parents are counted once: of those of one size the first names, and one more, as a query is no parent of its own.
    copies = Window.partitionBy("seq", "size").orderBy("name")
    few = parents.select("name", "seq", "size").withColumn("r", F.row_number().over(copies)).filter(F.col("r") <= per_chunk + 1)
    classes = few.groupBy("seq", "size").agg(F.sort_array(F.collect_list("name")).alias("names"))
    listed = _packed(classes.select(F.col("seq").alias("pseq"), F.col("size").alias("psize"), "names"), ["pseq", "psize", "names"], 8 * _BLOCK)
    asked = _packed(queries.select("name", "seq", "size"), ["name", "seq", "size"], _BLOCK)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                order = sorted(range(len(row.psize)), key=lambda i: (-row.psize[i], row.names[i][0]))
                psize, names = np.array(row.psize)[order], [list(row.names[i]) for i in order]
                query, chunk, parent, n = best_shared(list(row.seq), np.array(row.size), [row.pseq[i] for i in order], psize, k, chunks, skew, per_chunk + 1)
                made = pd.DataFrame({"query": np.array(row.name, dtype=object)[query], "chunk": chunk, "n": n, "parent_size": psize[parent], "parent": [names[p] for p in parent]})
                yield made.explode("parent").query("query != parent")

    # Every block of queries with every block of parents: the comparison is that product.
    counted = asked.join(listed).mapInPandas(run, "query string, chunk int, n long, parent_size long, parent string")
    order = Window.partitionBy("query", "chunk").orderBy(F.desc("n"), F.desc("parent_size"), "parent")
    return counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_chunk).select("query", "parent").distinct()


def _decided(queries: DataFrame, parents: DataFrame, chosen: DataFrame, rules: Rules) -> DataFrame:
    """The chimeras among *queries* by their *chosen* candidates."""
    with_letters = chosen.join(parents.select(F.col("name").alias("parent"), F.col("seq").alias("parent_seq")), "parent")
    grouped = with_letters.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("parent", "parent_seq"))).alias("parents"))
    sides = grouped.filter(F.size("parents") > 1).join(queries.select(F.col("name").alias("query"), "seq"), "query")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lo in range(0, len(frame), _QUERIES):
                some = frame.iloc[lo : lo + _QUERIES]
                letters = [[p["parent_seq"] for p in around] for around in some["parents"]]
                laid = beside_all(some["seq"].tolist(), letters)
                for name, seq, around, others, lies in zip(some["query"], some["seq"], some["parents"], letters, laid):
                    found = best_model(seq, others, rules, lies)
                    if found:
                        out.append((name, around[found[0]]["parent"], around[found[1]]["parent"], *found[2:]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _COLUMNS.split(", ")])

    return sides.select("query", "seq", "parents").mapInPandas(run, _COLUMNS)


def against_reference(queries: DataFrame, reference: DataFrame, rules: Rules = Rules(), k: int = 8, chunks: int = 4, per_chunk: int = 4) -> DataFrame:
    """The chimeras of *queries* (``name, seq``) whose parents are in *reference* (``name, seq``)."""
    queries, parents = (x.filter("seq is not null").select("name", "seq", F.lit(1).cast("long").alias("size")) for x in (queries, reference))
    return _decided(queries, parents, candidates(queries, parents, k, chunks, per_chunk, None), rules)


def denovo(sequences: DataFrame, rules: Rules = Rules(), min_skew: float = 2.0, k: int = 8, chunks: int = 4, per_chunk: int = 4) -> DataFrame:
    """The chimeras of *sequences* (``name, seq, size``) whose parents are larger ones (*min_skew* times, above 1) that are none."""
    if min_skew <= 1:
        raise ValueError("parents must be larger than their chimeras")
    all_ = sequences.filter("seq is not null and size is not null").select("name", "seq", F.col("size").cast("long").alias("size"))
    bounds = all_.agg(F.min("size").alias("least"), F.max("size").alias("most")).first()
    if bounds["least"] is None:
        return written(all_.sparkSession.createDataFrame([], _COLUMNS), "chimeras")
    queries, parents = all_.filter(min_skew * F.col("size") <= bounds["most"]), all_.filter(F.col("size") >= min_skew * bounds["least"])
    before, allowed = (0, None), parents
    while True:
        found = written(_decided(queries, allowed, candidates(queries, allowed, k, chunks, per_chunk, min_skew), rules), "chimeras")
        # Only those that could be parents change what the next round finds.
        barred = parents.join(found.select("name"), "name", "left_semi")
        now = tuple(barred.agg(F.count("*"), F.sum(F.xxhash64("name").cast("decimal(38,0)"))).first())
        if now == before:
            return found
        before, allowed = now, parents.join(found.select("name"), "name", "left_anti")


def both(sequences: DataFrame, reference: DataFrame, rules: Rules = Rules(), **options) -> DataFrame:
    """``name`` of the chimeras that either way finds."""
    return denovo(sequences, rules, **options).select("name").unionByName(against_reference(sequences, reference, rules).select("name")).distinct()
