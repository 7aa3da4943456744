"""Overlapping mates as one read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions.sequences import reverse_complement


def overlap(a: str, b: str, least: int, most_mismatches: int, most_share: float) -> tuple[int, int] | None:
    """Length and mismatches of the best overlap of *a*'s end with *b*'s start; the longest of equally good ones.

    Where *b* begins before *a* (a staggered pair) the part in common is compared.
    """
    x, y = np.frombuffer(a.encode(), dtype=np.uint8), np.frombuffer(b.encode(), dtype=np.uint8)
    best = None
    for shift in range(len(x) - least, least - len(y) - 1, -1):
        low, high = max(shift, 0), min(len(x), shift + len(y))
        n = high - low
        if n < least:
            continue
        wrong = int(np.count_nonzero(x[low:high] != y[low - shift : high - shift]))
        if wrong <= most_mismatches and wrong / n <= most_share and (best is None or (wrong / n, -n) < best[0]):
            best = ((wrong / n, -n), shift, wrong)
    return None if best is None else (best[1], best[2])


def join_overlap(a: str, qa: str, b: str, qb: str, shift: int) -> tuple[str, str]:
    """The merged read from *a*'s start to *b*'s end: the better base where both have one, with the sum or difference of qualities (at most 41)."""
    end = shift + len(b)
    bases, quals = [], []
    for i in range(max(0, min(shift, 0)), end):
        in_a, in_b = i < len(a), 0 <= i - shift < len(b)
        if in_a and in_b:
            p, q, s, t = a[i], b[i - shift], ord(qa[i]) - 33, ord(qb[i - shift]) - 33
            bases.append(p if s >= t else q)
            quals.append(min(41, s + t) if p == q else max(2, abs(s - t)))
        elif in_a or in_b:
            bases.append(a[i] if in_a else b[i - shift])
            quals.append(ord(qa[i] if in_a else qb[i - shift]) - 33)
    return "".join(bases), "".join(chr(33 + q) for q in quals)


def merge_overlapping(pairs: DataFrame, min_overlap: int = 10, max_mismatches: int = 99999, max_share: float = 0.5, min_length: int = 1) -> DataFrame:
    """``name, seq, qual`` of pairs (``name, seq, qual, mate_seq, mate_qual``) that overlap well enough and are long enough."""
    turned = pairs.select("name", "seq", "qual", reverse_complement(F.col("mate_seq")).alias("b"), F.reverse("mate_qual").alias("qb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, a, qa, b, qb in frame.itertuples(index=False):
                found = overlap(a, b, min_overlap, max_mismatches, max_share) if a and b else None
                if found:
                    seq, qual = join_overlap(a, qa, b, qb, found[0])
                    if len(seq) >= min_length:
                        rows.append((name, seq, qual))
            yield pd.DataFrame(rows, columns=["name", "seq", "qual"])

    return turned.mapInPandas(run, "name string, seq string, qual string")
