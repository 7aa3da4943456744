"""Semi-global alignment of a primer or query with a read.

Scores are filled over the reversed strings, so that the traced path prefers
what lies further left; on a tie the diagonal is taken, but for the last row
and column, where gaps go first.  Many pairs are filled at a time, cell by cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cubeloom.functions.sequences import base_mask

DIAGONAL, IN_SUBJECT, IN_QUERY = 0, 1, 2


@dataclass(frozen=True)
class Scores:
    match: int = 5
    mismatch: int = -4
    gap_open: int = -10
    gap_extend: int = -1
    end_gap: str = "nobody"  # or match, mismatch, gap

    def end(self) -> int | None:
        """What an end gap costs; None: as any gap."""
        return {"nobody": 0, "match": self.match, "mismatch": self.mismatch, "gap": None}[self.end_gap]


def same(a: str, b: str) -> bool:
    """Whether two letters are compatible."""
    if a == "-" or b == "-":
        return a == b
    return bool(base_mask(a) & base_mask(b))


#: The set of nucleotides of every letter; a gap has none.
_MASKS = np.array([base_mask(chr(i)) if chr(i).isalpha() else 0 for i in range(128)], dtype=np.uint8)


def _letters(strings: list[str]) -> np.ndarray:
    """Strings of one length, reversed, a row each."""
    return np.frombuffer("".join(x[::-1] for x in strings).encode("ascii", "replace"), dtype=np.uint8).reshape(len(strings), -1)


def _filled(s: np.ndarray, q: np.ndarray, scores: Scores) -> np.ndarray:
    """The ways ``[i, j, pair]`` of the best alignments of reversed subjects and queries: a cell of all pairs at a time."""
    pairs, n, m = len(s), s.shape[1], q.shape[1]
    end = scores.end()
    edge = [end * k if end is not None else (scores.gap_open + scores.gap_extend * (k - 1) if k else 0) for k in range(max(n, m) + 1)]
    way = np.full((n + 1, m + 1, pairs), DIAGONAL, dtype=np.int8)
    way[0, 1:], way[1:, 0] = IN_SUBJECT, IN_QUERY
    row = [np.full(pairs, edge[j], dtype=np.int32) for j in range(m + 1)]
    for i in range(1, n + 1):
        before, row = row, [np.full(pairs, edge[i], dtype=np.int32)]
        for j in range(1, m + 1):
            equal = (_MASKS[s[:, i - 1]] & _MASKS[q[:, j - 1]]) > 0
            across = before[j - 1] + np.where(equal, scores.match, scores.mismatch)
            if end is not None and (i == n or j == m):
                left, up = row[j - 1] + end, before[j] + end
            else:
                left = row[j - 1] + np.where((way[i, j - 1] == IN_SUBJECT) & (j > 1), scores.gap_extend, scores.gap_open)
                up = before[j] + np.where((way[i - 1, j] == IN_QUERY) & (i > 1), scores.gap_extend, scores.gap_open)
            go_left = ((left >= across) if i == n else (left > across)) & (left > up)
            go_up = ((up >= across) if j == m else (up > across)) & (up >= left)
            way[i, j] = np.where(go_left, IN_SUBJECT, np.where(go_up, IN_QUERY, DIAGONAL))
            row.append(np.where(go_left, left, np.where(go_up, up, across)).astype(np.int32))
    return way


def align_many(subjects: list[str], queries: list[str], scores: Scores = Scores()) -> list[tuple[str, str]]:
    """Each pair of strings with gaps (``-``), aligned from end to end.

    Pairs of equal lengths are filled together, at most ``_TOGETHER`` at a time.
    """
    out: list[tuple[str, str]] = [("", "")] * len(subjects)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (s, q) in enumerate(zip(subjects, queries)):
        groups.setdefault((len(s), len(q)), []).append(k)
    for (n, m), members in groups.items():
        for at in range(0, len(members), _TOGETHER):
            chosen = members[at : at + _TOGETHER]
            way = _filled(_letters([subjects[k] for k in chosen]), _letters([queries[k] for k in chosen]), scores)
            for p, k in enumerate(chosen):
                out[k] = _traced(way[:, :, p].tolist(), subjects[k][::-1], queries[k][::-1])
    return out


_TOGETHER = 2000


def _traced(way: list[list[int]], s: str, q: str) -> tuple[str, str]:
    """The path from the last cell back; the strings are reversed, so it comes out forwards."""
    i, j, out_s, out_q = len(s), len(q), [], []
    while i or j:
        step = way[i][j]
        out_s.append("-" if step == IN_SUBJECT else s[i - 1])
        out_q.append("-" if step == IN_QUERY else q[j - 1])
        i, j = i - (step != IN_SUBJECT), j - (step != IN_QUERY)
    return "".join(out_s), "".join(out_q)


def align(subject: str, query: str, scores: Scores = Scores()) -> tuple[str, str]:
    """:func:`align_many` of one pair."""
    return align_many([subject], [query], scores)[0]


@dataclass(frozen=True)
class Location:
    """Where a primer lies: 0-based start and end (inclusive), mismatches and their share, the tag read at its N positions."""

    start: int
    end: int
    mismatches: int
    share: float
    umi: str


def locate(subject: str, primer: str, at_head: bool = True, scores: Scores = Scores(), skip_n: bool = False, umi_limit: int = 0) -> Location:
    """:func:`locate_many` of one subject."""
    return locate_many([subject], primer, at_head, scores, skip_n, umi_limit)[0]


def locate_many(subjects: list[str], primer: str, at_head: bool = True, scores: Scores = Scores(), skip_n: bool = False, umi_limit: int = 0) -> list[Location]:
    """The place of *primer* in each of *subjects*.

    At the head the alignment is anchored at the read's start; otherwise the
    primer is looked for further on.  Positions of N at the primer's outer end
    are taken as a tag (up to *umi_limit* letters), and with *skip_n* aren't compared.
    """
    return [_located(a, b, at_head, skip_n, umi_limit) for a, b in align_many(subjects, [primer] * len(subjects), scores)]


def _located(a: str, b: str, at_head: bool, skip_n: bool, umi_limit: int) -> Location:
    lead = 0 if at_head else len(b) - len(b.lstrip("-"))
    stop = len(b.rstrip("-"))
    columns = list(zip(a[lead:stop], b[lead:stop]))
    outer, umi, length, mismatches = True, [], 0, 0
    for sc, qc in columns if at_head else columns[::-1]:
        if outer and qc == "N":
            if len(umi) < umi_limit:
                umi.append(sc)
            if skip_n:
                continue
        else:
            outer = False
        length += 1
        mismatches += not same(qc, sc)
    inside = sum(c != "-" for c in a[lead:stop])
    start = sum(c != "-" for c in a[:lead])
    text = "".join(umi if at_head else umi[::-1]).replace("-", "")
    return Location(start, start + inside - 1, mismatches, mismatches / length if length else 0.0, text)
