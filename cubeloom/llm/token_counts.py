"""Token counts by section: whole texts are encoded once, tokens are attributed by their spans.

A document is encoded as a whole, so that no token is changed by cutting the
text first.  The tokens' spans follow from the vocabulary's token lengths: the
characters (code points) that a token has any byte of.  Spans and sections are
both ordered, and so the interval join of tokens with
sections is a binary search of the section boundaries, done where the document
lies.  Without a table of sections nothing is shuffled, and the sections are the lines of
a text, each with the ``\\n`` that ends it.  A table of sections (``doc_id, section,
start, end``, in characters; fields that were joined to one text, headings,
quotations) is joined to the documents by id.  Where sections overlap the one
that begins first (then the smaller number) keeps the part; text in none of them is section null.

Rule for a token that lies in several sections (``rule``):

* ``largest`` (default): the section that holds most of its characters, the earliest on a tie;
* ``first``: the section of its first character;
* ``split``: every section, by its share of the token's characters (``n_tokens`` is then a fraction).

Under the first two rules the counts of a document's sections add up to the
tokens of the whole document, whatever the sections are.

Defined cases: a null or empty text has one empty section (0) with no token, or
its table's sections without any; sections beyond the text's end are cut there,
those without a number, an id or an extent are ignored; ids may be null (without sections then) or repeat
(rows are independent, all of an id have its sections); an empty
table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.bpe import BpeModel, broadcast_model, model_of
from cubeloom.llm.common import bound_batches, lean

RULES = ("largest", "first", "split")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in, and boundary-crossing tokens that touch, each section ``[bounds[i], bounds[i+1])``."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = np.flatnonzero(last > first)
    counts = np.bincount(first[last == first], minlength=n).astype(np.float64)
    touched = np.zeros(n, dtype=np.int64)
    for t in crossing:
        i, j = int(first[t]), int(last[t])
        edges = np.clip(bounds[i : j + 2], starts[t], ends[t])
        share = np.diff(edges)
        touched[i : j + 1] += share > 0
        if rule == "split":
            counts[i : j + 1] += share / (ends[t] - starts[t])
        else:
            counts[i if rule == "first" else i + int(np.argmax(share))] += 1
    return counts, touched


def cover(size: int, ranges: list[tuple[int, int, int]]) -> tuple[list[int | None], np.ndarray]:
    """Sections that part a text of *size* characters, and their bounds; *ranges* are ``start, section, end``."""
    names, bounds = [], [0]
    for start, section, end in sorted(ranges):
        start, end = max(start, bounds[-1]), min(end, size)
        if end <= start:
            continue
        if start > bounds[-1]:
            names.append(None)
            bounds.append(start)
        names.append(section)
        bounds.append(end)
    if bounds[-1] < size:
        names.append(None)
        bounds.append(size)
    return names, np.array(bounds, dtype=np.int64)


def sections_of(model: BpeModel, text: str, rule: str, ranges: list[tuple[int, int, int]] | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """Name, characters, tokens and crossing tokens of every section of *text*."""
    letters = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((letters & 0xC0) != 0x80) - 1  # of each byte
    if ranges is None:  # the lines
        cuts = character[letters == 10] + 1
        bounds = np.concatenate([[0], cuts[cuts < len(text)], [len(text)]])
        names = list(range(len(bounds) - 1))
    else:
        names, bounds = cover(len(text), ranges)
    ids = np.frombuffer(model.encode(text), dtype="<u4").astype(np.int64)
    ends = np.cumsum(model.token_length[ids])
    counts, touched = attribute(character[ends - model.token_length[ids]], character[ends - 1] + 1, bounds, rule)
    return names, np.diff(bounds), counts, touched


def count_by_section(df: DataFrame, path: str, rule: str = "largest", sections: DataFrame | None = None) -> DataFrame:
    """One row per section of every document: ``doc_id, section, n_chars, n_tokens, n_crossing``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bound_batches(df.sparkSession)
    shipped = broadcast_model(df.sparkSession, path)
    kind = "double" if rule == "split" else "long"
    given = sections is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shipped)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            ranges = batch.column(2).to_pylist()
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = [(x["start"], x["section"], x["end"]) for x in ranges[k] or ()] if given else None
                if text:
                    found = sections_of(model, text, rule, own)
                    seen = sorted({x[1] for x in own or ()} - set(found[0]))  # cut away as a whole
                else:
                    found, seen = ([], *(np.zeros(0, dtype=np.int64) for _ in range(3))), sorted({x[1] for x in own}) if given else [0]
                empty = np.zeros(len(seen), dtype=np.int64)
                for to, x, y in zip(rows, (np.full(len(found[0]) + len(seen), k), *found), (None, seen, empty, empty, empty)):
                    to.extend(x if y is None else [*x, *y])
            at, section, chars, counts, touched = rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(section, pa.int64()),
                    pa.array(chars, pa.int64()),
                    pa.array(np.array(counts, dtype=float if rule == "split" else np.int64)),
                    pa.array(touched, pa.int64()),
                ],
                names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing"],
            )

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if given:
        numbers = [F.col(c).cast("long").alias(c) for c in ("start", "section", "end")]
        listed = sections.select(F.col("doc_id").cast("long").alias("doc_id"), *numbers).filter("doc_id is not null and section is not null and start >= 0 and end > start")
        # As many as a document has sections.
        source = source.join(listed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "section", "end")).alias("ranges")), "doc_id", "left")
    else:
        source = source.withColumn("ranges", F.lit(None).cast("int"))
    return source.mapInArrow(lean(run), f"doc_id long, section long, n_chars long, n_tokens {kind}, n_crossing long")
