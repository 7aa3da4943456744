"""Nucleotide and quality strings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bases that each letter of the public nucleotide code stands for.
CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T",
    "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
#: Letters and their complements.
COMPLEMENT = ("ACGTUMRYKVHDB", "TGCAAKYRMBDHV")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base_mask(code: str) -> int:
    """A letter's bases as bits; 0 for letters without bases."""
    return sum(1 << "ACGT".index(b) for b in CODES.get(code, ""))


def clean(sequence: Column) -> Column:
    """Upper-case letters only."""
    return F.upper(F.regexp_replace(sequence, "[^A-Za-z]", ""))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, *COMPLEMENT))


def qualities(qual: Column) -> Column:
    """The numbers of a quality string (offset 33)."""
    return F.when(F.length(qual) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33))


def quality_string(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda q: F.char(q + 33)), "")


def expected_errors(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda total, q: total + F.pow(F.lit(10.0), -q / 10.0))


def mean_quality(numbers: Column) -> Column:
    """Null for an empty read."""
    return F.try_divide(F.aggregate(numbers, F.lit(0).cast("long"), lambda total, q: total + q), F.size(numbers))


def low_share(numbers: Column, least: int) -> Column:
    """The share of qualities below *least*; null for an empty read."""
    return F.try_divide(F.size(F.filter(numbers, lambda q: q < least)), F.size(numbers))


def mask_low(sequence: Column, numbers: Column, least: int) -> Column:
    """Bases of a quality below *least* as ``?``."""
    return F.array_join(F.zip_with(F.split(sequence, ""), numbers, lambda b, q: F.when(q < least, "?").otherwise(b)), "")


def compatible(a: Column, b: Column) -> Column:
    """Whether two letters can stand for the same base; a gap only goes with a gap."""
    mask = F.create_map(*[x for c in CODES for x in (F.lit(c), F.lit(base_mask(c)))])
    both = F.coalesce(F.try_element_at(mask, a), F.lit(0)).bitwiseAND(F.coalesce(F.try_element_at(mask, b), F.lit(0)))
    return F.when((a == "-") | (b == "-"), a == b).otherwise(both != 0)


def expansions(primer: str) -> list[str]:
    """All plain sequences that a degenerate one stands for, in order."""
    return reduce(lambda done, code: [d + b for d in done for b in CODES[code]], primer.upper(), [""])


def expanded(primer: Column) -> Column:
    """As :func:`expansions`, of a column: an array."""
    bases = F.create_map(*[x for c, b in CODES.items() for x in (F.lit(c), F.array(*map(F.lit, b)))])
    return F.aggregate(
        F.split(F.upper(primer), ""),
        F.array(F.lit("")),
        lambda done, code: F.flatten(F.transform(done, lambda d: F.transform(F.try_element_at(bases, code), lambda b: F.concat(d, b)))),
    )


@F.pandas_udf(T.StringType())
def base62(sequence: pd.Series) -> pd.Series:
    """A plain sequence, read as a number to base 4 with a leading 1, to base 62; others stay as they are."""
    order = str.maketrans("ACGT", "0123")

    def one(s: str | None) -> str | None:
        if not s or set(s) - set("ACGT"):
            return s
        number, out = int("1" + s.translate(order), 4), ""
        while number:
            number, digit = divmod(number, 62)
            out = _DIGITS[digit] + out
        return out

    return sequence.map(one)


@F.pandas_udf(T.StringType())
def from_base62(packed: pd.Series) -> pd.Series:
    """The sequence that :func:`base62` has packed."""

    def one(s: str | None) -> str | None:
        if not s:
            return s
        number, out = 0, ""
        for c in s:
            number = number * 62 + _DIGITS.index(c)
        while number > 1:
            number, digit = divmod(number, 4)
            out = "ACGT"[digit] + out
        return out

    return packed.map(one)


@F.pandas_udf(T.IntegerType())
def kept_length(qual: pd.Series, least: pd.Series, tail: pd.Series) -> pd.Series:
    """The length left after trimming the 3' end.

    While one of the last *tail* qualities is below *least*, the read is cut
    before the first such one.
    """

    def one(q: str | None, low: int, width: int) -> int:
        n = len(q or "")
        while True:
            bad = [i for i in range(max(0, n - width), n) if ord(q[i]) - 33 < low]
            if not bad:
                return n
            n = bad[0]

    return pd.Series([one(*x) for x in zip(qual, least, tail)])
