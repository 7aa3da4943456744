"""Composite sample names (``run__tag__primer``) and read names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_part(sample: Column, part: str) -> Column:
    """``run``, ``tag`` or ``primer`` of a sample name; null unless it has just three parts."""
    parts = F.split(sample, "__", -1)
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(("run", "tag", "primer").index(part))))


def checked_sample(sample: Column) -> Column:
    """The sample name; an error at run time unless it has three parts."""
    return F.when(F.size(F.split(sample, "__", -1)) == 3, sample).otherwise(F.raise_error(F.concat(F.lit("not run__tag__primer: "), sample)))


def with_run(sample: Column, runname: str) -> Column:
    """The sample name with another run."""
    return F.concat(F.lit(runname), F.regexp_replace(sample, r"^.+?(?=__)", ""))


def sample_of_read(readname: Column) -> Column:
    """The sample that a read's name carries after `` SN:``; null if none."""
    return F.nullif(F.regexp_extract(readname, r" SN:(\S+)", 1), F.lit(""))


def without_size(name: Column) -> Column:
    return F.regexp_replace(name, r";size=\d+;?", "")


def any_word(column: Column, words: list[str]) -> Column:
    """Whether *column* matches one of the regular expressions, whatever the case."""
    return column.rlike("(?i)(" + "|".join(f"(?:{w})" for w in words) + ")") if words else F.lit(False)


def any_literal(column: Column, words: list[str]) -> Column:
    return any_word(column, [re.escape(w) for w in words])


def clean_taxon(column: Column) -> Column:
    """Blanks and colons of a taxon as underscores."""
    return F.translate(column, " :", "__")
