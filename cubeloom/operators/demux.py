"""Demultiplexing: tags, primers, sample names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.functions.alignment import Scores, locate_many
from cubeloom.functions.sequences import qualities, reverse_complement


def tag_table(forward: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
    """``tag, tagname`` of tag lists (``rec_no, name, seq``), two lists being joined by position as ``fwd+rev``.

    A tag with other letters than ACGT, of another length than the first, or
    given twice is an error at run time.
    """
    tags = forward.select("rec_no", F.col("name").alias("tagname"), F.upper("seq").alias("tag"))
    if reverse is not None:
        tags = tags.join(reverse.select("rec_no", F.upper("seq").alias("second")), "rec_no").select("rec_no", "tagname", F.concat_ws("+", "tag", "second").alias("tag"))
    widths = F.max(F.length("tag")).over(Window.partitionBy())
    twice = F.count("*").over(Window.partitionBy("tag"))
    bad = ~F.col("tag").rlike(r"^[ACGT]+(\+[ACGT]+)?$") | (F.length("tag") != F.col("__w")) | (F.col("__n") > 1) | F.contains("tagname", F.lit("__"))
    checked = tags.withColumn("__w", widths).withColumn("__n", twice)
    return checked.select(F.when(bad, F.raise_error(F.concat(F.lit("not a tag: "), "tagname"))).otherwise(F.col("tag")).alias("tag"), "tagname")


def normalised(reads: DataFrame, tag: int = 0, reverse_tag: int = 0) -> DataFrame:
    """``index_seq, index_qual, seq, qual, mate_seq, mate_qual`` of one to four reads in step (``seq1, qual1`` to ``seq4, qual4``, null: none).

    *tag* and *reverse_tag* are the lengths of the tags that the run has (0: none).  A tag is a read of its own
    right after the first one (both: the second and the third), else it begins the
    read of its direction, or with one read only the reverse tag ends it.  The first
    layout that fits a record is taken; none that does is an error.
    """
    has = lambda i: F.coalesce(F.length(f"seq{i}") > 0, F.lit(False))
    long = lambda i, n: F.coalesce(F.length(f"seq{i}") == n, F.lit(False))
    whole = lambda i: (F.col(f"seq{i}"), F.col(f"qual{i}"))
    cut = lambda i, start, end: tuple(F.expr(f"substring({c}{i}, {start + 1}, greatest(length({c}{i}) - {start + end}, 0))") for c in ("seq", "qual"))
    head = lambda i, n: tuple(F.substring(f"{c}{i}", 1, n) for c in ("seq", "qual"))
    tail = lambda i, n: tuple(F.expr(f"right({c}{i}, {n})") for c in ("seq", "qual"))
    none = (F.lit(None).cast("string"),) * 2
    both = lambda x, y: (F.concat(x[0], F.lit("+"), y[0]), F.concat(x[1], y[1]))
    if tag and reverse_tag:
        own = long(2, tag) & long(3, reverse_tag)
        layouts = [
            (own & has(4), both(whole(2), whole(3)), whole(1), whole(4)),
            (own, both(whole(2), whole(3)), whole(1), none),
            (has(2) & ~has(3) & ~has(4), both(head(1, tag), head(2, reverse_tag)), cut(1, tag, 0), cut(2, reverse_tag, 0)),
            (~has(2) & ~has(3) & ~has(4), both(head(1, tag), tail(1, reverse_tag)), cut(1, tag, reverse_tag), none),
        ]
    elif tag or reverse_tag:
        own = long(2, tag or reverse_tag)
        inline = (head(1, tag), cut(1, tag, 0), whole(2)) if tag else (head(2, reverse_tag), whole(1), cut(2, reverse_tag, 0))
        single = (head(1, tag), cut(1, tag, 0), none) if tag else (tail(1, reverse_tag), cut(1, 0, reverse_tag), none)
        layouts = [(~has(4) & own & has(3), whole(2), whole(1), whole(3)), (~has(4) & own, whole(2), whole(1), none), (~has(4) & has(2), *inline), (~has(4), *single)]
    else:
        layouts = [(~has(3) & ~has(4) & has(2), none, whole(1), whole(2)), (~has(3) & ~has(4), none, whole(1), none)]
    names = ["index_seq", "index_qual", "seq", "qual", "mate_seq", "mate_qual"]
    found = F.when(~has(1), F.raise_error(F.lit("a record has no first read")))
    for fits, *parts in layouts:
        found = found.when(fits, F.struct(*(c.alias(n) for n, c in zip(names, (c for part in parts for c in part)))))
    found = found.otherwise(F.raise_error(F.lit("a record fits no layout")))
    rest = [c for c in reads.columns if c not in {f"{k}{i}" for k in ("seq", "qual") for i in range(1, 5)}]
    return reads.withColumn("__layout", found).select(*rest, "__layout.*").filter("seq != ''")


def jumped_tags(tags: DataFrame) -> DataFrame:
    """``tag``: combinations of the lists' halves that are no tag of their own."""
    halves = tags.select(F.split_part("tag", F.lit("+"), F.lit(1)).alias("a"), F.split_part("tag", F.lit("+"), F.lit(2)).alias("b"))
    # All combinations of a run's halves are asked for.
    crossed = halves.select("a").distinct().join(halves.select("b").distinct()).select(F.concat_ws("+", "a", "b").alias("tag"))
    return crossed.join(tags.select("tag"), "tag", "left_anti")


def good_tag(index_quality: Column, least: int) -> Column:
    """Whether all qualities of an index read are *least* or more."""
    return F.forall(qualities(index_quality), lambda q: q >= least)


def assign_tags(reads: DataFrame, tags: DataFrame, runname: str, primer: str, least_quality: int = 0, jumped: bool = True) -> DataFrame:
    """*reads* (with ``index_seq``, ``index_qual``) with ``samplename``.

    The tag's name if it is known and good enough, else (with *jumped*) the tag
    itself if both its halves are known, else ``undetermined``.
    """
    named = reads.join(tags.withColumnRenamed("tag", "index_seq"), "index_seq", "left")
    name = F.when(good_tag(F.col("index_qual"), least_quality), F.col("tagname"))
    if jumped:
        odd = jumped_tags(tags).select(F.col("tag").alias("index_seq"), F.col("tag").alias("jump"))
        named = named.join(odd, "index_seq", "left")
        name = F.coalesce(name, F.when(good_tag(F.col("index_qual"), least_quality), F.col("jump")))
    sample = F.concat_ws("__", F.lit(runname), F.coalesce(name, F.lit("undetermined")), F.lit(primer))
    return named.select(*reads.columns, sample.alias("samplename"))


_FOUND = T.StructType([T.StructField(n, t) for n, t in (("primer", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("mismatches", T.IntegerType()), ("share", T.DoubleType()), ("umi", T.StringType()))])


def locate_primers(
    reads: DataFrame,
    primers: list[tuple[str, str]],
    at_head: bool = True,
    max_share: float = 0.14,
    max_mismatches: int | None = None,
    all_hits: bool = False,
    scores: Scores = Scores(),
    skip_n: bool = False,
    umi_limit: int = 0,
) -> DataFrame:
    """*reads* with ``hit``: place of the first primer (name, sequence) that fits, null if none; or a row per fit.

    A primer is looked for in twice its length at the head, or in the whole read.
    Equal heads are aligned once.
    """
    width = 2 * max((len(p) for _, p in primers), default=0)
    head = F.substring("seq", F.lit(1), F.lit(width)) if at_head else F.col("seq")
    keyed = reads.withColumn("__head", head)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["__head"].tolist()
            out: list[list[tuple]] = [[] for _ in texts]
            for name, primer in primers:
                open_ = [k for k, hits in enumerate(out) if all_hits or not hits]
                places = locate_many([texts[k][: 2 * len(primer)] if at_head else texts[k] for k in open_], primer, at_head, scores, skip_n, umi_limit)
                for k, at in zip(open_, places):
                    if at.share <= max_share and (max_mismatches is None or at.mismatches <= max_mismatches):
                        out[k].append((name, at.start, at.end, at.mismatches, at.share, at.umi))
            yield pd.DataFrame({"__head": frame["__head"], "hits": out})

    schema = T.StructType([T.StructField("__head", T.StringType()), T.StructField("hits", T.ArrayType(_FOUND))])
    found = keyed.select("__head").filter("__head is not null").distinct().mapInPandas(run, schema)
    joined = keyed.join(found, "__head", "left")
    hit = F.explode_outer("hits") if all_hits else F.get("hits", F.lit(0))
    return joined.select(*reads.columns, hit.alias("hit"))


def primer_list(forward: DataFrame, reverse: DataFrame | None = None) -> list[tuple[str, str]] | list[tuple[str, str, str]]:
    """Primers of a design list (``rec_no, name, seq``) as :func:`locate_primers` takes them; with a second list each with its partner by position.

    Lists of different lengths and other letters than those of nucleotides are errors.
    """
    lists = [[(r["name"], r["seq"].upper()) for r in frame.orderBy("rec_no").collect()] for frame in (forward, reverse) if frame is not None]
    for name, seq in (x for listed in lists for x in listed):
        if not seq or set(seq) - set("ACGTMRWSYKVHDBNI"):
            raise ValueError(f"not a primer: {name}")
    if len(lists) == 1:
        return lists[0]
    if len(lists[0]) != len(lists[1]):
        raise ValueError("the primer lists differ in length")
    return [(name, seq, other) for (name, seq), (_, other) in zip(*lists)]


def cut_primer(located: DataFrame, mask: bool = False) -> DataFrame:
    """Reads with a hit, the primer at the head cut off, or with *mask* put in lower case."""
    n = F.col("hit.end") + 1
    rest = [F.expr(f"substring({c}, hit.end + 2)") for c in ("seq", "qual")]
    kept = located.filter("hit is not null")
    if mask:
        return kept.withColumn("seq", F.concat(F.lower(F.expr("substring(seq, 1, hit.end + 1)")), rest[0])).drop("hit")
    return kept.filter(n < F.length("seq")).withColumn("seq", rest[0]).withColumn("qual", rest[1]).drop("hit")


def divide_at(sequences: DataFrame, query: str, max_share: float = 0.15, border: str = "both", scores: Scores = Scores()) -> DataFrame:
    """``name, former, latter, found``: sequences (``name, seq, qual``) divided at *query*.

    The query is cut out (``both``), or stays with the former (``end``) or the latter part (``start``).
    Without a hit the former part is the whole.
    """
    located = locate_primers(sequences, [("query", query)], at_head=False, max_share=max_share, scores=scores)
    hit = F.col("hit").isNotNull()
    former_end = F.expr("hit.end + 1") if border == "end" else F.col("hit.start")
    latter_start = F.expr("hit.start + 1") if border == "start" else F.expr("hit.end + 2")
    former = F.when(hit, F.substring("seq", F.lit(1), former_end)).otherwise(F.col("seq"))
    return located.select("name", former.alias("former"), F.when(hit, F.substring("seq", latter_start, F.length("seq"))).alias("latter"), hit.alias("found"))


def divided(
    sequences: DataFrame,
    queries: list[str],
    max_share: float = 0.15,
    max_mismatches: int | None = None,
    border: str = "both",
    keep_missed: bool = True,
    filler: bool = False,
    scores: Scores = Scores(),
) -> DataFrame:
    """``name, former, former_qual, latter, latter_qual, found``: sequences (``name, seq, qual``) divided at the first of *queries* that fits.

    The query is cut out (``both``), or stays with the former (``end``) or the latter part (``start``);
    without a hit the former part is the whole and the latter is empty, or the sequence goes
    (*keep_missed* false).  With *filler* an empty part is one ``A`` of quality 20, the former part first;
    only one of two empty parts is filled.  A null or empty sequence has no hit.
    """
    if border not in ("both", "start", "end"):
        raise ValueError("border must be both, start or end")
    given = sequences.select("name", F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("qual", F.lit("")).alias("qual"))
    located = locate_primers(given, [("query", q) for q in queries], at_head=False, max_share=max_share, max_mismatches=max_mismatches, scores=scores)
    found = F.col("hit").isNotNull() & (F.col("hit.start") >= 0)
    cut = F.when(found, F.expr("hit.end + 1") if border == "end" else F.col("hit.start")).otherwise(F.length("seq"))
    resume = F.when(found, F.col("hit.start") if border == "start" else F.expr("hit.end + 1")).otherwise(F.length("seq"))
    placed = located.select("name", "seq", "qual", F.coalesce(found, F.lit(False)).alias("found"), cut.alias("cut"), resume.alias("resume"))
    part = {f"former{k}": F.substring(c, F.lit(1), F.col("cut")) for k, c in (("", "seq"), ("_qual", "qual"))}
    part |= {f"latter{k}": F.expr(f"substring({c}, resume + 1)") for k, c in (("", "seq"), ("_qual", "qual"))}
    out = placed.select("name", *[v.alias(k) for k, v in part.items()], "found")
    if filler:
        no_former = F.col("former") == ""
        no_latter = (F.col("latter") == "") & ~no_former
        for side, empty in (("former", no_former), ("latter", no_latter)):
            out = out.withColumn(f"__{side}", empty)
        for side in ("former", "latter"):
            for column, value in ((f"{side}_qual", "5"), (side, "A")):  # 5 is quality 20
                out = out.withColumn(column, F.when(F.col(f"__{side}"), value).otherwise(F.col(column)))
        out = out.drop("__former", "__latter")
    return out if keep_missed else out.filter("found")


def associate_files(files: DataFrame, tags: DataFrame) -> DataFrame:
    """``file, tagname``: per file the longest tag name that it contains, a tag taking its first file only.

    Tag lists and file lists are those of one run.
    """
    pairs = files.select("file").join(tags.select("tagname").distinct(), F.contains("file", F.col("tagname")))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.length("tagname").desc(), F.desc("tagname")))).filter("r = 1")
    return best.withColumn("f", F.row_number().over(Window.partitionBy("tagname").orderBy("file"))).filter("f = 1").select("file", "tagname")


def both_strands(sequences: DataFrame) -> DataFrame:
    """Sequences and their reverse complements."""
    return sequences.unionByName(sequences.withColumn("seq", reverse_complement(F.col("seq"))))
