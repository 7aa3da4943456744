"""URL filter: explicit host rules, then a path-template tree judged by smoothed labelled purity.

Everything is DataFrame work; no Python runs on the executors.

1. The urls are counted by ``(host, path)`` with their labels.
2. From the root of every host down, level by level, a segment stays literal
   if it has at least ``min_support`` pages and either ``min_share`` of the pages of
   its node or another share of bad labels than the rest of the node (a
   two-proportion test at ``z_split``); all others become the wildcard ``*``.
   The walk ends when no node of ``min_support`` pages has a segment left: below
   that every segment is a wildcard.
3. Sibling branches (leaves that share host and parent) are merged if they are
   alike: those whose share of bad labels doesn't differ from the rest of their
   parent's (the same test at ``z_merge``) are one branch, the others join the
   siblings in the same tenth of the share.  A branch pools its labels.
4. A template is rejected if its branch's smoothed share of bad labels, drawn towards
   the share of all labelled pages with the weight of ``prior_weight`` pages,
   is ``reject_share`` or more.

Explicit rules come first: a rule ``(verdict, host, path)`` fits its host and
all subdomains where the url's path starts with the rule's path; the longest
fitting rule (host and path together, then host) decides.

Scale: counts are pre-aggregated before each shuffle, rare segments are
dropped before the joins that find literals, nothing is broadcast by hint and
there is no window.  Urls that are done leave the walk; it has as many rounds as
there are segments above the deepest node of ``min_support`` pages.

Defined cases: a null url or one without ``://`` has an empty host and path
and belongs to the (empty) host's template; ids may be null (such pages are
unlabelled) or repeat (one row each); labels other than 0 and 1 are none; without labels nothing is rejected; an
empty table gives an empty table; further columns are not read.  In a template a literal
segment that begins with ``*`` or a backslash has a backslash before it, so it is no wildcard.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Scratch

#: (verdict, host, path): the rules of the registered query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path of an url; empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict (null: none fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def smoothed(bad: Column, labelled: Column, prior: float, weight: float) -> Column:
    """The share of bad labels, drawn towards *prior* with the weight of so many labels."""
    return (bad + weight * prior) / (labelled + weight)


def contrast(bad: Column, labelled: Column, all_bad: Column, all_labelled: Column, prior: float, weight: float) -> Column:
    """By how many standard errors a part's share of bad labels differs from that of the rest."""
    part, rest = smoothed(bad, labelled, prior, weight), smoothed(all_bad - bad, all_labelled - labelled, prior, weight)
    n, m = labelled + weight, all_labelled - labelled + weight
    pooled = (part * n + rest * m) / (n + m)
    return (part - rest) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n + 1 / m))


def prior_share(urls: DataFrame) -> float:
    """The share of bad ones among all labelled pages, 0 without labels."""
    bad, labelled = urls.agg(F.sum("bad"), F.sum("labelled")).first()
    return bad / labelled if labelled else 0.0


def path_templates(urls: DataFrame, prior: float, scratch: Scratch, min_share: float = 0.05, min_support: int = 20, z_split: float = 1.96, weight: float = 10.0) -> DataFrame:
    """*urls* (``host, path, n, bad, labelled``) with ``parent`` and ``template``, the node of each path and the one above it."""
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "labelled")]
    columns = [*urls.columns, "parent", "template"]
    start = urls.withColumn("segments", F.split("path", "/")).withColumn("parent", F.lit("")).withColumn("template", F.lit(""))
    open_, done, level = scratch.write(start, "url-tree"), [], 1
    while True:
        deeper = F.size("segments") > level
        done.append(open_.filter(~deeper).select(columns))
        open_ = open_.filter(deeper)
        nodes = open_.groupBy("host", "template").agg(*sums).filter(F.col("n") >= min_support)
        nodes = scratch.write(nodes.select("host", "template", *(F.col(c).alias(f"all_{c}") for c in ("n", "bad", "labelled"))), "url-nodes")
        small = open_.join(nodes, ["host", "template"], "left_anti") if not nodes.isEmpty() else open_
        left = F.size("segments") - level
        done.append(
            small.withColumn("parent", F.concat("template", F.repeat(F.lit("/*"), left - 1))).withColumn("template", F.concat("template", F.repeat(F.lit("/*"), left))).select(columns)
        )
        if small is open_:
            break
        segment = F.get("segments", F.lit(level))
        known = open_.join(nodes.select("host", "template"), ["host", "template"]).withColumn("segment", segment)
        apart = F.abs(contrast(F.col("bad"), F.col("labelled"), F.col("all_bad"), F.col("all_labelled"), prior, weight)) > z_split
        literal = (
            known.groupBy("host", "template", "segment")
            .agg(*sums)
            .filter(F.col("n") >= min_support)
            .join(nodes, ["host", "template"])
            .filter((F.col("n") >= min_share * F.col("all_n")) | apart)
            .select("host", "template", "segment", F.regexp_replace("segment", r"^([*\\])", r"\\$1").alias("literal"))
        )
        step = known.join(literal, ["host", "template", "segment"], "left").withColumn("parent", F.col("template"))
        step = step.withColumn("template", F.concat("parent", F.lit("/"), F.coalesce("literal", F.lit("*"))))
        open_ = scratch.write(step.select(*columns, "segments"), "url-tree")
        level += 1
    tree = done[0]
    for part in done[1:]:
        tree = tree.unionByName(part)
    return scratch.write(tree, "url-templates")


def judged_templates(tree: DataFrame, prior: float, z_merge: float = 1.96, weight: float = 10.0, reject_share: float = 0.5) -> DataFrame:
    """Per template its merged branch (null: like the rest of its parent), pooled labels, smoothed share of bad ones, and whether it is rejected."""
    leaves = tree.groupBy("host", "parent", "template").agg(F.sum("bad").alias("own_bad"), F.sum("labelled").alias("own_labelled"))
    family = leaves.groupBy("host", "parent").agg(F.sum("own_bad").alias("all_bad"), F.sum("own_labelled").alias("all_labelled"))
    own = [F.col(c) for c in ("own_bad", "own_labelled", "all_bad", "all_labelled")]
    tenth = F.floor(10 * smoothed(own[0], own[1], prior, weight))
    placed = leaves.join(family, ["host", "parent"]).withColumn("branch", F.when(F.abs(contrast(*own, prior, weight)) > z_merge, tenth))
    pooled = placed.groupBy("host", "parent", "branch").agg(F.sum("own_bad").alias("bad"), F.sum("own_labelled").alias("labelled"))
    share = smoothed(F.col("bad"), F.col("labelled"), prior, weight)
    pooled = pooled.withColumn("bad_share", share).withColumn("key", F.coalesce("branch", F.lit(-1))).drop("branch")
    joined = placed.withColumn("key", F.coalesce("branch", F.lit(-1))).join(pooled, ["host", "parent", "key"])
    return joined.select("host", "template", "parent", "branch", "bad", "labelled", "bad_share", (F.col("bad_share") >= reject_share).alias("rejected"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **tree_options) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    *labels* has ``doc_id`` (the page's id) and ``quality`` (0 is bad); repeated labels of an id count once each.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("labelled"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    urls = (
        parts.join(marks, "page_id", "left")
        .groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"), F.sum(F.coalesce("labelled", F.lit(0))).alias("labelled"))
    )
    scratch = Scratch(pages.sparkSession)
    urls = scratch.write(urls, "url-counts")
    prior = prior_share(urls)
    tree = path_templates(urls, prior, scratch, **tree_options)
    rejected = judged_templates(tree, prior).filter("rejected").select("host", "template")
    bad_urls = tree.select("host", "path", "template").join(rejected, ["host", "template"], "left_semi").select("host", "path", F.lit(True).alias("rejected"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.join(bad_urls, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("rejected"), F.lit("block")).otherwise("allow")).alias("verdict"),
    )
