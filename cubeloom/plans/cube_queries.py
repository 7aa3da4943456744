"""Queries on count cubes and key lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeloom.operators import cube, filters, keysets
from cubeloom.plans import fixtures as fx
from cubeloom.plans.registry import query
from cubeloom.session import written

_TOPN_BRANDS = f"""{fx.cte("cube_l", "assign_p")},
 named AS (SELECT samplename, coalesce(genus, otuname) AS item, nreads FROM cube_l LEFT JOIN assign_p ON query = otuname),
 best AS (SELECT item FROM (SELECT item, sum(nreads) AS total FROM named GROUP BY item) ORDER BY total DESC, item LIMIT 10)
 SELECT samplename, CASE WHEN item IN (SELECT item FROM best) THEN item ELSE 'others' END AS otuname, CAST(sum(nreads) AS BIGINT) AS nreads
 FROM named GROUP BY 1, 2"""


@query("topn_brands", _TOPN_BRANDS)
def topn_brands(spark, d):
    """Top 10 brands by quantity per supplier, the rest as ``others``: build, join, roll-up, top-N."""
    return cube.top_items(cube.roll_up(fx.cube_l(spark, d), fx.assign_p(spark, d).withColumnRenamed("genus", "taxon")), 10)


@query("cube_build", f"{fx.cte('cube_l')} SELECT * FROM cube_l")
def cube_build(spark, d):
    return fx.cube_l(spark, d)


@query(
    "cube_from_membership",
    f"""{fx.cte("reads_e")} SELECT regexp_extract(readname, ' SN:(\\S+)', 1) AS samplename, otuname, count(*) AS nreads FROM reads_e GROUP BY 1, 2""",
)
def cube_from_membership(spark, d):
    return cube.from_membership(fx.reads_e(spark, d))


@query("cube_rename_run", f"""{fx.cte("cube_e")} SELECT concat('run9', substr(samplename, 5)) AS samplename, otuname, nreads FROM cube_e""")
def cube_rename_run(spark, d):
    return cube.rename_run(fx.cube_e(spark, d), "run9")


@query(
    "cube_fold_replicates",
    f"""{fx.cte("cube_e", "repl")} SELECT concat('run1__', coalesce(parent, split_part(samplename, '__', 2)), '__ev') AS samplename, otuname,
 CAST(sum(nreads) AS BIGINT) AS nreads FROM cube_e LEFT JOIN repl ON child = split_part(samplename, '__', 2) GROUP BY 1, 2""",
)
def cube_fold_replicates(spark, d):
    return cube.fold_replicates(fx.cube_e(spark, d), fx.replicates(spark, d))


@query(
    "cube_dense",
    f"""{fx.cte("cube_e")} SELECT s.samplename, o.otuname, coalesce(c.nreads, 0) AS nreads FROM (SELECT DISTINCT samplename FROM cube_e) s
 CROSS JOIN (SELECT DISTINCT otuname FROM cube_e) o LEFT JOIN cube_e c ON c.samplename = s.samplename AND c.otuname = o.otuname""",
)
def cube_dense(spark, d):
    return cube.dense(fx.cube_e(spark, d))


@query(
    "cube_pivot",
    f"""{fx.cte("cube_e")} SELECT samplename, {", ".join(f"CAST(coalesce(sum(CASE WHEN otuname = '{e}' THEN nreads END), 0) AS BIGINT) AS n_{e}" for e in ("click", "purchase", "view"))}
 FROM cube_e GROUP BY samplename""",
)
def cube_pivot(spark, d):
    names = ["click", "purchase", "view"]
    return cube.to_matrix(fx.cube_e(spark, d), names).withColumnsRenamed({n: f"n_{n}" for n in names})


@query("cube_unpivot", f"{fx.cte('cube_e')} SELECT * FROM cube_e")
def cube_unpivot(spark, d):
    return cube.from_matrix(cube.to_matrix(fx.cube_e(spark, d)))


@query(
    "rollup_rank",
    f"""{fx.cte("cube_l", "assign_p")} SELECT samplename, coalesce(genus, otuname) AS otuname, CAST(sum(nreads) AS BIGINT) AS nreads
 FROM cube_l LEFT JOIN assign_p ON query = otuname GROUP BY 1, 2""",
)
def rollup_rank(spark, d):
    return cube.roll_up(fx.cube_l(spark, d), fx.assign_p(spark, d).withColumnRenamed("genus", "taxon"))


@query(
    "rollup_rank_keep_items",
    f"""{fx.cte("cube_l", "assign_p")} SELECT samplename, CASE WHEN genus IS NULL THEN otuname ELSE concat(otuname, ':', genus) END AS otuname, nreads
 FROM cube_l LEFT JOIN assign_p ON query = otuname""",
)
def rollup_rank_keep_items(spark, d):
    return cube.roll_up(fx.cube_l(spark, d), fx.assign_p(spark, d).withColumnRenamed("genus", "taxon"), fuse=False, shares=fx.shares(spark, d))


@query(
    "topn_others",
    f"""{fx.cte("cube_l")}, best AS (SELECT otuname FROM cube_l GROUP BY 1 ORDER BY sum(nreads) DESC, otuname LIMIT 25)
 SELECT samplename, CASE WHEN otuname IN (SELECT otuname FROM best) THEN otuname ELSE 'others' END AS otuname, CAST(sum(nreads) AS BIGINT) AS nreads
 FROM cube_l GROUP BY 1, 2""",
)
def topn_others(spark, d):
    return cube.top_items(fx.cube_l(spark, d), 25)


@query(
    "ranked_numbered",
    f"""{fx.cte("cube_l")}, placed AS (SELECT otuname, row_number() OVER (ORDER BY sum(nreads) DESC, otuname) AS place, count(*) OVER () AS n FROM cube_l GROUP BY otuname)
 SELECT samplename, concat(lpad(CAST(place AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), '0'), ':', otuname) AS otuname, nreads FROM cube_l JOIN placed USING (otuname)""",
)
def ranked_numbered(spark, d):
    return cube.numbered_items(fx.cube_l(spark, d))


@query(
    "sort_by_rank",
    f"""{fx.cte("cube_l", "assign_p")}, t AS (SELECT otuname, coalesce(genus, otuname) AS taxon, CAST(sum(nreads) AS BIGINT) AS total FROM cube_l LEFT JOIN assign_p ON query = otuname GROUP BY 1, 2)
 SELECT otuname, total, row_number() OVER (ORDER BY taxon, total DESC, otuname) AS place FROM t""",
)
def sort_by_rank(spark, d):
    return cube.ordered_items(fx.cube_l(spark, d), fx.assign_p(spark, d).withColumnRenamed("genus", "taxon"))


@query("within_sample_rank", f"{fx.cte('cube_l')} SELECT *, row_number() OVER (PARTITION BY samplename ORDER BY nreads DESC, otuname) AS place FROM cube_l")
def within_sample_rank(spark, d):
    return cube.sample_places(fx.cube_l(spark, d))


@query(
    "cell_shares",
    f"""{fx.cte("cube_l")} SELECT samplename, otuname, nreads, CAST(nreads * 1000000 // sum(nreads) OVER (PARTITION BY otuname) AS BIGINT) AS item_ppm,
 CAST(nreads * 1000000 // sum(nreads) OVER (PARTITION BY samplename) AS BIGINT) AS sample_ppm FROM cube_l""",
)
def cell_shares(spark, d):
    return cube.shares(fx.cube_l(spark, d)).select("samplename", "otuname", "nreads", F.expr("nreads * 1000000 div item_total").alias("item_ppm"), F.expr("nreads * 1000000 div sample_total").alias("sample_ppm"))


@query(
    "filter_samples_exact",
    f"{fx.cte('cube_l')} SELECT * FROM cube_l WHERE samplename IN (SELECT concat('run1__s', CAST(s_suppkey AS VARCHAR), '__R') FROM supplier WHERE s_acctbal > 0)",
)
def filter_samples_exact(spark, d):
    names = fx.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("run1__s"), F.col("s_suppkey").cast("string"), F.lit("__R")).alias("name"))
    return filters.by_list(fx.cube_l(spark, d), names, "samplename")


@query(
    "drop_samples_exact",
    f"{fx.cte('cube_l')} SELECT * FROM cube_l WHERE samplename NOT IN (SELECT concat('run1__s', CAST(s_suppkey AS VARCHAR), '__R') FROM supplier WHERE s_acctbal > 0)",
)
def drop_samples_exact(spark, d):
    names = fx.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("run1__s"), F.col("s_suppkey").cast("string"), F.lit("__R")).alias("name"))
    return filters.by_list(fx.cube_l(spark, d), names, "samplename", keep=False)


@query("filter_samples_regex", f"{fx.cte('cube_l')} SELECT * FROM cube_l WHERE regexp_matches(samplename, '(?i)S1.*__r$|s7__')")
def filter_samples_regex(spark, d):
    return filters.by_words(fx.cube_l(spark, d), ["S1.*__r$", "s7__"], "samplename")


@query("filter_items_exact", f"{fx.cte('cube_l')} SELECT * FROM cube_l WHERE otuname IN (SELECT concat('otu_', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 25)")
def filter_items_exact(spark, d):
    names = fx.table(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("otu_"), F.col("p_partkey").cast("string")).alias("name"))
    return filters.by_list(fx.cube_l(spark, d), names, "otuname")


@query("filter_items_regex", f"{fx.cte('cube_l')} SELECT * FROM cube_l WHERE NOT regexp_matches(otuname, '(?i)U_1|3$')")
def filter_items_regex(spark, d):
    return filters.by_words(fx.cube_l(spark, d), ["U_1", "3$"], "otuname", keep=False)


@query(
    "filter_items_zero_fill",
    f"""{fx.cte("cube_e")} SELECT samplename, x.otuname, coalesce(nreads, 0) AS nreads FROM (VALUES ('click'), ('absent'), ('view')) x(otuname) LEFT JOIN cube_e USING (otuname)""",
)
def filter_items_zero_fill(spark, d):
    return filters.keep_items_with_zeros(fx.cube_e(spark, d), spark.createDataFrame([("click",), ("absent",), ("view",)], "otuname string"))


def _taxa(spark, d):
    return fx.long_assignment(fx.assign_p(spark, d), ["class", "genus", "species"])


@query(
    "include_taxa",
    f"""{fx.cte("cube_l", "assign_p")} SELECT * FROM cube_l WHERE otuname IN (SELECT query FROM assign_p WHERE regexp_matches(class, '(?i)brass|#1[0-3]$') OR
 regexp_matches(genus, '(?i)brass|#1[0-3]$') OR regexp_matches(species, '(?i)brass|#1[0-3]$'))""",
)
def include_taxa(spark, d):
    return filters.by_taxa(fx.cube_l(spark, d), _taxa(spark, d), ["brass", "#1[0-3]$"])


@query(
    "exclude_taxa",
    f"""{fx.cte("cube_l", "assign_p")} SELECT * FROM cube_l WHERE otuname NOT IN (SELECT query FROM assign_p WHERE regexp_matches(coalesce(class, ''), '(?i)standard') OR
 regexp_matches(coalesce(genus, ''), '(?i)standard') OR regexp_matches(coalesce(species, ''), '(?i)standard'))""",
)
def exclude_taxa(spark, d):
    return filters.by_taxa(fx.cube_l(spark, d), _taxa(spark, d), ["standard"], include=False)


@query("rank_restricted_taxa", f"""{fx.cte("cube_l", "assign_p")} SELECT * FROM cube_l WHERE otuname IN (SELECT query FROM assign_p WHERE regexp_matches(genus, '(?i)2'))""")
def rank_restricted_taxa(spark, d):
    return filters.by_taxa(fx.cube_l(spark, d), _taxa(spark, d), ["genus,2"])


#: These take three rounds and more until nothing goes.
_LIMITS = dict(min_item=40, min_item_share=0.02, min_sample=40, min_sample_share=0.001, min_item_total=550, min_sample_total=3800)


def _support_sql(rounds: int) -> str:
    parts = ["c0 AS (SELECT * FROM cube_l WHERE nreads > 0)"]
    for i in range(rounds):
        parts.append(
            f"""s{i} AS (SELECT *, sum(nreads) OVER (PARTITION BY otuname) AS it, sum(nreads) OVER (PARTITION BY samplename) AS st FROM c{i}),
 c{i + 1} AS (SELECT samplename, otuname, nreads FROM s{i} WHERE otuname IN (SELECT otuname FROM s{i} WHERE nreads >= 40 AND nreads / it >= 0.02 AND it >= 550)
 AND samplename IN (SELECT samplename FROM s{i} WHERE nreads >= 40 AND nreads / st >= 0.001 AND st >= 3800))"""
        )
    return f"{fx.cte('cube_l')}, {', '.join(parts)} SELECT * FROM c{rounds}"


@query("support_filter_round", _support_sql(1))
def support_filter_round(spark, d):
    return filters.support_round(written(fx.cube_l(spark, d), "cube"), **_LIMITS)


@query("support_filter_fixpoint", _support_sql(12))
def support_filter_fixpoint(spark, d):
    return filters.support_filter(fx.cube_l(spark, d), **_LIMITS)


@query(
    "replicate_elimination",
    f"""{fx.cte("cube_e")}, rep AS (SELECT samplename AS child, concat('p', CAST(CAST(regexp_extract(samplename, 'u(\\d+)', 1) AS BIGINT) % 40 AS VARCHAR)) AS parent FROM (SELECT DISTINCT samplename FROM cube_e)),
 sizes AS (SELECT parent, count(DISTINCT child) AS n FROM rep GROUP BY 1),
 odd AS (SELECT otuname, sum(reads) AS odd_reads FROM (SELECT parent, otuname, count(DISTINCT child) AS found, sum(nreads) AS reads FROM cube_e JOIN rep ON child = samplename WHERE nreads >= 12 GROUP BY 1, 2)
   JOIN sizes USING (parent) WHERE found < 2 OR found / n < 1 GROUP BY 1)
 SELECT c.* FROM cube_e c WHERE nreads >= 12 AND otuname NOT IN (SELECT otuname FROM odd JOIN (SELECT otuname, sum(nreads) AS total FROM cube_e WHERE nreads >= 12 GROUP BY 1) USING (otuname) WHERE odd_reads >= 1 AND odd_reads / total >= 0.78)""",
)
def replicate_elimination(spark, d):
    cells = fx.cube_e(spark, d).filter("nreads >= 12")
    names = fx.cube_e(spark, d).select("samplename").distinct()
    reps = names.select(F.col("samplename").alias("child"), F.concat(F.lit("p"), (F.regexp_extract("samplename", r"u(\d+)", 1).cast("long") % 40).cast("string")).alias("parent"))
    return filters.replicate_elimination(cells, reps, min_positive_share=0.78)


@query(
    "representative_per_taxon",
    f"""{fx.cte("cube_l", "assign_p")}, t AS (SELECT otuname, max(nreads) AS most, sum(nreads) AS total FROM cube_l GROUP BY 1)
 SELECT genus AS taxon, otuname FROM (SELECT genus, otuname, row_number() OVER (PARTITION BY genus ORDER BY most DESC, total DESC, otuname) AS place
 FROM t JOIN assign_p ON query = otuname WHERE genus IS NOT NULL) WHERE place = 1""",
)
def representative_per_taxon(spark, d):
    return filters.representatives(fx.cube_l(spark, d), fx.assign_p(spark, d).withColumnRenamed("genus", "taxon"))


@query("keys_union", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS acc FROM orders WHERE o_orderstatus IN ('O', 'F')")
def keys_union(spark, d):
    return keysets.union_of([fx.keys(spark, d, "O"), fx.keys(spark, d, "F")])


@query(
    "keys_intersect",
    """SELECT CAST(o_custkey AS VARCHAR) AS acc FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'
 INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'""",
)
def keys_intersect(spark, d):
    return keysets.common_to([fx.keys(spark, d, s) for s in "OFP"])


@query("keys_bag_having", "SELECT CAST(o_custkey AS VARCHAR) AS acc FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1 HAVING count(*) >= 2")
def keys_bag_having(spark, d):
    return keysets.repeated([fx.keys(spark, d, "O"), fx.keys(spark, d, "F")], 2)


@query(
    "keys_except",
    """SELECT CAST(o_custkey AS VARCHAR) AS acc FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'""",
)
def keys_except(spark, d):
    return keysets.only_in_first(fx.keys(spark, d, "O"), [fx.keys(spark, d, "P")])
