"""Queries on members, files, lists, caches and outputs of tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cubeloom.functions import names
from cubeloom.operators import assignments, clusters, cube, decontam, demux, filters, hierarchy, neighbours, quantify, reads, stores
from cubeloom.plans import fixtures as fx
from cubeloom.plans.registry import query
from cubeloom.plans.stat_queries import _TYPES, _blanks, _cube_t, _tau_sql
from cubeloom.plans.tree_queries import _CLOSURE, _HITS, _hits, _recursive, _sources
from cubeloom.session import shared_dir, written

_MEMBERS = "members AS (SELECT source AS otuname, concat('d', CAST(doc_id AS VARCHAR)) AS readname FROM documents)"


def _members(spark, d):
    return fx.table(spark, d, "documents").select(F.col("source").alias("otuname"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("readname"))


def _items(spark, d):
    return _members(spark, d).select(F.col("otuname").alias("name")).distinct()


@query("items_by_members", f"WITH {_MEMBERS} SELECT otuname AS name FROM members GROUP BY 1 HAVING count(*) >= 33")
def items_by_members(spark, d):
    return reads.by_members(_items(spark, d), _members(spark, d), 33)


@query("cell_members", f"WITH {_MEMBERS} SELECT * FROM members WHERE otuname IN (SELECT otuname FROM members GROUP BY 1 HAVING count(*) >= 33)")
def cell_members(spark, d):
    return reads.cell_members(_members(spark, d), 33)


@query("member_sequences", f"WITH {_MEMBERS} SELECT otuname, readname, md5(otuname) AS seq FROM members")
def member_sequences(spark, d):
    return filters.with_sequences(_members(spark, d), _items(spark, d).withColumn("seq", F.md5(F.col("name").cast("binary"))))


@query("numbered_clusters", f"""WITH {_MEMBERS}, s AS (SELECT otuname AS centroid, count(*) AS size FROM members GROUP BY 1)
 SELECT centroid, concat('otu_', lpad(CAST(row_number() OVER (ORDER BY size DESC, centroid) AS VARCHAR), CAST(length(CAST(count(*) OVER () AS VARCHAR)) AS INTEGER), '0')) AS cluster, size FROM s""")
def numbered_clusters(spark, d):
    return clusters.numbered_clusters(_members(spark, d).select(F.col("otuname").alias("centroid")))


@query("without_chimeras", f"WITH {_MEMBERS} SELECT * FROM members WHERE NOT regexp_matches(otuname, '(1|3)$')")
def without_chimeras(spark, d):
    flagged = [_items(spark, d).filter(F.col("name").rlike(f"{digit}$")) for digit in (1, 3)]
    return clusters.without_chimeras(_members(spark, d), flagged)


_SHORT = f"{fx.cte('seq_d')}, s AS (SELECT name, substr(seq, 1, CAST(8 + doc_id % 20 AS BIGINT)) AS seq, doc_id FROM seq_d)"


def _short(spark, d):
    return fx.seq_d(spark, d).select("name", F.substring("seq", F.lit(1), (8 + F.col("doc_id") % 20).cast("int")).alias("seq"), "doc_id")


@query("length_window", f"{_SHORT} SELECT name, seq, 'inside' AS kind FROM s WHERE length(seq) BETWEEN 10 AND 20 UNION ALL SELECT name, seq, 'longer' FROM s WHERE length(seq) > 20")
def length_window(spark, d):
    inside, longer = reads.length_window(_short(spark, d), 10, 20)
    return inside.select("name", "seq", F.lit("inside").alias("kind")).unionByName(longer.select("name", "seq", F.lit("longer").alias("kind")))


@query("clamped_least_length", f"{_SHORT} SELECT CAST(least(greatest(min(length(seq)), 10), 100) AS BIGINT) AS min_length FROM s")
def clamped_least_length(spark, d):
    return reads.clamped_least_length(_short(spark, d), 10, 100).select(F.col("min_length").cast("long").alias("min_length"))


@query("quality_statistics", f"{fx.cte('seq_d')} SELECT CAST(q AS BIGINT) AS q, count(*) AS n FROM (SELECT unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS q FROM seq_d) GROUP BY 1")
def quality_statistics(spark, d):
    return reads.quality_statistics(fx.seq_d(spark, d)).select(F.col("q").cast("long").alias("q"), "n")


@query("both_strands", f"{_SHORT} SELECT name, seq FROM s UNION ALL SELECT name, reverse(translate(seq, 'ACGT', 'TGCA')) FROM s")
def both_strands(spark, d):
    return demux.both_strands(_short(spark, d).select("name", "seq"))


def _located(spark, d):
    hit = F.struct(F.lit(0).alias("start"), (F.col("doc_id") % 5).cast("int").alias("end"))
    return fx.seq_d(spark, d).withColumn("hit", F.when(F.col("doc_id") % 4 != 0, hit)).select("name", "seq", "qual", "hit")


@query("cut_primer", f"{fx.cte('seq_d')} SELECT name, substr(seq, CAST(doc_id % 5 + 2 AS BIGINT)) AS seq, substr(qual, CAST(doc_id % 5 + 2 AS BIGINT)) AS qual FROM seq_d WHERE doc_id % 4 != 0")
def cut_primer(spark, d):
    return demux.cut_primer(_located(spark, d))


@query("mask_primer", f"{fx.cte('seq_d')} SELECT name, concat(lower(substr(seq, 1, CAST(doc_id % 5 + 1 AS BIGINT))), substr(seq, CAST(doc_id % 5 + 2 AS BIGINT))) AS seq, qual FROM seq_d WHERE doc_id % 4 != 0")
def mask_primer(spark, d):
    return demux.cut_primer(_located(spark, d), mask=True)


@query(
    "quality_gates",
    """WITH r AS (SELECT doc_id, translate(md5(text), '0123456789abcdef', 'NCGTACGTACGTACGT') AS seq, translate(md5(concat(text, 'q')), '0123456789abcdef', '!#%()+-/13579;=?') AS qual FROM documents),
 c AS (SELECT *, coalesce(nullif(list_position(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33 < 2), true), 0) - 1, 32) AS n FROM r)
 SELECT doc_id, substr(seq, 1, CAST(n AS BIGINT)) AS seq, substr(qual, 1, CAST(n AS BIGINT)) AS qual FROM c WHERE n > 0 AND length(regexp_replace(substr(seq, 1, CAST(n AS BIGINT)), '[^N]', '', 'g')) <= 1
  AND list_sum(list_transform(string_split(substr(qual, 1, CAST(n AS BIGINT)), ''), lambda x: ascii(x) - 33)) / n >= 14""",
)
def quality_gates(spark, d):
    found = fx.table(spark, d, "documents").select(
        "doc_id",
        F.translate(F.md5(F.col("text").cast("binary")), "0123456789abcdef", "NCGTACGTACGTACGT").alias("seq"),
        F.translate(F.md5(F.concat("text", F.lit("q")).cast("binary")), "0123456789abcdef", "!#%()+-/13579;=?").alias("qual"),
    )
    return reads.by_quality(found, truncate_below=2, max_ns=1, min_mean=14).filter("qual != ''")


@query(
    "both_mates",
    """WITH kept AS (SELECT l_orderkey AS rec_no, l_linenumber AS strand FROM lineitem WHERE l_quantity > 8), a AS (SELECT l_orderkey AS rec_no, count(*) AS n FROM lineitem GROUP BY 1),
 k AS (SELECT rec_no, count(*) AS n FROM kept GROUP BY 1) SELECT kept.* FROM kept WHERE rec_no IN (SELECT rec_no FROM a JOIN k USING (rec_no, n))""",
)
def both_mates(spark, d):
    mates = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec_no"), F.col("l_linenumber").alias("strand"), "l_quantity")
    return reads.both_mates(mates, mates.filter("l_quantity > 8").drop("l_quantity"))


@query(
    "associate_files",
    """WITH f AS (SELECT concat('x', n_name, CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '' END, '-', CAST(s_suppkey AS VARCHAR), '.fastq') AS file FROM supplier JOIN nation ON n_nationkey = s_nationkey),
 t AS (SELECT n_name AS tagname FROM nation UNION SELECT concat(n_name, '1') FROM nation),
 b AS (SELECT file, tagname FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY length(tagname) DESC, tagname DESC) AS r FROM f JOIN t ON contains(file, tagname)) WHERE r = 1)
 SELECT file, tagname FROM (SELECT *, row_number() OVER (PARTITION BY tagname ORDER BY file) AS r FROM b) WHERE r = 1""",
)
def associate_files(spark, d):
    nation = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    even = F.when(F.col("s_suppkey") % 2 == 0, "1").otherwise("")
    files = fx.table(spark, d, "supplier").join(nation, "s_nationkey").select(F.concat(F.lit("x"), "n_name", even, F.lit("-"), F.col("s_suppkey").cast("string"), F.lit(".fastq")).alias("file"))
    tags = nation.select(F.col("n_name").alias("tagname")).unionByName(nation.select(F.concat("n_name", F.lit("1")).alias("tagname")))
    return demux.associate_files(files, tags)


@query("named_assignment", f"{fx.cte('nodes', 'acc_taxid')} SELECT acc AS query, CAST(30 AS BIGINT) AS rank_idx, concat(name, ' (', CAST(taxid AS VARCHAR), ')') AS taxon FROM acc_taxid JOIN nodes USING (taxid)")
def named_assignment(spark, d):
    assigned = fx.acc_taxid(spark, d).select(F.col("acc").alias("query"), F.lit(30).cast("long").alias("rank_idx"), "taxid")
    return assignments.named_assignment(assigned, fx.nodes(spark, d).select("taxid", "name"), "both")


@query(
    "matching_queries",
    f"{fx.cte('assign_p')} SELECT query FROM assign_p WHERE regexp_matches(coalesce(class, ''), '(?i)brass$|#1[0-3]$') OR regexp_matches(coalesce(genus, ''), '(?i)brass$|#1[0-3]$') OR regexp_matches(coalesce(species, ''), '(?i)brass$|#1[0-3]$')",
)
def matching_queries(spark, d):
    return assignments.matching_queries(fx.long_assignment(fx.assign_p(spark, d), ["class", "genus", "species"]), ["brass$", "#1[0-3]$"])


_SOURCE_SQL = "WITH s AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS query, lang, source, CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN concat('x', source) ELSE source END AS other FROM documents JOIN labels USING (doc_id))"


@query(
    "merge_assign_sources",
    f"{_SOURCE_SQL} SELECT query, CAST(8 AS BIGINT) AS rank_idx, concat(lang, ' (b)') AS taxon FROM s UNION ALL SELECT query, 23, concat(coalesce(other, source), CASE WHEN other IS NULL THEN ' (a)' ELSE ' (b)' END) FROM s",
)
def merge_assign_sources(spark, d):
    tables = [*_sources(spark, d)]
    merged = assignments.merge_assignments(tables, rule="0<1", queries=[t.select("query").distinct() for t in tables])
    return assignments.shown_sources(merged, ["a", "b"]).withColumn("rank_idx", F.col("rank_idx").cast("long"))


@query("merge_assign_lowest", f"{_SOURCE_SQL} SELECT query, CASE WHEN other IS NULL THEN 'a' ELSE 'b' END AS source FROM s")
def merge_assign_lowest(spark, d):
    return assignments.lowest_sources(assignments.merge_assignments([*_sources(spark, d)], rule="0<1"), ["a", "b"])


_HIT_TABLE = "h AS (SELECT l_orderkey AS query, l_partkey AS acc, CAST(l_linenumber AS BIGINT) AS score, l_quantity AS length, l_discount * 10 AS qcov, l_tax * 1000 AS pident FROM lineitem)"


@query("gated_hits", f"WITH {_HIT_TABLE} SELECT query, acc, score FROM h WHERE length >= 25 AND qcov >= 0.5 AND pident >= 30")
def gated_hits(spark, d):
    c = F.col
    hits = fx.table(spark, d, "lineitem").select(
        c("l_orderkey").alias("query"), c("l_partkey").alias("acc"), c("l_linenumber").cast("long").alias("score"), c("l_quantity").alias("length"), (c("l_discount") * 10).alias("qcov"), (c("l_tax") * 1000).alias("pident")
    )
    return neighbours.gated(hits, 25, 0.5, 30).select("query", "acc", "score")


@query(
    "cached_neighbours",
    """WITH q AS (SELECT doc_id AS query, md5(text) AS key FROM documents), c AS (SELECT DISTINCT md5(text) AS key, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE concat('A', CAST(length(text) % 10 AS VARCHAR)) END AS acc FROM documents WHERE length(text) % 2 = 0)
 SELECT query, acc, 'known' AS kind FROM q JOIN c USING (key) WHERE acc IS NOT NULL UNION ALL SELECT query, NULL, 'asked' FROM q WHERE key NOT IN (SELECT key FROM c)""",
)
def cached_neighbours(spark, d):
    docs = fx.table(spark, d, "documents")
    key, n = F.md5(F.col("text").cast("binary")).alias("key"), F.length("text")
    cache = docs.filter(n % 2 == 0).select(key, F.when(n % 3 != 0, F.concat(F.lit("A"), (n % 10).cast("string"))).alias("acc")).distinct()
    known, asked = neighbours.cached_first(docs.select(F.col("doc_id").alias("query"), key), cache)
    return known.select("query", "acc", F.lit("known").alias("kind")).unionByName(asked.select("query", F.lit(None).cast("string").alias("acc"), F.lit("asked").alias("kind")))


@query(
    "merged_caches",
    """WITH k AS (SELECT CAST(o_custkey AS VARCHAR) AS key, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS cache, list_sort(list(DISTINCT o_orderpriority)) AS accs FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2)
 SELECT key, unnest(accs) AS acc FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY len(accs), cache) AS r FROM k) WHERE r = 1""",
)
def merged_caches(spark, d):
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("acc"), "o_orderstatus")
    return neighbours.merged_caches([orders.filter(F.col("o_orderstatus") == s).select("key", "acc") for s in "OF"])


@query("bucketed_candidates", f"WITH {_HITS} SELECT query, acc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, acc) AS r FROM hits) WHERE r <= 7")
def bucketed_candidates(spark, d):
    path = f"{shared_dir(spark)}/candidates-{uuid.uuid4().hex}"
    neighbours.candidates_by_bucket(_hits(spark, d, 8), path, most=7, buckets=4)
    return spark.read.parquet(path).select("query", "acc", "score")


@query("cleaned_cube", f"WITH {_TYPES} SELECT samplename, otuname, nreads, nreads > 60 AS kept FROM cube_t")
def cleaned_cube(spark, d):
    cube = _cube_t(spark, d)
    judged = cube.select("samplename", "otuname", (F.col("nreads") > 60).alias("kept"))
    return decontam.cleaned(cube, judged).withColumn("kept", F.lit(True)).unionByName(decontam.removed(cube, judged).withColumn("kept", F.lit(False)))


@query("number_of_tests", f"WITH {_TYPES} SELECT DISTINCT otuname, count(*) OVER () AS tests FROM cube_t")
def number_of_tests(spark, d):
    return decontam.number_of_tests(_cube_t(spark, d), unit="all")


_CUT_MEMBERS = """c AS (SELECT concat('run1__u', CAST(user_id AS VARCHAR), '__ev') AS samplename, event_type AS otuname, count(*) // 2 AS nreads FROM events GROUP BY 1, 2),
 m AS (SELECT event_type AS otuname, concat('r', CAST(event_id AS VARCHAR)) AS readname, concat('run1__u', CAST(user_id AS VARCHAR), '__ev') AS samplename, event_id AS rec_no FROM events)"""


@query("truncated_members", f"WITH {_CUT_MEMBERS} SELECT otuname, readname, samplename, rec_no FROM (SELECT m.*, nreads, row_number() OVER (PARTITION BY otuname, samplename ORDER BY rec_no, readname) AS place FROM m JOIN c USING (samplename, otuname)) WHERE place <= nreads")
def truncated_members(spark, d):
    cube = fx.cube_e(spark, d).withColumn("nreads", F.expr("nreads div 2"))
    return decontam.truncated_members(_event_members(spark, d), cube)


def _event_members(spark, d):
    sample = F.concat(F.lit("run1__u"), F.col("user_id").cast("string"), F.lit("__ev"))
    return fx.table(spark, d, "events").select(F.col("event_type").alias("otuname"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("readname"), sample.alias("samplename"), F.col("event_id").alias("rec_no"))


@query("members_in", f"WITH {_CUT_MEMBERS} SELECT m.* FROM m JOIN c USING (samplename, otuname) WHERE nreads >= 6")
def members_in(spark, d):
    cube = fx.cube_e(spark, d).filter("nreads >= 12")
    return filters.members_in(_event_members(spark, d), cube)


@query("tag_halves", "SELECT DISTINCT concat('run1__f', CAST(l_suppkey AS VARCHAR), '+r', l_returnflag, '__p') AS samplename, concat('f', CAST(l_suppkey AS VARCHAR)) AS forward, concat('r', l_returnflag) AS reverse FROM lineitem")
def tag_halves(spark, d):
    sample = F.concat(F.lit("run1__f"), F.col("l_suppkey").cast("string"), F.lit("+r"), "l_returnflag", F.lit("__p"))
    return decontam.tag_halves(fx.table(spark, d, "lineitem").select(sample.alias("samplename")))


@query("clean_taxon", "SELECT p_partkey, translate(concat(p_type, ': ', p_name), ' :', '__') AS taxon, contains(lower(p_brand), '#1') AS hit FROM part")
def clean_taxon(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", names.clean_taxon(F.concat("p_type", F.lit(": "), "p_name")).alias("taxon"), names.any_literal(F.col("p_brand"), ["#1", "(.*"]).alias("hit"))


@query(
    "drop_unnamed_species",
    f"""{_recursive("nodes")}, {_CLOSURE}, given AS (SELECT taxid FROM nodes WHERE taxid % 2 = 0 AND (rank = 'species' OR taxid % 4 = 0)),
 unnamed AS (SELECT taxid FROM given JOIN nodes USING (taxid) WHERE rank = 'species' AND taxid % 3 = 0)
 SELECT taxid FROM given WHERE taxid NOT IN (SELECT taxid FROM unnamed WHERE taxid NOT IN (SELECT taxid FROM walk WHERE ancestor IN (SELECT taxid FROM given)))""",
)
def drop_unnamed_species(spark, d):
    nodes = fx.nodes(spark, d)
    given = nodes.filter("taxid % 2 = 0 and (rank = 'species' or taxid % 4 = 0)").select("taxid")
    named = nodes.select("taxid", F.concat("name", F.when(F.col("taxid") % 3 == 0, " sp. 1").otherwise("")).alias("name"))
    return hierarchy.drop_unnamed_species(given, nodes, named)


@query(
    "merged_within_taxon",
    f"""{_SHORT}, c AS (SELECT concat('d', CAST(doc_id - doc_id % 5 AS VARCHAR)) AS container, count(*) AS members FROM s GROUP BY 1)
 SELECT container, CAST(doc_id % 2 AS BIGINT) AS taxid, seq, members FROM c JOIN s ON name = container""",
)
def merged_within_taxon(spark, d):
    short = _short(spark, d)
    containers = short.select("name", F.concat(F.lit("d"), (F.col("doc_id") - F.col("doc_id") % 5).cast("string")).alias("container"))
    return clusters.merged_within_taxon(short.select("name", "seq", (F.col("doc_id") % 2).alias("taxid")), containers)


@query(
    "spike_in_variants",
    """WITH h AS (SELECT l_orderkey AS query, l_partkey AS target, CAST(l_quantity AS DOUBLE) / (l_quantity + l_linenumber + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END) AS identity FROM lineitem)
 SELECT query, target, round(identity, 9) AS identity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity DESC, target) AS r FROM h) WHERE r = 1""",
)
def spike_in_variants(spark, d):
    number = lambda c: F.col(c).cast("long").cast("string")
    cigar = F.concat(number("l_quantity"), F.lit("="), number("l_linenumber"), F.lit("X"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(number("l_linenumber"), F.lit("I"))).otherwise(""))
    hits = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), cigar.alias("cigar"))
    return clusters.spike_in_variants(hits).select("query", "target", F.round("identity", 9).alias("identity"))


def _layout_sql(mode: str, tag: int, reverse: int) -> str:
    """The four layouts of a mode, by ``doc_id % 4``, put together from one sequence: what comes out."""
    part = lambda c, a, n: f"substr({c}, {a}, {n})"
    rows = {  # index, read, mate
        "both": [("{p11_3}+{p14_4}", "{p1_10}", "{p18_15}"), ("{p11_3}+{p14_4}", "{p1_10}", None), ("{p1_3}+{p13_4}", "{p4_9}", "{p17_16}"), ("{p1_3}+{p29_4}", "{p4_25}", None)],
        "forward": [("{p11_3}", "{p1_10}", "{p18_15}"), ("{p11_3}", "{p1_10}", None), ("{p1_3}", "{p4_9}", "{p13_20}"), ("{p1_3}", "{p4_29}", None)],
        "reverse": [("{p11_4}", "{p1_10}", "{p18_15}"), ("{p11_4}", "{p1_10}", None), ("{p13_4}", "{p1_12}", "{p17_16}"), ("{p29_4}", "{p1_28}", None)],
    }[mode]

    def shown(text: str | None, c: str, plus: str) -> str:
        if text is None:
            return "NULL"
        marks = [x for x in text.replace("{", "").replace("}", "").split("+")]
        return "concat(" + f", '{plus}', ".join(part(c, *m[1:].split("_")) for m in marks) + ")"

    cases = lambda k, c, plus: "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {shown(row[k], c, plus)}" for i, row in enumerate(rows)) + " END"
    columns = {"index_seq": (0, "seq", "+"), "index_qual": (0, "qual", ""), "seq": (1, "seq", ""), "qual": (1, "qual", ""), "mate_seq": (2, "seq", ""), "mate_qual": (2, "qual", "")}
    return f"SELECT name, '{mode}' AS mode, " + ", ".join(f"{cases(*spec)} AS {name}" for name, spec in columns.items()) + " FROM seq_d"


_MODES = {"both": (3, 4), "forward": (3, 0), "reverse": (0, 4)}


@query("tag_layouts", f"{fx.cte('seq_d')} " + " UNION ALL ".join(_layout_sql(mode, *lengths) for mode, lengths in _MODES.items()))
def tag_layouts(spark, d):
    """One, two, three and four reads in step, with the tags of either direction or both."""
    out, kind = None, F.col("doc_id") % 4
    for mode, (tag, reverse) in _MODES.items():
        first = 3 if tag else 4

        def reads_of(c, mode=mode, first=first):
            at = lambda a, n: F.substring(c, a, n)
            third = at(14, 4) if mode == "both" else at(18, 15)
            return [
                F.when(kind < 2, at(1, 10)).when(kind == 2, at(1, 12)).otherwise(F.col(c)),
                F.when(kind < 2, at(11, first)).when(kind == 2, at(13, 20)),
                F.when((kind == 0) | (kind == 1) & F.lit(mode == "both"), third),
                F.when((kind == 0) & F.lit(mode == "both"), at(18, 15)),
            ]

        columns = [x.alias(f"{k}{i + 1}") for k in ("seq", "qual") for i, x in enumerate(reads_of(k))]
        found = demux.normalised(fx.seq_d(spark, d).select("name", F.lit(mode).alias("mode"), *columns), tag, reverse)
        out = found if out is None else out.unionByName(found)
    return out


_NAMED = "n AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('gb|A', CAST(s_suppkey AS VARCHAR)) WHEN 1 THEN concat('A', CAST(s_suppkey AS VARCHAR), ' a text') ELSE concat('A', CAST(s_suppkey AS VARCHAR)) END AS name, s_suppkey FROM supplier)"


def _named(spark, d):
    acc, kind = F.concat(F.lit("A"), F.col("s_suppkey").cast("string")), F.col("s_suppkey") % 3
    return fx.table(spark, d, "supplier").select(F.when(kind == 0, F.concat(F.lit("gb|"), acc)).when(kind == 1, F.concat(acc, F.lit(" a text"))).otherwise(acc).alias("name"), acc.alias("acc"), "s_suppkey")


@query("without_listed", f"WITH {_NAMED} SELECT name FROM n WHERE s_suppkey % 4 != 0")
def without_listed(spark, d):
    named = _named(spark, d)
    return filters.without_listed(named.select("name"), named.filter("s_suppkey % 4 = 0").select("acc"))


@query("around_ignored", f"WITH {_NAMED} SELECT CASE WHEN s_suppkey % 4 = 0 THEN name ELSE upper(name) END AS name FROM n")
def around_ignored(spark, d):
    named = _named(spark, d)
    return filters.around_ignored(named.select("name"), named.filter("s_suppkey % 4 = 0").select("name"), lambda rows: rows.withColumn("name", F.upper("name")))


@query(
    "numbered_shards",
    f"WITH {_NAMED}, a AS (SELECT 0 AS shard, name FROM n WHERE s_suppkey % 2 = 0 UNION ALL SELECT 1, name FROM n) SELECT CAST(shard AS BIGINT) AS shard, name, concat('temp_', CAST(row_number() OVER (ORDER BY shard, name) - 1 AS VARCHAR)) AS number FROM a",
)
def numbered_shards(spark, d):
    named = _named(spark, d)
    return filters.unnamed_numbered([named.filter("s_suppkey % 2 = 0"), named]).withColumn("shard", F.col("shard").cast("long"))


@query("rarefied_inputs", f"{fx.cte('cube_e')}, n AS (SELECT samplename, sum(nreads) AS nseq, 1 - count(CASE WHEN nreads = 1 THEN 1 END) / sum(nreads) AS coverage FROM cube_e GROUP BY 1) SELECT samplename, CAST(nseq AS BIGINT) AS nseq, round(coverage, 8) AS coverage FROM n")
def rarefied_inputs(spark, d):
    found = quantify.rarefied(fx.cube_e(spark, d), replicates=2)
    return found["input_reads"].join(found["input_coverage"], "samplename").withColumn("coverage", F.round("coverage", 8))


@query(
    "sequence_volumes",
    f"{_SHORT}, v AS (SELECT name, seq, sum(length(seq)) OVER (ORDER BY name, seq) AS upto FROM s WHERE length(seq) BETWEEN 10 AND 24 AND doc_id % 5 != 0) SELECT CAST((upto - length(seq)) // 500 AS BIGINT) AS volume, name, seq FROM v",
)
def sequence_volumes(spark, d):
    short = _short(spark, d)
    return stores.volumes(short.select("name", "seq"), 500, 10, 24, short.filter("doc_id % 5 = 0").select("name"))


@query("kmer_index", f"{fx.cte('seq_d')}, k AS (SELECT DISTINCT name, substr(seq, i, 8) AS kmer FROM (SELECT name, seq, unnest(generate_series(1, 25)) AS i FROM seq_d)) SELECT kmer, name FROM k")
def kmer_index(spark, d):
    return stores.kmer_index(fx.seq_d(spark, d).select("name", "seq"), 8, 4).select("kmer", "name")


@query("fetched_sequences", f"WITH {_NAMED} SELECT name, md5(name) AS seq FROM n WHERE s_suppkey % 4 = 0")
def fetched_sequences(spark, d):
    named = _named(spark, d)
    return stores.fetched(named.select("name", F.md5(F.col("name").cast("binary")).alias("seq")), named.filter("s_suppkey % 4 = 0").select("acc"), 10)


@query("accessions_with_taxa", f"WITH {_NAMED} SELECT concat('A', CAST(s_suppkey AS VARCHAR)) AS acc, s_suppkey AS taxid FROM n WHERE s_suppkey % 3 != 0")
def accessions_with_taxa(spark, d):
    named = _named(spark, d)
    return stores.accessions_with_taxa(named.select("name"), named.filter("s_suppkey % 3 != 0").select("acc", F.col("s_suppkey").alias("taxid")))


_REPRESENTATIVES = f"""{fx.cte("cube_l", "assign_p")}, t AS (SELECT otuname, max(nreads) AS most, sum(nreads) AS total FROM cube_l GROUP BY 1),
 c AS (SELECT genus AS taxon, otuname FROM (SELECT genus, otuname, row_number() OVER (PARTITION BY genus ORDER BY most DESC, total DESC, otuname) AS place FROM t JOIN assign_p ON query = otuname WHERE genus IS NOT NULL) WHERE place = 1)"""


@query("named_representatives", f"{_REPRESENTATIVES} SELECT taxon, otuname, concat(lpad(CAST(row_number() OVER (ORDER BY taxon) AS VARCHAR), CAST(length(CAST(count(*) OVER () AS VARCHAR)) AS INTEGER), '0'), '_', taxon) AS name FROM c")
def named_representatives(spark, d):
    chosen = filters.representatives(fx.cube_l(spark, d), fx.assign_p(spark, d).withColumnRenamed("genus", "taxon"))
    return filters.named_representatives(chosen)


@query("checked_totals", f"WITH {_MEMBERS} SELECT otuname AS name, count(*) AS size FROM members GROUP BY 1")
def checked_totals(spark, d):
    members = _members(spark, d)
    return filters.with_checked_totals(members.groupBy(F.col("otuname").alias("name")).agg(F.count("*").alias("size")), members)


@query("spike_in_union", f"{fx.cte('cube_e')} SELECT samplename, otuname, nreads * 2 AS nreads FROM cube_e WHERE otuname = 'view' UNION ALL SELECT * FROM cube_e WHERE otuname != 'view'")
def spike_in_union(spark, d):
    cells = fx.cube_e(spark, d)
    return cube.with_rows(cells, cells.filter("otuname = 'view'"))


@query("calibrated_tau_test", _tau_sql().replace("SELECT samplename, otuname, nreads, nreads - m", "SELECT samplename, otuname, nreads / 4 AS ncopies, nreads - m"))
def calibrated_tau_test(spark, d):
    quantities = written(_cube_t(spark, d), "cube").withColumn("ncopies", F.col("nreads") / 4)
    return decontam.calibrated_tau_test_to_all(quantities, _blanks(spark, d))


@query("rarefied_sizes", f"{fx.cte('cube_e')}, s AS (SELECT samplename, sum(nreads) AS n FROM cube_e GROUP BY 1) SELECT CAST(r AS BIGINT) AS replicate, samplename, CAST(least(n, 40) AS BIGINT) AS nreads FROM s CROSS JOIN generate_series(1, 3) g(r)")
def rarefied_sizes(spark, d):
    cells = fx.cube_e(spark, d)
    depths = cells.groupBy("samplename").agg(F.least(F.sum("nreads"), F.lit(40)).alias("depth"))
    drawn = quantify.rarefy(cells, depths, replicates=3, seed=5)
    return drawn.groupBy(F.col("replicate").cast("long").alias("replicate"), "samplename").agg(F.sum("nreads").alias("nreads"))


@query("test_levels", f"WITH {_TYPES} SELECT samplename, otuname, 0.05 / count(*) OVER (PARTITION BY otuname) AS alpha FROM cube_t WHERE nreads > 0")
def levels_of_tests(spark, d):
    return decontam.levels(_cube_t(spark, d))


@query("sequences_left", f"{fx.cte('cube_l')} SELECT concat('otu_', CAST(p_partkey AS VARCHAR)) AS name, md5(p_name) AS seq FROM part WHERE concat('otu_', CAST(p_partkey AS VARCHAR)) IN (SELECT otuname FROM cube_l WHERE nreads > 45)")
def sequences_left(spark, d):
    part = fx.table(spark, d, "part").select(F.concat(F.lit("otu_"), F.col("p_partkey").cast("string")).alias("name"), F.md5(F.col("p_name").cast("binary")).alias("seq"))
    return decontam.sequences_left(part, fx.cube_l(spark, d).filter("nreads > 45"))


@query("word_freq_log", f"WITH {_TYPES} SELECT samplename, otuname AS name, floor(ln(nreads * exp(20.0) / max(nreads) OVER (PARTITION BY samplename)) + 0.5) AS freq FROM cube_t QUALIFY freq > 0")
def word_freq_log(spark, d):
    return quantify.word_frequencies(_cube_t(spark, d), log_scale=True)
