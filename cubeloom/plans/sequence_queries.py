"""Queries on sequences and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeloom.functions import sequences as sq
from cubeloom.operators import chimeras, clusters, demux, reads, search
from cubeloom.operators import denoise as error_model
from cubeloom.plans import fixtures as fx
from cubeloom.plans.registry import query
from cubeloom.session import written

_Q = "list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)"
_READS = f"{fx.cte('seq_d')}, r AS (SELECT *, {_Q} AS q FROM seq_d)"


def _numbers():
    return sq.qualities(F.col("qual"))


@query("qual_decode", f"{_READS} SELECT doc_id, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_min(q) AS BIGINT) AS least, CAST(list_max(q) AS BIGINT) AS most FROM r")
def qual_decode(spark, d):
    total = F.aggregate(_numbers(), F.lit(0).cast("long"), lambda s, q: s + q)
    return fx.seq_d(spark, d).select("doc_id", total.alias("total"), F.array_min(_numbers()).cast("long").alias("least"), F.array_max(_numbers()).cast("long").alias("most"))


@query("expected_error", f"{_READS} SELECT doc_id, round(list_sum(list_transform(q, lambda x: pow(10.0, -x / 10.0))), 6) AS errors FROM r")
def expected_error(spark, d):
    return fx.seq_d(spark, d).select("doc_id", F.round(sq.expected_errors(_numbers()), 6).alias("errors"))


@query("mean_quality", f"{_READS} SELECT doc_id FROM r WHERE list_sum(q) / len(q) >= 15")
def mean_quality(spark, d):
    return reads.by_quality(fx.seq_d(spark, d), min_mean=15).select("doc_id")


@query("low_quality_fraction", f"{_READS} SELECT doc_id FROM r WHERE len(list_filter(q, lambda x: x < 8)) / len(q) <= 0.25")
def low_quality_fraction(spark, d):
    return reads.by_quality(fx.seq_d(spark, d), low=8, max_low_share=0.25).select("doc_id")


@query(
    "mask_low",
    f"{_READS} SELECT doc_id, array_to_string(list_transform(generate_series(1, 32), lambda i: CASE WHEN q[i] < 10 THEN '?' ELSE substr(seq, CAST(i AS BIGINT), 1) END), '') AS seq FROM r",
)
def mask_low(spark, d):
    return fx.seq_d(spark, d).select("doc_id", sq.mask_low(F.col("seq"), _numbers(), 10).alias("seq"))


@query("length_gate", f"{_READS} SELECT doc_id, substr(seq, 1, 20) AS seq, substr(qual, 1, 20) AS qual FROM r")
def length_gate(spark, d):
    return reads.by_length(fx.seq_d(spark, d), 10, 20, truncate=True).select("doc_id", "seq", "qual")


@query("quality_cap", f"{_READS} SELECT doc_id, array_to_string(list_transform(q, lambda x: chr(CAST(least(x, 20) + 33 AS INTEGER))), '') AS qual FROM r")
def quality_cap(spark, d):
    return reads.by_quality(fx.seq_d(spark, d), max_quality=20).select("doc_id", "qual")


@query(
    "tail_trim",
    f"""{_READS.replace("WITH ", "WITH RECURSIVE ", 1)}, cut AS (SELECT doc_id, q, len(q) AS n, true AS going FROM r
  UNION ALL SELECT doc_id, q, coalesce(list_min(list_filter(generate_series(greatest(n - 4, 1), n), i -> q[i] < 12)) - 1, n), len(list_filter(generate_series(greatest(n - 4, 1), n), i -> q[i] < 12)) > 0 FROM cut WHERE going AND n > 0),
 least AS (SELECT doc_id, min(n) AS n FROM cut GROUP BY 1)
 SELECT doc_id, substr(seq, 1, CAST(n AS BIGINT)) AS seq, substr(qual, 1, CAST(n AS BIGINT)) AS qual FROM r JOIN least USING (doc_id)""".replace("i -> q[i]", "lambda i: q[i]"),
)
def tail_trim(spark, d):
    return reads.trim_tail(fx.seq_d(spark, d), 12, 5).select("doc_id", "seq", "qual")


@query("name_filter", f"{_READS} SELECT doc_id FROM r WHERE regexp_matches(name, '1') AND regexp_matches(name, '^d2') AND NOT regexp_matches(name, '5$|7$')")
def name_filter(spark, d):
    return reads.by_name(fx.seq_d(spark, d), ["1", "^D2"], ["5$", "7$"]).select("doc_id")


@query("dereplicate", f"{fx.cte('seq_d')} SELECT seq, count(*) AS size, min(name) AS representative FROM seq_d GROUP BY seq")
def dereplicate(spark, d):
    return reads.dereplicate(fx.seq_d(spark, d))


@query("dereplicated_names", f"{fx.cte('seq_d')} SELECT seq, string_agg(name, chr(1) ORDER BY name) AS names FROM seq_d GROUP BY seq")
def dereplicated_names(spark, d):
    return reads.dereplicated_names(fx.seq_d(spark, d))


@query(
    "longest_per_key",
    f"""{fx.cte("seq_d")} SELECT acc, seq FROM (SELECT doc_id % 50 AS acc, substr(seq, 1, CAST(8 + doc_id % 20 AS BIGINT)) AS seq, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY length(substr(seq, 1, CAST(8 + doc_id % 20 AS BIGINT))) DESC, substr(seq, 1, CAST(8 + doc_id % 20 AS BIGINT)) DESC) AS r FROM seq_d) WHERE r = 1""",
)
def longest_per_key(spark, d):
    hits = fx.seq_d(spark, d).select((F.col("doc_id") % 50).alias("acc"), F.substring("seq", F.lit(1), (8 + F.col("doc_id") % 20).cast("int")).alias("seq"))
    return reads.longest_per_key(hits)


@query(
    "position_statistics",
    f"""{_READS}, l AS (SELECT name, unnest(q) AS q, generate_subscripts(q, 1) - 1 AS pos FROM r), c AS (SELECT pos, q, sum(pow(10.0, -q / 10.0)) OVER (PARTITION BY name ORDER BY pos) AS e FROM l)
 SELECT CAST(pos AS BIGINT) AS pos, count(*) AS n, round(avg(q), 6) AS mean_quality, round(avg(e), 6) AS mean_errors FROM c GROUP BY pos""",
)
def position_statistics(spark, d):
    found = reads.position_statistics(fx.seq_d(spark, d))
    return found.select(F.col("pos").cast("long").alias("pos"), "n", F.round("mean_quality", 6).alias("mean_quality"), F.round("mean_errors", 6).alias("mean_errors"))


@query(
    "error_table",
    f"""{_READS} SELECT CAST(len AS BIGINT) AS length, lim AS "limit", count(CASE WHEN list_sum(list_transform(q[1:len], lambda x: pow(10.0, -x / 10.0))) <= lim THEN 1 END) AS n
 FROM r CROSS JOIN (VALUES (10), (20), (30)) a(len) CROSS JOIN (VALUES (CAST(1.0 AS DOUBLE)), (2.0), (4.0)) b(lim) GROUP BY 1, 2""",
)
def error_table(spark, d):
    return reads.error_table(fx.seq_d(spark, d), [10, 20, 30], [1.0, 2.0, 4.0]).withColumn("length", F.col("length").cast("long"))


@query("revcomp", f"{fx.cte('seq_d')} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM seq_d")
def revcomp(spark, d):
    return fx.seq_d(spark, d).select("doc_id", sq.reverse_complement(F.col("seq")).alias("seq"))


@query("padded_pairs", f"{fx.cte('seq_d')} SELECT name, concat(seq, 'ACGT', reverse(translate(seq, 'ACGT', 'TGCA'))) AS seq, concat(qual, '~~~~', reverse(qual)) AS qual FROM seq_d")
def padded_pairs(spark, d):
    pairs = fx.seq_d(spark, d).withColumn("mate_seq", F.col("seq")).withColumn("mate_qual", F.col("qual"))
    return reads.padded_pairs(pairs, "ACGT")


@query(
    "degenerate_expand",
    f"""{fx.cte("seq_d")} SELECT doc_id, concat(substr(seq, 1, 2), a.b, substr(seq, 3, 1), c.b) AS primer FROM seq_d CROSS JOIN (VALUES ('A'), ('G')) a(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) c(b)""",
)
def degenerate_expand(spark, d):
    primer = F.concat(F.substring("seq", 1, 2), F.lit("R"), F.substring("seq", 3, 1), F.lit("N"))
    return fx.seq_d(spark, d).select("doc_id", F.explode(sq.expanded(primer)).alias("primer"))


@query(
    "iupac_match",
    f"""{fx.cte("seq_d")} SELECT doc_id, substr(seq, 1, 1) IN ('A', 'G') AS purine, substr(seq, 2, 1) IN ('C', 'T') AS pyrimidine, true AS anything, false AS gap FROM seq_d""",
)
def iupac_match(spark, d):
    first, second = F.substring("seq", 1, 1), F.substring("seq", 2, 1)
    return fx.seq_d(spark, d).select(
        "doc_id", sq.compatible(first, F.lit("R")).alias("purine"), sq.compatible(F.lit("Y"), second).alias("pyrimidine"), sq.compatible(first, F.lit("N")).alias("anything"), sq.compatible(first, F.lit("-")).alias("gap")
    )


@query("base62_round_trip", f"{fx.cte('seq_d')} SELECT doc_id, seq FROM seq_d")
def base62_round_trip(spark, d):
    return fx.seq_d(spark, d).select("doc_id", sq.from_base62(sq.base62("seq")).alias("seq"))


@query("primer_locate")
def primer_locate(spark, d):
    found = demux.locate_primers(fx.seq_d(spark, d).select("doc_id", "seq"), [("p1", "ACGNT"), ("p2", "GGRC"), ("p3", "TTAC")])
    return found.select("doc_id", "hit.primer", "hit.start", "hit.end", "hit.mismatches", F.round("hit.share", 6).alias("share"))


@query("divide_sequence")
def divide_sequence(spark, d):
    return demux.divide_at(fx.seq_d(spark, d).select("name", "seq", "qual"), "ACGTA", max_share=0.2)


@query(
    "demultiplex",
    f"""{fx.cte("seq_d")}, heads AS (SELECT DISTINCT substr(seq, 1, 3) AS tag FROM seq_d), tags AS (SELECT tag, concat('t', tag) AS tagname FROM heads WHERE ascii(substr(tag, 1, 1)) IN (65, 71))
 SELECT doc_id, concat('run1__', CASE WHEN tagname IS NULL OR ascii(substr(qual, 1, 1)) - 33 < 6 OR ascii(substr(qual, 2, 1)) - 33 < 6 OR ascii(substr(qual, 3, 1)) - 33 < 6 THEN 'undetermined' ELSE tagname END, '__p') AS samplename
 FROM seq_d LEFT JOIN tags ON tag = substr(seq, 1, 3)""",
)
def demultiplex(spark, d):
    some = fx.seq_d(spark, d).select("doc_id", F.substring("seq", 1, 3).alias("index_seq"), F.substring("qual", 1, 3).alias("index_qual"))
    heads = some.select(F.col("index_seq").alias("seq")).distinct().filter("substr(seq, 1, 1) in ('A', 'G')").select(F.lit(1).alias("rec_no"), F.concat(F.lit("t"), "seq").alias("name"), "seq")
    return demux.assign_tags(some, demux.tag_table(heads), "run1", "p", least_quality=6, jumped=False).select("doc_id", "samplename")


def _with_errors(spark, d):
    """The distinct sequences with their numbers, each also with one letter changed (a quarter as often)."""
    true = reads.dereplicate(fx.seq_d(spark, d)).select(F.col("representative").alias("name"), "seq", "size")
    at = (1 + F.crc32(F.col("seq").cast("binary")) % F.length("seq")).cast("int")
    letter = F.translate(F.substring("seq", at, F.lit(1)), "ACGT", "CGTA")
    wrong = F.concat(F.substring("seq", F.lit(1), at - 1), letter, F.substring("seq", at + 1, F.length("seq")))
    changed = true.select(F.concat(F.lit("v"), "name").alias("name"), wrong.alias("seq"), "size")
    both = true.withColumn("size", F.col("size") * 4).unionByName(changed)
    return written(both.groupBy("seq").agg(F.min("name").alias("name"), F.sum("size").alias("size")), "reads")


def _hamming_links(distinct):
    """Links between different sequences of one length that differ in one place, by masking each place.

    A masked sequence is named by 128 bits; no more sequences share it than there are letters.
    """
    places = F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("i")
    masked = distinct.select("name", "seq", places).select("name", F.concat(F.expr("substr(seq, 1, i - 1)"), F.lit("."), F.expr("substr(seq, i + 1)")).alias("key"))
    groups = masked.groupBy(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")).agg(F.collect_list("name").alias("names")).filter(F.size("names") > 1)
    pairs = groups.select(F.explode("names").alias("query"), "names").select("query", F.explode("names").alias("target"))
    return pairs.filter("query != target")


@query("centroid_cluster")
def centroid_cluster(spark, d):
    distinct = _with_errors(spark, d)
    return clusters.greedy_centroids(distinct, _hamming_links(distinct))


@query("denoise")
def denoise(spark, d):
    distinct = _with_errors(spark, d)
    cubed = distinct.withColumn("size", F.col("size") * F.col("size") * F.col("size"))
    return clusters.denoised(cubed, _hamming_links(distinct).withColumn("distance", F.lit(1)), alpha=0.5)


@query(
    "containment_cluster",
    f"""{fx.cte("seq_d")}, s AS (SELECT name, substr(seq, CAST(1 + doc_id % 3 AS BIGINT), CAST(6 + doc_id % 14 AS BIGINT)) AS seq, doc_id % 2 AS taxid FROM seq_d)
 SELECT name, container FROM (SELECT a.name, b.name AS container, row_number() OVER (PARTITION BY a.name ORDER BY length(b.seq) DESC, b.name) AS r FROM s a JOIN s b ON a.taxid = b.taxid AND contains(b.seq, a.seq)) WHERE r = 1""",
)
def containment_cluster(spark, d):
    doc = F.col("doc_id")
    some = fx.seq_d(spark, d).select("name", F.substring("seq", (1 + doc % 3).cast("int"), (6 + doc % 14).cast("int")).alias("seq"), (doc % 2).alias("taxid"))
    return clusters.containment_clusters(some, k=6)


@query("remap_reads")
def remap_reads(spark, d):
    seqs = fx.seq_d(spark, d)
    # The first name of equal targets wins a tie, and equal reads have one answer: each sequence is searched once.
    targets = written(reads.dereplicate(seqs.select("name", "seq")).select(F.col("representative").alias("name"), "seq"), "targets")
    changed = seqs.filter("doc_id % 20 = 0").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.substring("seq", 1, 15), F.lit("A"), F.expr("substr(seq, 17)")).alias("seq"))
    asked = written(reads.dereplicate(changed).select(F.col("representative").alias("name"), "seq"), "asked")
    best = clusters.best_shared_kmer_match(asked, targets, k=8, min_shared=4, min_identity=0.95)
    found = best.join(asked.select(F.col("name").alias("query"), "seq"), "query").select("seq", "target", "identity")
    return changed.join(found, "seq").select(F.col("name").alias("query"), "target", "identity")


@query("chimera_flag")
def chimera_flag(spark, d):
    seqs = fx.seq_d(spark, d).select("name", "seq", (F.lit(100) + F.col("doc_id") % 7).alias("size"))
    other = seqs.select(F.expr("concat('d', cast(substr(name, 2) as bigint) + 1)").alias("name"), F.col("seq").alias("tail"))
    made = seqs.join(other, "name").select(F.concat(F.lit("x"), "name").alias("name"), F.concat(F.substring("seq", 1, 16), F.expr("substr(tail, 17)")).alias("seq"), F.lit(10).cast("long").alias("size"))
    return clusters.two_parent_chimeras(seqs.unionByName(made))


@query("denoise_error_model", f"{fx.cte('true_l')} SELECT DISTINCT seq AS denoised FROM true_l")
def denoise_error_model(spark, d):
    return error_model.variants(error_model.denoised_reads(fx.reads_l(spark, d), rounds=2)).select("denoised")


def _joined_pairs(spark, d):
    """Sequences of documents (large), and joins of every document's first and the next one's last letters with three changes (small)."""
    seqs = fx.seq_l(spark, d).select("name", "seq")
    other = seqs.select(F.expr("concat('d', cast(substr(name, 2) as bigint) - 1)").alias("name"), F.col("seq").alias("tail"))
    at = (44 + F.crc32(F.col("name").cast("binary")) % 40).cast("int")
    joined = seqs.join(other, "name").filter("seq != tail")
    made = joined.select(F.concat(F.lit("x"), "name").alias("name"), F.concat(F.substring("seq", F.lit(1), at), F.substring("tail", at + 1, F.lit(128))).alias("seq"))
    for place in (12, 70, 110):
        made = made.withColumn("seq", F.concat(F.substring("seq", 1, place - 1), F.translate(F.substring("seq", place, 1), "ACGT", "CGTA"), F.substring("seq", place + 1, 128)))
    return seqs.withColumn("size", F.lit(100).cast("long")).unionByName(made.withColumn("size", F.lit(10).cast("long")))


@query("chimera_scored", f"{fx.cte('seq_l')} SELECT concat('x', a.name) AS name FROM seq_l a JOIN seq_l b ON b.doc_id = a.doc_id + 1 WHERE a.seq != b.seq")
def chimera_scored(spark, d):
    return chimeras.denovo(_joined_pairs(spark, d)).select("name")


@query(
    "search_indexed",
    f"""{fx.cte("seq_l")}, first AS (SELECT seq, min(name) AS target FROM seq_l GROUP BY 1)
 SELECT concat('r', CAST(doc_id AS VARCHAR)) AS query, target, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
 CAST(CASE WHEN substr(seq, 31, 1) = 'A' THEN 101 ELSE 100 END AS BIGINT) AS matches, CAST(101 AS BIGINT) AS columns, CAST(4 AS BIGINT) AS target_start, CAST(105 AS BIGINT) AS target_end FROM seq_l JOIN first USING (seq)""",
)
def search_indexed(spark, d):
    seqs = fx.seq_l(spark, d)
    # The letters 5 to 105 with an A at 31; odd documents on the other strand.
    part = F.concat(F.substring("seq", 5, 26), F.lit("A"), F.substring("seq", 32, 74))
    read = F.when(F.col("doc_id") % 2 == 0, part).otherwise(sq.reverse_complement(part))
    reads_ = seqs.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("name"), read.alias("seq"))
    found = search.best_in(reads_, seqs.select("name", "seq"), 0.95, 12)
    return found.select("query", "target", "strand", "matches", "columns", "target_start", "target_end")


@query("remapped_unmatched", f"{fx.cte('seq_l')} SELECT concat('u', CAST(doc_id AS VARCHAR)) AS name FROM seq_l")
def remapped_unmatched(spark, d):
    seqs = fx.seq_l(spark, d)
    targets = seqs.filter("doc_id % 2 = 0").select("name", "seq")
    # Letters in another order match nothing; they are reported as unmatched.
    reads_ = seqs.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("name"), F.translate(F.concat(F.substring("seq", 65, 64), F.substring("seq", 1, 64)), "ACGT", "CGTA").alias("seq"))
    reads_ = written(reads_, "reads")
    window = search.window_for(reads_, 0.95, 12)
    index = search.store(targets, 12, search.buckets_for(targets, 12, window), window=window)
    return search.remapped(reads_, index, 0.95).filter("target is null").select("name")


@query(
    "clustered_strands",
    f"""{fx.cte("seq_l")}, u AS (SELECT seq, min(name) AS name, count(*) AS size FROM seq_l GROUP BY 1)
 SELECT name, name AS centroid, '+' AS strand FROM u UNION ALL SELECT concat('v', name), name, '-' FROM u""",
)
def clustered_strands(spark, d):
    true = reads.dereplicate(fx.seq_l(spark, d).select("name", "seq")).select(F.col("representative").alias("name"), "seq", F.col("size") * 3)
    true = true.toDF("name", "seq", "size")
    wrong = F.concat(F.substring("seq", 1, 59), F.translate(F.substring("seq", 60, 1), "ACGT", "CGTA"), F.substring("seq", 61, 128))
    other = true.select(F.concat(F.lit("v"), "name").alias("name"), sq.reverse_complement(wrong).alias("seq"), F.lit(1).cast("long").alias("size"))
    return search.clustered(written(true.unionByName(other), "sequences"), 0.97, k=12)


@query(
    "divided_with_filler",
    f"""{fx.cte("seq_d")}, p AS (SELECT name, seq, qual, CASE WHEN contains(seq, 'TACG') THEN length(seq) - strpos(reverse(seq), 'GCAT') - 3 END AS cut FROM seq_d WHERE seq IS NOT NULL),
 parts AS (SELECT name, cut IS NOT NULL AS found, substr(seq, 1, coalesce(cut, length(seq))) AS former, substr(qual, 1, coalesce(cut, length(seq))) AS former_qual,
  CASE WHEN cut IS NULL THEN '' ELSE substr(seq, cut + 1) END AS latter, CASE WHEN cut IS NULL THEN '' ELSE substr(qual, cut + 1) END AS latter_qual FROM p)
 SELECT name, found, CASE WHEN former = '' THEN 'A' ELSE former END AS former, CASE WHEN former = '' THEN '5' ELSE former_qual END AS former_qual,
 CASE WHEN latter = '' THEN 'A' ELSE latter END AS latter, CASE WHEN latter = '' THEN '5' ELSE latter_qual END AS latter_qual FROM parts""",
)
def divided_with_filler(spark, d):
    """Exact hits: the last place of the word, which stays with the latter part."""
    return demux.divided(fx.seq_d(spark, d).filter("seq is not null"), ["TACG"], max_mismatches=0, border="start", filler=True)
