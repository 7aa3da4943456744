"""Queries on calibration, coverage and decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeloom.functions.distributions import t_quantile
from cubeloom.operators import decontam, jumps, quantify
from cubeloom.plans import fixtures as fx
from cubeloom.plans.registry import query
from cubeloom.session import written

#: Cubes of suppliers over part types: few items, so that the same ones occur in every sample.
_TYPES = """cube_t AS (SELECT concat('run1__s', CAST(l_suppkey AS VARCHAR), '__ev') AS samplename, p_type AS otuname, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS nreads
 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def _cube_t(spark, d):
    joined = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    sample = F.concat(F.lit("run1__s"), F.col("l_suppkey").cast("string"), F.lit("__ev"))
    return joined.groupBy(sample.alias("samplename"), F.col("p_type").alias("otuname")).agg(F.sum(F.col("l_quantity").cast("long")).alias("nreads"))


def _spikes(spark, d):
    kinds = fx.table(spark, d, "part").groupBy("p_type").agg(F.avg("p_size").alias("conc"), F.min("p_type").alias("stdname")).orderBy("p_type").limit(3)
    return kinds.select(F.lit(None).cast("string").alias("samplename"), "stdname", F.round("conc", 0).alias("conc"))


_SPIKES = "spikes AS (SELECT p_type AS stdname, round(avg(p_size), 0) AS conc FROM part GROUP BY 1 ORDER BY 1 LIMIT 3)"
_FIT = f"""WITH {_TYPES}, {_SPIKES}, pts AS (SELECT s.samplename, stdname, conc, coalesce(nreads, 0) AS y FROM (SELECT DISTINCT samplename FROM cube_t) s CROSS JOIN spikes
 LEFT JOIN cube_t c ON c.samplename = s.samplename AND c.otuname = stdname),
 fit AS (SELECT samplename, sum(conc * y) / sum(conc * conc) AS slope, 1 - (sum(y * y) - sum(conc * y) * sum(conc * y) / sum(conc * conc)) / sum(y * y) AS r2, min(y) AS least FROM pts GROUP BY 1)"""


@query("spikein_fit", f"{_FIT} SELECT samplename, round(slope, 4) AS slope, round(r2, 4) AS r2, slope > 0 AND r2 >= 0.49 AND least > 0 AS accepted FROM fit")
def spikein_fit(spark, d):
    found = quantify.spike_in_fit(_cube_t(spark, d), _spikes(spark, d))
    return found.select("samplename", F.round("slope", 4).alias("slope"), F.round("r2", 4).alias("r2"), "accepted")


@query(
    "absolute_quant",
    f"""{_FIT}, vol AS (SELECT concat('run1__s', CAST(s_suppkey AS VARCHAR), '__ev') AS samplename, 1.0 + s_suppkey % 7 AS sol, 500.0 + s_suppkey % 3 AS wat FROM supplier WHERE s_suppkey % 10 > 0)
 SELECT c.samplename, otuname, round(coalesce(nreads / slope * sol / wat, 0), 5) AS ncopies FROM cube_t c
 LEFT JOIN (SELECT * FROM fit WHERE slope > 0 AND r2 >= 0.49 AND least > 0) USING (samplename) LEFT JOIN vol USING (samplename) WHERE otuname NOT IN (SELECT stdname FROM spikes)""",
)
def absolute_quant(spark, d):
    supplier = fx.table(spark, d, "supplier").filter("s_suppkey % 10 > 0").withColumn("samplename", F.concat(F.lit("run1__s"), F.col("s_suppkey").cast("string"), F.lit("__ev")))
    solution = supplier.select("samplename", (1.0 + F.col("s_suppkey") % 7).alias("volume"))
    water = supplier.select("samplename", F.lit(500.0).alias("volume")).unionByName(supplier.select("samplename", (F.col("s_suppkey") % 3).cast("double").alias("volume")))
    found = quantify.absolute_quantities(_cube_t(spark, d), _spikes(spark, d), solution, water)
    return found.select("samplename", "otuname", F.round("ncopies", 5).alias("ncopies"))


_COVER = """cover AS (SELECT samplename, CAST(sum(nreads) AS BIGINT) AS nseq, 1 - count(CASE WHEN nreads = 1 THEN 1 END) / sum(nreads) AS coverage FROM cube_l WHERE nreads > 0 GROUP BY 1)"""


@query("sample_coverage", f"{fx.cte('cube_l')}, {_COVER} SELECT samplename, nseq, round(coverage, 8) AS coverage FROM cover")
def sample_coverage(spark, d):
    return quantify.coverage(fx.cube_l(spark, d)).withColumn("coverage", F.round("coverage", 8))


@query(
    "coverage_gate",
    f"""{fx.cte("cube_l")}, {_COVER}, kept AS (SELECT * FROM cover WHERE coverage >= 0.998 AND nseq >= 1000) SELECT samplename, nseq, round(coverage, 8) AS coverage,
 round((SELECT greatest(min(coverage), 0.998) FROM kept), 8) AS target FROM kept""",
)
def coverage_gate(spark, d):
    found = quantify.coverage_gate(fx.cube_l(spark, d), min_coverage=0.998, min_reads=1000)
    return found.withColumn("coverage", F.round("coverage", 8)).withColumn("target", F.round("target", 8))


@query("rarefaction_depths")
def rarefaction_depths(spark, d):
    return quantify.rarefaction_depths(_cube_t(spark, d))


@query("rarefy_once")
def rarefy_once(spark, d):
    cube = fx.cube_e(spark, d)
    depths = cube.groupBy("samplename").agg(F.least(F.sum("nreads"), F.lit(40)).alias("depth"))
    return quantify.rarefy(cube, depths, replicates=1, seed=11)


@query(
    "split_draws",
    f"""{fx.cte("cube_l")}, s AS (SELECT samplename, sum(nreads) AS n FROM cube_l GROUP BY 1)
 SELECT CAST(r AS BIGINT) AS replicate, samplename, CAST(least(n, n // 3 + 1) AS BIGINT) AS nreads, 0::BIGINT AS n_above FROM s CROSS JOIN generate_series(1, 3) g(r)""",
)
def split_draws(spark, d):
    """A third of each sample's reads: sums by draw, and cells with more reads than they had."""
    cells = written(fx.cube_l(spark, d), "cube")
    depths = cells.groupBy("samplename").agg((F.floor(F.sum("nreads") / 3) + 1).alias("depth"))
    drawn = quantify.rarefy_cells(cells, depths, replicates=3, seed=5, block_cells=100).join(cells.withColumnRenamed("nreads", "given"), ["samplename", "otuname"])
    return drawn.groupBy(F.col("replicate").cast("long").alias("replicate"), "samplename").agg(F.sum("nreads").alias("nreads"), F.count_if(F.col("nreads") > F.col("given")).alias("n_above"))


@query(
    "word_freq_scaled",
    f"""WITH {_TYPES} SELECT samplename, otuname AS name, floor(nreads * 20 / max(nreads) OVER (PARTITION BY samplename) + 0.5) AS freq FROM cube_t QUALIFY freq > 0
 UNION ALL SELECT DISTINCT samplename, 'dummy', 0.00001 FROM cube_t""",
)
def word_freq_scaled(spark, d):
    return quantify.with_dummy_word(quantify.word_frequencies(_cube_t(spark, d)))


_BLANKS = """blanks AS (SELECT concat('run1__s', CAST(s_suppkey AS VARCHAR), '__ev') AS blank FROM supplier WHERE s_suppkey % 10 < 2),
 links AS (SELECT DISTINCT samplename, blank FROM cube_t CROSS JOIN blanks WHERE samplename NOT IN (SELECT blank FROM blanks))"""


def _blanks(spark, d):
    return fx.table(spark, d, "supplier").filter("s_suppkey % 10 < 2").select(F.concat(F.lit("run1__s"), F.col("s_suppkey").cast("string"), F.lit("__ev")).alias("samplename"))


@query(
    "contamination_rate",
    f"""WITH {_TYPES}, {_BLANKS}, tot AS (SELECT samplename, sum(nreads) AS reads FROM cube_t GROUP BY 1),
 src AS (SELECT blank, sum(reads) AS rs, count(*) AS n FROM links JOIN tot USING (samplename) GROUP BY 1)
 SELECT blank, round(least(o / (1 + o), 0.1), 8) AS rate FROM (SELECT blank, coalesce(reads, 0) * n / rs AS o FROM src LEFT JOIN tot ON tot.samplename = blank)""",
)
def contamination_rate(spark, d):
    return decontam.contamination_rates_to_all(_cube_t(spark, d), _blanks(spark, d)).withColumn("rate", F.round("rate", 8))


def _tau_sql() -> str:
    # A fifth of the suppliers are blanks, of 10, 100 or 1,000 by scale; an item is tested in the other samples at most.
    rows = ", ".join(f"({blanks + 1}, {tests}, CAST({t_quantile(1 - 0.05 / tests, blanks - 1)!r} AS DOUBLE))" for blanks in (2, 20, 200) for tests in range(1, 4 * blanks + 1))
    return f"""WITH {_TYPES}, {_BLANKS}, q(n, tests, t) AS (VALUES {rows}),
 cell AS (SELECT c.samplename, c.otuname, c.nreads, list_append(list(coalesce(b.nreads, 0)), c.nreads) AS v FROM cube_t c JOIN links USING (samplename)
  LEFT JOIN cube_t b ON b.samplename = blank AND b.otuname = c.otuname GROUP BY 1, 2, 3),
 st AS (SELECT samplename, otuname, nreads, len(v) AS n, list_avg(v) AS m, list_stddev_samp(v) AS sd, count(*) OVER (PARTITION BY otuname) AS tests FROM cell)
 SELECT samplename, otuname, nreads, nreads - m > t * (n - 1) / (sqrt(n) * sqrt(n - 2 + t * t)) * sd AS kept FROM st JOIN q USING (n, tests)"""


@query("tau_test", _tau_sql())
def tau_test(spark, d):
    return decontam.tau_test_to_all(written(_cube_t(spark, d), "cube"), _blanks(spark, d))


#: Rates at which a tag half jumps, forward and reverse.
_RATES = (0.001, 0.0015)
_BINOMIAL = f"""WITH {_TYPES}, cells AS (SELECT samplename, otuname, nreads, sum(nreads) OVER (PARTITION BY otuname) AS n, count(*) OVER (PARTITION BY otuname) AS tests FROM cube_t WHERE nreads > 0),
 chance AS (SELECT nreads, n, 1 - sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.01) + (n - k) * ln(0.99))) AS p FROM (SELECT nreads, n, unnest(generate_series(0, nreads)) AS k FROM (SELECT DISTINCT nreads, CAST(n AS BIGINT) AS n FROM cells)) GROUP BY 1, 2)
 SELECT samplename, otuname, nreads, p <= 0.05 / tests AS kept FROM cells JOIN chance USING (nreads, n)"""


@query("binomial_decontam", _BINOMIAL)
def binomial_decontam(spark, d):
    cube = _cube_t(spark, d)
    return decontam.binomial_test(cube, cube.select("samplename").distinct(), rate=0.01)


_HALVES = """halves AS (SELECT DISTINCT samplename, concat('f', CAST(CAST(regexp_extract(samplename, 's(\\d+)', 1) AS BIGINT) % 7 AS VARCHAR)) AS forward,
 concat('r', CAST(CAST(regexp_extract(samplename, 's(\\d+)', 1) AS BIGINT) // 7 AS VARCHAR)) AS reverse FROM cube_t),
 edges AS (SELECT a.samplename AS src, b.samplename AS dst, 'reversejump' AS jump FROM halves a JOIN halves b ON a.forward = b.forward AND a.reverse != b.reverse
  UNION ALL SELECT a.samplename, b.samplename, 'forwardjump' FROM halves a JOIN halves b ON a.reverse = b.reverse AND a.forward != b.forward)"""


def _tags(cube):
    number = F.regexp_extract("samplename", r"s(\d+)", 1).cast("long")
    return cube.select("samplename").distinct().select("samplename", F.concat(F.lit("f"), (number % 7).cast("string")).alias("forward"), F.concat(F.lit("r"), F.floor(number / 7).cast("string")).alias("reverse"))


@query("tag_neighbours", f"WITH {_TYPES}, {_HALVES} SELECT src, dst, jump FROM edges")
def tag_neighbours(spark, d):
    return decontam.tag_neighbours(written(_tags(_cube_t(spark, d)), "tags"))


@query(
    "tag_neighbour_sums",
    f"WITH {_TYPES}, {_HALVES} SELECT src AS samplename, otuname, jump, CAST(sum(nreads) AS BIGINT) AS nreads FROM edges JOIN cube_t ON samplename = dst GROUP BY 1, 2, 3",
)
def tag_neighbour_sums(spark, d):
    cube = written(_cube_t(spark, d), "cube")
    return decontam.tag_sums(cube, written(_tags(cube), "tags"))


_JUMP_RATES = f"""rd AS (SELECT samplename, sum(nreads) AS reads FROM cube_t GROUP BY 1), crossed AS (SELECT src, jump, sum(reads) AS across FROM edges JOIN rd ON samplename = dst GROUP BY 1, 2),
 own AS (SELECT e.src, e.jump, coalesce(reads, 0) + coalesce(across, 0) AS own FROM (SELECT DISTINCT src, jump FROM edges) e LEFT JOIN rd ON samplename = e.src LEFT JOIN crossed c ON c.src = e.src AND c.jump != e.jump),
 oth AS (SELECT e.src, e.jump, sum(o.own) AS others FROM edges e JOIN own o ON o.src = e.dst AND o.jump = e.jump GROUP BY 1, 2),
 rates AS (SELECT src AS samplename, jump, coalesce(CASE jump WHEN 'reversejump' THEN CAST({_RATES[1]} AS DOUBLE) ELSE CAST({_RATES[0]} AS DOUBLE) END * own / nullif(own + coalesce(others, 0), 0) * coalesce(others, 0) / nullif(own + coalesce(others, 0), 0), 0) AS rate FROM own LEFT JOIN oth USING (src, jump))"""


@query("jump_rates", f"WITH {_TYPES}, {_HALVES}, {_JUMP_RATES} SELECT samplename, jump, round(rate, 12) AS rate FROM rates")
def jump_rates(spark, d):
    cube = written(_cube_t(spark, d), "cube")
    return decontam.tag_rates(cube, written(_tags(cube), "tags"), *_RATES).withColumn("rate", F.round("rate", 12))


_JUMP_TEST = f"""WITH {_TYPES}, {_HALVES}, {_JUMP_RATES},
 sums AS (SELECT src AS samplename, otuname, jump, sum(nreads) AS nreads FROM edges JOIN cube_t ON samplename = dst GROUP BY 1, 2, 3),
 cells AS (SELECT c.samplename, c.otuname, c.nreads AS x, coalesce(r.nreads, 0) AS r, coalesce(f.nreads, 0) AS f, coalesce(pr.rate, 0) AS pr, coalesce(pf.rate, 0) AS pf, count(*) OVER (PARTITION BY c.otuname) AS tests,
  row_number() OVER (ORDER BY c.samplename, c.otuname) AS id
  FROM cube_t c LEFT JOIN sums r ON r.samplename = c.samplename AND r.otuname = c.otuname AND r.jump = 'reversejump' LEFT JOIN sums f ON f.samplename = c.samplename AND f.otuname = c.otuname AND f.jump = 'forwardjump'
  LEFT JOIN rates pr ON pr.samplename = c.samplename AND pr.jump = 'reversejump' LEFT JOIN rates pf ON pf.samplename = c.samplename AND pf.jump = 'forwardjump'
  WHERE c.nreads > 0 AND c.samplename IN (SELECT src FROM edges)),
 steps AS (SELECT *, unnest(generate_series(0, x)) AS j FROM cells),
 ways AS (SELECT id, x, j, CASE WHEN pr > 0 THEN exp(lgamma(r + j + 1) - lgamma(j + 1) - lgamma(r + 1) + j * ln(pr) + r * ln(1 - pr)) ELSE CAST(j = 0 AS DOUBLE) END AS a,
  sum(CASE WHEN pf > 0 THEN exp(lgamma(f + j + 1) - lgamma(j + 1) - lgamma(f + 1) + j * ln(pf) + f * ln(1 - pf)) ELSE CAST(j = 0 AS DOUBLE) END) OVER (PARTITION BY id ORDER BY j) AS b FROM steps),
 chance AS (SELECT u.id, 1 - sum(u.a * v.b) AS p FROM ways u JOIN ways v ON v.id = u.id AND v.j = u.x - u.j GROUP BY 1)
 SELECT samplename, otuname, x AS nreads, p <= 0.05 / tests AS kept FROM cells JOIN chance USING (id)"""


@query("tag_jump_test", _JUMP_TEST)
def tag_jump_test(spark, d):
    cube = written(_cube_t(spark, d), "cube")
    tags = written(_tags(cube), "tags")
    return decontam.tag_test(cube, tags, written(decontam.tag_rates(cube, tags, *_RATES), "rates"))


_BLANK_CELLS = """blank AS (SELECT DISTINCT samplename FROM cube_t WHERE CAST(regexp_extract(samplename, 's(\\d+)', 1) AS BIGINT) % 10 < 2),
 every AS (SELECT src AS samplename, otuname, CASE WHEN jump = 'reversejump' THEN nreads ELSE 0 END AS r, CASE WHEN jump = 'forwardjump' THEN nreads ELSE 0 END AS f, 0 AS n FROM edges JOIN cube_t ON samplename = dst
  UNION ALL SELECT samplename, otuname, 0, 0, nreads FROM cube_t),
 cell AS (SELECT samplename, otuname, sum(r) AS r, sum(f) AS f, sum(n) AS n FROM every WHERE samplename IN (SELECT samplename FROM blank) GROUP BY 1, 2)"""


@query(
    "jump_equations",
    f"""WITH {_TYPES}, {_HALVES}, {_BLANK_CELLS} SELECT samplename, CAST(sum(r * r) AS BIGINT) AS rr, CAST(sum(r * f) AS BIGINT) AS rf, CAST(sum(f * f) AS BIGINT) AS ff,
 CAST(sum(r * n) AS BIGINT) AS rn, CAST(sum(f * n) AS BIGINT) AS fn, CAST(sum(n * n) AS BIGINT) AS nn FROM cell GROUP BY 1""",
)
def jump_equations(spark, d):
    cube = written(_cube_t(spark, d), "cube")
    halves = written(_tags(cube), "tags")
    return jumps.equations(cube, halves, halves.filter(F.regexp_extract("samplename", r"s(\d+)", 1).cast("long") % 10 < 2))
