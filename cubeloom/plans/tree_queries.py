"""Queries on hierarchies, assignments and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeloom.operators import assignments, hierarchy, intervals, lineages, neighbours
from cubeloom.plans import fixtures as fx
from cubeloom.plans.registry import query
from cubeloom.session import written

_CLOSURE = """walk AS (SELECT n.taxid, p.taxid AS ancestor, 1 AS depth, p.parent AS up FROM nodes n JOIN nodes p ON p.taxid = n.parent
 UNION ALL SELECT w.taxid, p.taxid, w.depth + 1, p.parent FROM walk w JOIN nodes p ON p.taxid = w.up)"""


def _recursive(*names: str) -> str:
    return fx.cte(*names).replace("WITH ", "WITH RECURSIVE ", 1)


@query("tree_ancestors", f"{_recursive('nodes')}, {_CLOSURE} SELECT taxid, ancestor, CAST(depth AS BIGINT) AS depth FROM walk")
def tree_ancestors(spark, d):
    return hierarchy.closure(fx.nodes(spark, d)).withColumn("depth", F.col("depth").cast("long"))


@query(
    "tree_descendants",
    f"{_recursive('nodes')}, {_CLOSURE} SELECT DISTINCT taxid FROM (SELECT taxid FROM walk WHERE ancestor IN (101, 1007) UNION ALL SELECT taxid FROM nodes WHERE taxid IN (101, 1007))",
)
def tree_descendants(spark, d):
    return hierarchy.descendants(fx.nodes(spark, d), spark.createDataFrame([(101,), (1007,)], "taxid long"))


_LINEAGE = f"""{_recursive("nodes", "acc_taxid")}, {_CLOSURE}, line AS (SELECT acc, a.taxid AS own, coalesce(x.anc, a.taxid) AS anc FROM acc_taxid a
 JOIN (SELECT taxid, ancestor AS anc FROM walk UNION ALL SELECT taxid, taxid FROM nodes) x ON x.taxid = a.taxid)"""


@query(
    "lineage_pivot",
    f"""{_LINEAGE} SELECT acc, max(CASE WHEN rank = 'phylum' THEN name END) AS phylum, max(CASE WHEN rank = 'class' THEN name END) AS class,
 max(CASE WHEN rank = 'species' THEN name END) AS species FROM line JOIN nodes ON nodes.taxid = anc GROUP BY acc""",
)
def lineage_pivot(spark, d):
    nodes = fx.nodes(spark, d)
    return hierarchy.lineage_columns(hierarchy.lineages(fx.acc_taxid(spark, d), nodes), nodes.select("taxid", "name"), ["phylum", "class", "species"])


@query(
    "rank_window",
    f"{_recursive('nodes')} SELECT taxid FROM nodes WHERE rank = 'class'",
)
def rank_window(spark, d):
    nodes = fx.nodes(spark, d)
    return hierarchy.rank_window(nodes.select("taxid"), nodes, max_rank="class", min_rank="class")


@query(
    "scoped_keys",
    f"""{_recursive("nodes", "acc_taxid")}, {_CLOSURE} SELECT acc, taxid FROM acc_taxid WHERE taxid IN (SELECT taxid FROM walk WHERE ancestor IN (SELECT taxid FROM nodes WHERE regexp_matches(name, '(?i)^a')))
 AND taxid NOT IN (SELECT taxid FROM walk WHERE ancestor IN (SELECT taxid FROM nodes WHERE rank = 'class' AND regexp_matches(name, '(?i)0$|5$|A$')))""",
)
def scoped_keys(spark, d):
    nodes = fx.nodes(spark, d)
    inside = hierarchy.scoped(nodes, nodes.select("taxid", "name"), include=["^a"], exclude=["class,0$", "class,5$", "class,A$"])
    return hierarchy.accessions_in(fx.acc_taxid(spark, d), inside)


@query(
    "rank_normalise",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'subspecies' WHEN p_size % 5 = 1 THEN 'varietas' WHEN p_size % 5 = 2 THEN 'superkingdom' WHEN p_size % 5 = 3 THEN 'no rank' ELSE 'genus' END AS rank FROM part""",
)
def rank_normalise(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["serogroup", "biotype", "domain", "clade", "genus"])), (F.col("p_size") % 5 + 1).cast("int"))
    return fx.table(spark, d, "part").select("p_partkey", hierarchy.normal_rank(raw).alias("rank"))


@query("name_resolution", "SELECT CAST(p_size AS BIGINT) AS taxid, min(p_name) AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def name_resolution(spark, d):
    kind = F.when(F.col("p_partkey") % 2 == 0, "scientific name").otherwise("synonym")
    return hierarchy.scientific_names(fx.table(spark, d, "part").select(F.col("p_size").cast("long").alias("taxid"), F.col("p_name").alias("name"), kind.alias("nameclass")))


@query(
    "lineage_synthesis",
    """WITH e AS (SELECT DISTINCT p_type, p_brand, p_size FROM part),
 paths AS (SELECT DISTINCT concat('class:', p_type) AS path, CAST(NULL AS VARCHAR) AS above, 'class' AS rank, p_type AS name FROM e
  UNION SELECT DISTINCT concat('class:', p_type, ';genus:', p_brand), concat('class:', p_type), 'genus', p_brand FROM e
  UNION SELECT DISTINCT concat('class:', p_type, ';genus:', p_brand, ';species:', CAST(p_size AS VARCHAR)), concat('class:', p_type, ';genus:', p_brand), 'species', CAST(p_size AS VARCHAR) FROM e),
 n AS (SELECT *, 1 + row_number() OVER (ORDER BY path) AS taxid FROM paths)
 SELECT n.taxid, coalesce(p.taxid, 1) AS parent, n.rank, n.name, n.path FROM n LEFT JOIN n p ON p.path = n.above""",
)
def lineage_synthesis(spark, d):
    line = F.concat(F.lit("class:"), F.col("p_type"), F.lit(";genus:"), F.col("p_brand"), F.lit(";species:"), F.col("p_size").cast("string"))
    return hierarchy.nodes_from_lineages(fx.table(spark, d, "part").select(line.alias("lineage")))


_HITS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 hits AS (SELECT a.vec_id AS query, b.vec_id AS acc, CAST(round(list_dot_product(a.v, b.v) * 1000) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id != b.vec_id)"""

def _vectors(spark, d):
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("acc"), F.col("embedding").alias("vector"))


def _hits(spark, d, best=None):
    vectors = _vectors(spark, d)
    asked = vectors.filter("acc % 20 = 0").select(F.col("acc").alias("query"), "vector")
    return neighbours.vector_hits(asked, vectors, 1000, best).filter("query != acc")


def _among(spark, d):
    """The nearest hits of each query, and those hits of nearest neighbours that decide: each being its own best, its best two scores, and all from the borderline on."""
    vectors = _vectors(spark, d)
    own = written(neighbours.nearest(_hits(spark, d, 2)), "nearest")  # the best score may be the query's own
    limits = own.select("acc", F.col("score").alias("below")).distinct()
    asked = limits.join(vectors, "acc").select(F.col("acc").alias("query"), "vector", "below")
    return own, neighbours.vector_hits(asked, vectors, 1000, 2)


@query("knn_ties", f"WITH {_HITS} SELECT query, acc, score FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r FROM hits) WHERE r <= 5")
def knn_ties(spark, d):
    return neighbours.k_nearest(_hits(spark, d, 6), 5)


@query(
    "nn_borderline",
    f"""WITH {_HITS} SELECT query, nn_score, max(CASE WHEN score < nn_score THEN score END) AS borderline_score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS nn_score FROM hits) GROUP BY 1, 2""",
)
def nn_borderline(spark, d):
    return neighbours.nearest_borderline(_hits(spark, d, 3))


_NEAR = """near AS (SELECT query, acc AS nn, score AS nn_score FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r FROM hits) WHERE r = 1),
 ref AS (SELECT a.vec_id AS nn, b.vec_id AS acc, CAST(round(list_dot_product(a.v, b.v) * 1000) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id IN (SELECT nn FROM near)),
 around AS (SELECT query, nn, nn_score, ref.acc, ref.score FROM near JOIN ref USING (nn)),
 border AS (SELECT query, nn, max(score) AS border FROM around WHERE score < nn_score GROUP BY 1, 2)"""


@query(
    "nearest_centric",
    f"""WITH {_HITS}, {_NEAR}, inside AS (SELECT DISTINCT query, acc FROM around LEFT JOIN border USING (query, nn) WHERE score >= coalesce(border, nn_score)),
 enough AS (SELECT query FROM inside GROUP BY 1 HAVING count(*) >= 2)
 SELECT query, acc FROM inside WHERE query IN (SELECT query FROM enough) UNION SELECT query, acc FROM (SELECT query, acc, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r
 FROM (SELECT query, acc, max(score) AS score FROM around WHERE query NOT IN (SELECT query FROM enough) GROUP BY 1, 2)) WHERE r <= 2""",
)
def nearest_centric(spark, d):
    return neighbours.nearest_centric(*_among(spark, d))


@query(
    "query_centric",
    f"""WITH {_HITS}, {_NEAR}, others AS (SELECT DISTINCT a.query, a.acc FROM around a JOIN border b USING (query, nn) WHERE a.score = b.border),
 lim AS (SELECT o.query, max(h.score) AS least FROM others o JOIN hits h ON h.query = o.query AND h.acc = o.acc GROUP BY 1),
 inside AS (SELECT h.query, h.acc FROM hits h JOIN lim USING (query) WHERE h.score >= least UNION SELECT query, acc FROM others),
 enough AS (SELECT query FROM inside GROUP BY 1 HAVING count(*) >= 2)
 SELECT query, acc FROM inside WHERE query IN (SELECT query FROM enough) UNION SELECT query, acc FROM (SELECT query, acc, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r
 FROM hits WHERE query NOT IN (SELECT query FROM enough)) WHERE r <= 2""",
)
def query_centric(spark, d):
    vectors = _vectors(spark, d)
    own, among = _among(spark, d)
    among = written(neighbours.best_per_accession(among), "among")
    border = neighbours.borderline(own, among).filter("query != acc")
    floors = neighbours.pair_scores(border, vectors, 1000).groupBy("query").agg(F.max("score").alias("floor"))
    asked = vectors.filter("acc % 20 = 0").select(F.col("acc").alias("query"), "vector").join(floors, "query", "left")
    return neighbours.query_centric(neighbours.vector_hits(asked, vectors, 1000, 3).filter("query != acc"), among)


#: Accessions of vectors: even ones at the class of their label, odd ones at its phylum.
_EMB_SQL = """emb_acc AS (SELECT vec_id AS acc, CASE WHEN vec_id % 2 = 0 THEN 1000 + label ELSE parent END AS taxid FROM embeddings JOIN nodes ON nodes.taxid = 1000 + label),
 anc AS (SELECT taxid, taxid AS anc, 0 AS depth FROM nodes UNION ALL SELECT taxid, ancestor, depth FROM walk),
 rk AS (SELECT taxid, CASE rank WHEN 'phylum' THEN 5 WHEN 'class' THEN 8 WHEN 'species' THEN 30 ELSE 0 END AS rank_idx FROM nodes),
 lin AS (SELECT acc, rank_idx, anc AS taxid FROM emb_acc JOIN anc USING (taxid) JOIN rk ON rk.taxid = anc),
 nb AS (SELECT query, acc FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r FROM hits) WHERE r <= 12),
 cast_ AS (SELECT query, j.rank_idx, acc, (SELECT l.taxid FROM lin l WHERE l.acc = nb.acc AND l.rank_idx >= j.rank_idx ORDER BY l.rank_idx LIMIT 1) AS taxid FROM nb CROSS JOIN (VALUES (5), (8)) j(rank_idx)),
 cnt AS (SELECT query, rank_idx, taxid, count(*) AS votes FROM cast_ WHERE taxid IS NOT NULL GROUP BY ALL),
 win AS (SELECT query, rank_idx, taxid, votes, sum(votes) OVER (PARTITION BY query, rank_idx) AS total, row_number() OVER (PARTITION BY query, rank_idx ORDER BY votes DESC, taxid) AS place FROM cnt),
 pend AS (SELECT c.query, c.rank_idx, count(*) AS n FROM cast_ c JOIN win w ON w.query = c.query AND w.rank_idx = c.rank_idx AND w.place = 1 JOIN lin l ON l.acc = c.acc AND l.rank_idx = 5 JOIN nodes p ON p.taxid = w.taxid
  WHERE c.taxid IS NULL AND c.rank_idx = 8 AND l.taxid != p.parent GROUP BY ALL),
 sizes AS (SELECT query, count(*) AS n FROM nb GROUP BY 1),
 voted AS (SELECT query, rank_idx, taxid, votes, CAST(total - votes + coalesce(pend.n, 0) AS BIGINT) AS opposers, CAST(sizes.n - total - coalesce(pend.n, 0) AS BIGINT) AS unidentified, sizes.n AS n
  FROM win LEFT JOIN pend USING (query, rank_idx) JOIN sizes USING (query) WHERE place = 1)"""
_VOTED = f"{_recursive('nodes')}, {_CLOSURE}, {_HITS}, {_EMB_SQL}"


def _voted(spark, d):
    nodes = fx.nodes(spark, d)
    label = F.col("label").cast("long") + 1000
    acc = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("acc"), label.alias("taxid")).join(nodes.select("taxid", "parent"), "taxid")
    acc = acc.select("acc", F.when(F.col("acc") % 2 == 0, F.col("taxid")).otherwise(F.col("parent")).alias("taxid"))
    near = neighbours.k_nearest(_hits(spark, d, 13), 12)
    tree = written(hierarchy.closure(nodes), "tree")
    return assignments.votes(near, hierarchy.lineages(acc, nodes, tree), nodes, tree=tree), nodes, tree


@query("consensus_votes", f"{_VOTED} SELECT query, CAST(rank_idx AS BIGINT) AS rank_idx, taxid, votes, opposers, unidentified, n FROM voted")
def consensus_votes(spark, d):
    return _voted(spark, d)[0].withColumn("rank_idx", F.col("rank_idx").cast("long"))


@query(
    "consensus_support",
    f"""{_VOTED} SELECT query, CAST(rank_idx AS BIGINT) AS rank_idx, concat(name, ': ', CAST(votes AS VARCHAR), ':', CAST(opposers AS VARCHAR), ':', CAST(unidentified AS VARCHAR), '/', CAST(n AS VARCHAR)) AS support FROM voted JOIN nodes USING (taxid)""",
)
def consensus_support(spark, d):
    voted, nodes, _ = _voted(spark, d)
    return assignments.support(voted, nodes.select("taxid", "name")).withColumn("rank_idx", F.col("rank_idx").cast("long"))


@query(
    "consensus_assign",
    f"""{_VOTED}, best AS (SELECT query, max(rank_idx) AS rank_idx FROM voted WHERE opposers / n <= 0.5 AND unidentified / n <= 0.6 AND votes >= 2 AND (opposers = 0 OR votes / opposers >= 1) GROUP BY 1),
 top AS (SELECT v.query, v.rank_idx, v.taxid FROM voted v JOIN best USING (query, rank_idx)),
 filled AS (SELECT query, rk.rank_idx, ancestor AS taxid FROM top JOIN walk ON walk.taxid = top.taxid JOIN rk ON rk.taxid = ancestor)
 SELECT query, CAST(rank_idx AS BIGINT) AS rank_idx, taxid FROM top WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.query = top.query AND f.rank_idx = top.rank_idx) UNION ALL SELECT query, rank_idx, taxid FROM filled""",
)
def consensus_assign(spark, d):
    voted, nodes, tree = _voted(spark, d)
    found = assignments.consensus(voted, nodes, max_opposer_share=0.5, max_unidentified_share=0.6, min_ratio=1.0, tree=tree)
    return found.withColumn("rank_idx", F.col("rank_idx").cast("long"))


def _sources(spark, d):
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    other = F.when(F.col("toxic") == 1, None).when(F.col("quality") == 0, F.concat(F.lit("x"), F.col("source"))).otherwise(F.col("source"))
    a = fx.long_assignment(docs.select(name.alias("query"), F.col("lang").alias("class"), F.col("source").alias("genus")), ["class", "genus"])
    b = fx.long_assignment(docs.select(name.alias("query"), F.col("lang").alias("class"), other.alias("genus")), ["class", "genus"])
    return a, b


_SOURCES = """WITH s AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS query, lang, source, CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN concat('x', source) ELSE source END AS other FROM documents JOIN labels USING (doc_id))"""


@query(
    "merge_assign_equal",
    f"""{_SOURCES} SELECT query, 8 AS rank_idx, lang AS taxon, 0 AS source FROM s UNION ALL SELECT query, 23, source, 0 FROM s WHERE other IS NULL OR other = source""",
)
def merge_assign_equal(spark, d):
    return assignments.merge_assignments([*_sources(spark, d)])


@query(
    "merge_assign_priority",
    f"""{_SOURCES} SELECT query, 8 AS rank_idx, lang AS taxon, 1 AS source FROM s UNION ALL SELECT query, 23, coalesce(other, source), CASE WHEN other IS NULL THEN 0 ELSE 1 END FROM s""",
)
def merge_assign_priority(spark, d):
    return assignments.merge_assignments([*_sources(spark, d)], rule="0<1")


@query(
    "fill_blanks",
    """SELECT concat('otu_', CAST(p_partkey AS VARCHAR)) AS query, coalesce(c, g, s) AS class, coalesce(g, s, concat('unidentified ', c)) AS genus, coalesce(s, concat('unidentified ', coalesce(g, c))) AS species
 FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END c0, nullif(c0, '') AS c, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS g, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS s FROM part)""",
)
def fill_blanks(spark, d):
    size = F.col("p_size")
    wide = fx.table(spark, d, "part").select(
        F.concat(F.lit("otu_"), F.col("p_partkey").cast("string")).alias("query"),
        F.when(size % 5 == 0, "").otherwise(F.col("p_type")).alias("class"),
        F.when(size % 7 != 0, F.col("p_brand")).alias("genus"),
        F.when(size % 3 != 0, F.col("p_name")).alias("species"),
    )
    return assignments.fill_blanks(wide, ["species", "class", "genus"])


@query(
    "full_fill",
    """SELECT query, kingdom, genus, species, isolate FROM (SELECT concat('otu_', CAST(p_partkey AS VARCHAR)) AS query, p_brand AS kingdom, p_brand AS genus, p_name AS species, concat('unidentified ', p_name) AS isolate FROM part)""",
)
def full_fill(spark, d):
    brand = fx.table(spark, d, "part").select(F.concat(F.lit("otu_"), F.col("p_partkey").cast("string")).alias("query"), F.col("p_brand").alias("genus"), F.col("p_name").alias("species"))
    return assignments.fill_blanks(brand, ["genus", "species"], full=True).select("query", "kingdom", "genus", "species", "isolate")


_WALK_OR_SELF = "(SELECT taxid, ancestor FROM walk UNION ALL SELECT taxid, taxid FROM nodes)"


@query("tree_numbers", f"{_recursive('nodes')}, {_CLOSURE}, s AS (SELECT ancestor AS taxid, count(*) AS size, min(taxid) AS least FROM {_WALK_OR_SELF} GROUP BY 1), d AS (SELECT taxid, count(*) - 1 AS depth FROM {_WALK_OR_SELF} GROUP BY 1) SELECT taxid, size, depth, size - 1 AS inner_numbers, true AS nested FROM s JOIN d USING (taxid)")
def tree_numbers(spark, d):
    """By node: nodes below and with it, its depth, how many numbers its range has after its own, and whether that lies in its parent's."""
    tree = intervals.numbered(fx.nodes(spark, d))
    parents = tree.select(F.col("taxid").alias("parent"), F.col("pre").alias("first"), F.col("last").alias("end"))
    nested = F.col("first").isNull() | (F.col("pre") > F.col("first")) & (F.col("last") <= F.col("end"))
    size = F.col("last") - F.col("pre") + 1
    return tree.join(parents, "parent", "left").select("taxid", size.alias("size"), F.col("depth").cast("long").alias("depth"), (size - 1).alias("inner_numbers"), nested.alias("nested"))


_MATCH = "SELECT taxid FROM nodes WHERE regexp_matches(name, '(?i){}')"


@query(
    "scope_by_words",
    f"""{_recursive("nodes")}, {_CLOSURE}, sub AS {_WALK_OR_SELF} SELECT taxid FROM nodes WHERE taxid IN (SELECT taxid FROM sub WHERE ancestor IN ({_MATCH.format('^a')}))
 AND regexp_matches(name, '(?i)[0-4]$|^a') AND NOT regexp_matches(name, '(?i)3$') AND taxid NOT IN (SELECT taxid FROM sub WHERE ancestor IN ({_MATCH.format('n[0-9]*$')} AND rank = 'class'))""",
)
def scope_by_words(spark, d):
    nodes = fx.nodes(spark, d)
    names = nodes.select("taxid", "name")
    return intervals.scope(nodes, names, intervals.numbered(nodes), include=["^a"], keywords=["[0-4]$", "^a"], ngwords=["3$"], exclude=["class,n[0-9]*$"])


@query(
    "scope_by_list",
    """WITH listed AS (SELECT concat('C', CAST(o_custkey AS VARCHAR)) AS acc FROM orders WHERE o_orderstatus = 'P')
 SELECT acc, c_custkey + 1000000 AS taxid FROM customer JOIN (SELECT DISTINCT acc FROM listed) ON acc = concat('C', CAST(c_custkey AS VARCHAR)) WHERE c_custkey % 10 != 7""",
)
def scope_by_list(spark, d):
    nodes, accs = fx.nodes(spark, d), fx.acc_taxid(spark, d)
    listed = fx.keys(spark, d, "P").select(F.concat(F.lit("C"), "acc").alias("acc"))
    inside = intervals.scope(nodes, nodes.select("taxid", "name"), intervals.numbered(nodes), ngwords=["species,7$"], listed=listed, acc_taxid=accs)
    return intervals.accessions_of(accs, inside, listed)


@query(
    "list_with_ancestors",
    f"""{_recursive("nodes")}, {_CLOSURE}, own AS (SELECT DISTINCT 1000000 + o_custkey AS taxid FROM orders WHERE o_orderstatus = 'P')
 SELECT taxid, parent, rank, name FROM nodes WHERE taxid IN (SELECT taxid FROM own) OR taxid IN (SELECT ancestor FROM walk WHERE taxid IN (SELECT taxid FROM own))""",
)
def list_with_ancestors(spark, d):
    nodes = fx.nodes(spark, d)
    listed = fx.keys(spark, d, "P").select(F.concat(F.lit("C"), "acc").alias("acc"))
    return intervals.database_of_list(nodes, nodes.select("taxid", "name"), fx.acc_taxid(spark, d), intervals.numbered(nodes), listed)["nodes"]


_PATHS = """e AS (SELECT DISTINCT p_partkey % 2 AS half, CASE WHEN p_size % 5 = 0 THEN 'taxid:77;' ELSE '' END AS a, p_type, p_brand, p_size FROM part),
 paths AS (SELECT half, concat(a, 'class:', p_type) AS path, NULL::VARCHAR AS above, a, 'class' AS rank, p_type AS name FROM e
  UNION ALL SELECT half, concat(a, 'class:', p_type, ';genus:', p_brand), concat(a, 'class:', p_type), a, 'genus', p_brand FROM e
  UNION ALL SELECT half, concat(a, 'class:', p_type, ';genus:', p_brand, ';species:', CAST(p_size AS VARCHAR)), concat(a, 'class:', p_type, ';genus:', p_brand), a, 'species', CAST(p_size AS VARCHAR) FROM e),
 one AS (SELECT path, above, a, rank, name, min(half) AS half FROM paths GROUP BY ALL),
 n AS (SELECT *, 1000 + row_number() OVER (ORDER BY half, path) AS taxid FROM one)"""


def _lines(spark, d):
    parts = F.concat_ws(";", F.when(F.col("p_size") % 5 == 0, F.lit("taxid:77")), F.concat(F.lit("class:"), "p_type"), F.concat(F.lit('genus="'), "p_brand", F.lit('"')), F.concat(F.lit("species:"), F.col("p_size").cast("string")))
    return fx.table(spark, d, "part").select("p_partkey", parts.alias("lineage"))


def _two_files(spark, d):
    """The even parts' lineages, then the odd ones' appended."""
    lines = _lines(spark, d)
    first = written(lineages.appended(lines.filter("p_partkey % 2 = 0"), floor=1000), "first")
    return lineages.appended(lines.filter("p_partkey % 2 = 1"), first)


@query("lineage_append", f"WITH {_PATHS} SELECT n.taxid, coalesce(p.taxid, CASE WHEN n.a != '' THEN 77 ELSE 1 END) AS parent, n.rank, n.name, n.path FROM n LEFT JOIN n p ON p.path = n.above")
def lineage_append(spark, d):
    return _two_files(spark, d)


@query(
    "accessions_made",
    f"""WITH {_PATHS} SELECT p_partkey, n.taxid, concat('AA', lpad(CAST(50 + row_number() OVER (ORDER BY p_partkey) AS VARCHAR), 8, '0')) AS acc FROM part
 JOIN n ON n.path = concat(CASE WHEN p_size % 5 = 0 THEN 'taxid:77;' ELSE '' END, 'class:', p_type, ';genus:', p_brand, ';species:', CAST(p_size AS VARCHAR))""",
)
def accessions_made(spark, d):
    return lineages.accessions(_lines(spark, d), _two_files(spark, d), ["p_partkey"], used=50).drop("lineage")
