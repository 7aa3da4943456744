"""Hand-made tables for the operators' rules."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cubeloom.functions import alignment, distributions
from cubeloom.functions import sequences as sq
from cubeloom.operators import assignments, clusters, cube, decontam, demux, filters, hierarchy, neighbours, quantify, reads
from tests.conftest import rows_of


def test_membership_without_three_parts_is_an_error(spark):
    members = spark.createDataFrame([("o1", "r1 SN:a__b")], "otuname string, readname string")
    with pytest.raises(PySparkException):
        cube.from_membership(members).collect()


def test_fold_prefers_the_full_name_over_the_tag(spark):
    cells = spark.createDataFrame([("r__t1__p", "o", 1), ("r__t2__p", "o", 2), ("x__t2__p", "o", 4)], "samplename string, otuname string, nreads long")
    reps = spark.createDataFrame([("t2", "t1"), ("x__t2__p", "all")], "child string, parent string")
    assert rows_of(cube.fold_replicates(cells, reps)) == [(3, "o", "r__t1__p"), (4, "o", "all")]


def test_top_items_without_others(spark):
    cells = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], "samplename string, otuname string, nreads long")
    assert rows_of(cube.top_items(cells, 2)) == rows_of(cells)
    assert rows_of(cube.top_items(cells, 1)) == [(1, "a", "s"), (1, "others", "s")]


def test_dense_and_matrix_round_trip(spark):
    cells = spark.createDataFrame([("s1", "a", 3), ("s2", "b c.d", 5)], "samplename string, otuname string, nreads long")
    assert cube.dense(cells).count() == 4
    assert rows_of(cube.from_matrix(cube.to_matrix(cells))) == rows_of(cells)


def test_support_filter_is_idempotent(spark):
    random.seed(1)
    cells = spark.createDataFrame([(f"s{i}", f"o{j}", random.randint(1, 9)) for i in range(8) for j in range(8) if random.random() < 0.6], "samplename string, otuname string, nreads long")
    limits = dict(min_item=5, min_sample=6, min_item_total=12, min_sample_total=10)
    once = filters.support_filter(cells, **limits)
    assert rows_of(filters.support_filter(once, **limits)) == rows_of(once)


def _fold(tables, level, prefer_lower=False):
    """Merging as a plain state machine, cell by cell."""
    result = {}
    for i in sorted(range(len(tables)), key=lambda i: (-level[i], i)):
        table = tables[i]
        if prefer_lower and table and result and max(table) > max(result):
            result = {}
        for rank in sorted(table):
            have = result.get(rank)
            if have is None:
                if rank > max(result, default=-1):
                    result[rank] = (table[rank], level[i])
            elif have[0] != table[rank]:
                if have[1] == level[i]:
                    result = {r: v for r, v in result.items() if r < rank}
                break
    return {r: v[0] for r, v in result.items()}


@pytest.mark.parametrize(("rule", "lower"), [("equal", False), ("descend", False), ("0=1<2", False), ("ascend", True)])
def test_merge_follows_the_state_machine(spark, rule, lower):
    random.seed(hash((rule, lower)) % 1000)
    queries = {f"q{k}": [{r: random.choice("AB") + str(r) for r in random.sample([1, 5, 8, 19, 23], random.randint(0, 5))} for _ in range(3)] for k in range(40)}
    tables = [spark.createDataFrame([(q, r, t) for q, x in queries.items() for r, t in x[i].items()], "query string, rank_idx int, taxon string") for i in range(3)]
    level = assignments.priorities(rule, 3)
    expected = sorted((q, r, t) for q, x in queries.items() for r, t in _fold(x, level, lower).items())
    found = assignments.merge_assignments(tables, rule, lower)
    assert sorted((x.query, x.rank_idx, x.taxon) for x in found.collect()) == expected


def test_priority_rules():
    assert assignments.priorities("2>0=1", 3) == [0, 0, 1]
    assert assignments.priorities("descend", 3) == [2, 1, 0]
    with pytest.raises(ValueError):
        assignments.priorities("0>1<2", 3)


def _consensus(near, lineage, parent, rank):
    """Votes of one query by walking ranks and ancestors."""
    out = {}
    ranks = sorted({r for a in near for r in lineage.get(a, {})})
    for j in ranks:
        counts, pending = {}, []
        for a in near:
            deeper = [r for r in sorted(lineage.get(a, {})) if r >= j]
            if deeper:
                t = lineage[a][deeper[0]]
                counts[t] = counts.get(t, 0) + 1
            else:
                pending.append(a)
        winner = min(counts, key=lambda t: (-counts[t], t))
        opposers = sum(counts.values()) - counts[winner]
        up = parent.get(winner)
        while up in rank and rank[up] == 0:
            up = parent.get(up)
        if up in rank:
            for a in pending:
                above = [r for r in sorted(lineage.get(a, {}), reverse=True) if r < j]
                if above:
                    at = up
                    while above[0] < rank[at] and parent.get(at) in rank:
                        at = parent[at]
                    opposers += rank[at] > 0 and lineage[a][above[0]] != at
        out[j] = (winner, counts[winner], opposers, len(near) - counts[winner] - opposers)
    return out


def test_votes_follow_the_walk(spark):
    random.seed(4)
    names = {2: "superkingdom", 3: "phylum", 4: "phylum", 5: "clade", 6: "class", 7: "class", 8: "genus", 9: "genus", 10: "species", 11: "species"}
    parent = {2: 1, 3: 2, 4: 2, 5: 3, 6: 5, 7: 4, 8: 6, 9: 7, 10: 8, 11: 9}
    rank = {t: hierarchy.RANK_INDEX.get("no rank" if n == "clade" else n) for t, n in names.items()}
    nodes = spark.createDataFrame([(t, parent[t], "no rank" if n == "clade" else n) for t, n in names.items()], "taxid long, parent long, rank string")
    acc = {f"a{i}": random.choice(list(names)) for i in range(14)}
    lineage = {}
    for a, t in acc.items():
        lineage[a] = {}
        while t in rank:
            if rank[t]:
                lineage[a][rank[t]] = t
            t = parent[t]
    near = {f"q{k}": random.sample(list(acc), random.randint(1, 6)) for k in range(30)}
    pairs = spark.createDataFrame([(q, a) for q, x in near.items() for a in x], "query string, acc string")
    lines = hierarchy.lineages(spark.createDataFrame(list(acc.items()), "acc string, taxid long"), nodes)
    found = {(r.query, r.rank_idx): (r.taxid, r.votes, r.opposers, r.unidentified) for r in assignments.votes(pairs, lines, nodes).collect()}
    assert found == {(q, j): v for q, x in near.items() for j, v in _consensus(x, lineage, parent, rank).items()}


def test_alignment_places():
    assert alignment.align("ACGT", "ACGT") == ("ACGT", "ACGT")
    at = alignment.locate("ACGTTTGG", "ACGT")
    assert (at.start, at.end, at.mismatches) == (0, 3, 0)
    at = alignment.locate("TTTTACGAATTT", "ACGAA", at_head=False)
    assert (at.start, at.end, at.mismatches) == (4, 8, 0)
    at = alignment.locate("GATTACAC", "NNTTAC", umi_limit=2, skip_n=True)
    assert at.umi == "GA" and at.mismatches == 0
    assert alignment.same("R", "A") and not alignment.same("R", "C") and alignment.same("-", "-") and not alignment.same("N", "-")


def test_gap_policy_changes_the_ends():
    free = alignment.align("AACGT", "CGT")
    assert free == ("AACGT", "--CGT")
    assert alignment.Scores(end_gap="gap").end() is None


def test_distributions_against_published_values():
    for p, df, expected in [(0.95, 10, 1.8125), (0.975, 5, 2.5706), (0.99, 20, 2.5280), (0.95, 1, 6.3138)]:
        assert abs(distributions.t_quantile(p, df) - expected) < 1e-4
    for x, n, p in [(0, 5, 0.3), (2, 9, 0.5), (7, 20, 0.1)]:
        direct = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1, n + 1))
        assert abs(distributions.binomial_upper(x, n, p) - direct) < 1e-12


def test_rare_slope_is_the_difference_of_expectations():
    import numpy as np

    counts = np.array([5, 3, 1, 1, 7])
    n = int(counts.sum())

    def expected(m):
        return sum(1 - math.comb(n - c, m) / math.comb(n, m) for c in counts)

    for m in (1, 5, n - 1):
        assert abs(quantify.rare_slope(counts, m) - (expected(m + 1) - expected(m))) < 1e-9
    assert abs(quantify.rare_slope(counts, n - 1) - 2 / n) < 1e-9
    depth = quantify.target_depth(counts, 0.7)
    assert 0 < depth < n


def test_rarefaction_keeps_depth_and_bounds(spark):
    cells = spark.createDataFrame([("s", "a", 30), ("s", "b", 5), ("t", "a", 3)], "samplename string, otuname string, nreads long")
    depths = spark.createDataFrame([("s", 20), ("t", 3)], "samplename string, depth long")
    drawn = quantify.rarefy(cells, depths, replicates=3, seed=5)
    sums = {(r.replicate, r.samplename): r.n for r in drawn.groupBy("replicate", "samplename").agg(F.sum("nreads").alias("n")).collect()}
    assert sums == {(k, s): d for k in (1, 2, 3) for s, d in (("s", 20), ("t", 3))}
    assert drawn.join(cells.withColumnRenamed("nreads", "of"), ["samplename", "otuname"]).filter("nreads > of").isEmpty()
    assert rows_of(drawn) == rows_of(quantify.rarefy(cells.repartition(3), depths, replicates=3, seed=5))


def test_tail_trim_rule(spark):
    quals = ["IIII", "III!", "I!II", "!!!!", "I!I!I"]
    df = spark.createDataFrame([(q, "A" * len(q), q) for q in quals], "name string, seq string, qual string")
    found = {r.name: len(r.seq) for r in reads.trim_tail(df, 10, 2).collect()}
    assert found == {"IIII": 4, "III!": 3, "I!II": 4, "!!!!": 0, "I!I!I": 1}


def test_strings(spark):
    one = spark.range(1)
    assert one.select(sq.reverse_complement(F.lit("ACGTRYKMBDHVN"))).first()[0] == "NBDHVKMRYACGT"
    assert sorted(one.select(sq.expanded(F.lit("AR"))).first()[0]) == sq.expansions("AR") == ["AA", "AG"]
    row = spark.createDataFrame([("ACGT" * 30,)], "s string").select(sq.from_base62(sq.base62("s"))).first()
    assert row[0] == "ACGT" * 30


def test_mates_must_both_stay(spark):
    both = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)], "rec_no long, strand int")
    kept = both.filter("not (rec_no = 1 and strand = 2)")
    assert rows_of(reads.both_mates(both, kept)) == [(0, 1), (0, 2), (2, 1)]


def test_greedy_centroids_match_the_sequential_rule(spark):
    random.seed(2)
    names = {f"n{i}": random.randint(1, 5) for i in range(40)}
    links = [(a, b) for a in names for b in names if a < b and random.random() < 0.08]
    near = {n: {b for a, b in links if a == n} | {a for a, b in links if b == n} for n in names}
    centroid = {}
    for n in sorted(names, key=lambda n: (-names[n], n)):
        hit = [c for c in sorted(near[n], key=lambda m: (-names[m], m)) if centroid.get(c) == c]
        centroid[n] = hit[0] if hit else n
    found = clusters.greedy_centroids(spark.createDataFrame(list(names.items()), "name string, size long"), spark.createDataFrame(links, "query string, target string"))
    assert {r.name: r.centroid for r in found.collect()} == centroid


def test_spike_in_identity_counts_gap_runs_once(spark):
    hits = spark.createDataFrame([("q", "a", "10=2I8="), ("q", "b", "18=2X"), ("r", "a", "=")], "query string, target string, cigar string")
    assert rows_of(clusters.spike_in_variants(hits)) == [(1.0, "r", "a"), (round(18 / 19, 9), "q", "a")]


def test_caches_merge_by_size_or_stop(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "y"), ("l", None)], "key string, acc string")
    b = spark.createDataFrame([("k", "x")], "key string, acc string")
    assert rows_of(neighbours.merged_caches([a, b])) == [("x", "k"), (None, "l")]
    assert rows_of(neighbours.merged_caches([a, b], "large")) == [("x", "k"), ("y", "k"), (None, "l")]
    with pytest.raises(PySparkException):
        neighbours.merged_caches([a, b], stop=True).collect()


def test_tau_test_by_hand(spark):
    cells = spark.createDataFrame([("s", "o", 50), ("b1", "o", 1), ("b2", "o", 2), ("b3", "o", 0), ("s", "p", 3), ("b1", "p", 3), ("b2", "p", 4)], "samplename string, otuname string, nreads long")
    links = spark.createDataFrame([("s", f"b{i}") for i in (1, 2, 3)], "samplename string, blank string")
    assert {r.otuname: r.kept for r in decontam.tau_test(cells, links).collect()} == {"o": True, "p": False}


def test_bad_tags_are_errors(spark):
    for rows in ([(1, "a", "ACG"), (2, "b", "ACG")], [(1, "a", "ACN")], [(1, "a", "ACG"), (2, "b", "AC")]):
        with pytest.raises(PySparkException):
            demux.tag_table(spark.createDataFrame(rows, "rec_no long, name string, seq string")).collect()


def test_jumped_tags_keep_their_sequence(spark):
    tags = spark.createDataFrame([("AA+CC", "t1"), ("GG+TT", "t2")], "tag string, tagname string")
    some = spark.createDataFrame([("AA+CC", "IIII"), ("AA+TT", "IIII"), ("AC+TT", "IIII"), ("AA+CC", "!III")], "index_seq string, index_qual string")
    found = [r.samplename for r in demux.assign_tags(some, tags, "r", "p", least_quality=5).orderBy("index_seq", "index_qual").collect()]
    assert found == ["r__undetermined__p", "r__t1__p", "r__AA+TT__p", "r__undetermined__p"]


def test_overlapping_mates(spark):
    from cubeloom.functions.sequences import COMPLEMENT
    from cubeloom.operators import mates

    turn = str.maketrans(*COMPLEMENT)
    whole = "ACGTTGCATTAGCCGATAGGCTTACCGATT"
    a, b = whole[:20], whole[8:].translate(turn)[::-1]
    wrong = a[:15] + ("A" if a[15] != "A" else "C") + a[16:]
    rows = [("x", a, "I" * 20, b, "I" * 22), ("y", wrong, "I" * 15 + "#" + "I" * 4, b, "I" * 22), ("z", "A" * 20, "I" * 20, "A" * 20, "I" * 20)]
    pairs = spark.createDataFrame(rows, "name string, seq string, qual string, mate_seq string, mate_qual string")
    found = {r.name: r.seq for r in mates.merge_overlapping(pairs, max_share=0.1).collect()}
    assert found == {"x": whole, "y": whole}


def test_estimated_rates_explain_the_blank(spark):
    cells = spark.createDataFrame([("b", "o", 7), ("s", "o", 5000), ("t", "o", 900)], "samplename string, otuname string, nreads long")
    edges = spark.createDataFrame([("b", "s", "reversejump"), ("b", "t", "forwardjump")], "src string, dst string, jump string")
    row = decontam.estimated_jump_rates(cells, spark.createDataFrame([("b",)], "samplename string"), edges).first()
    assert row.residual < 1e-6 and 0 <= row.reverse_rate <= 0.1


def test_reference_cleaning_ends(spark):
    rows = [("p", "AAAACCCCGGGGTTTT", 100), ("q", "CACACACATGTGTGTG", 100), ("x", "AAAACCCCTGTGTGTG", 5)]
    seqs = spark.createDataFrame(rows, "name string, seq string, size long")
    assert {r.name for r in clusters.cleaned_reference(seqs).collect()} == {"p", "q"}


def test_cover_of_random_cubes_is_kept(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    cell = st.tuples(st.sampled_from(["s1", "s2", "s3"]), st.sampled_from(list("abcde")), st.integers(1, 50))

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(cell, min_size=1, max_size=12), st.integers(1, 4))
    def check(cells, n):
        df = spark.createDataFrame(cells, "samplename string, otuname string, nreads long")
        total = sum(c[2] for c in cells)
        assert sum(r[2] for r in cube.top_items(df, n).select("samplename", "otuname", "nreads").collect()) == total
        assert cube.top_items(df, n).select("otuname").distinct().count() <= n + 1

    check()


def test_support_round_shuffles_no_cells_for_its_limits(spark):
    cube = spark.createDataFrame([("s1", "a", 50), ("s1", "b", 3), ("s2", "b", 3), ("s2", "c", 60), ("s3", "c", 1)], "samplename string, otuname string, nreads long")
    kept = filters.support_round(cube, min_item=3, min_item_share=0.5, min_sample=40, min_sample_total=53)
    assert {(r.samplename, r.otuname) for r in kept.collect()} == {("s1", "a"), ("s1", "b"), ("s2", "b"), ("s2", "c")}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the two lists of keys, no totals beside cells
