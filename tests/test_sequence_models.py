"""Error-model denoising, chimera scores and indexed search against brute force."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from cubeloom.operators import chimeras, denoise, search
from cubeloom.plans import fixtures


def letters(draw, n):
    return "".join(draw.choice("ACGT") for _ in range(n))


def edited(draw, seq, n):
    for _ in range(n):
        at, kind = draw.randrange(len(seq)), draw.randrange(3)
        seq = seq[:at] + ("" if kind == 0 else draw.choice("ACGT")) + seq[at + (kind != 1) :]
    return seq


# denoising


def test_near_finds_every_pair(spark):
    draw = random.Random(1)
    base = [letters(draw, n) for n in (12, 12, 13)]
    seqs = sorted({"".join(draw.choice("ACGT") if draw.random() < 0.15 else c for c in draw.choice(base)) for _ in range(150)})
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    expected = sorted((a, b) for a, b in itertools.permutations(seqs, 2) if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 3)
    assert sorted(tuple(r) for r in denoise._near(df, df, 3).collect()) == expected


def test_tail_bounds_the_poisson_chance():
    for size in (2, 3, 10, 60):
        for expected in (1e-12, 1e-4, 0.3, 1.5, 20.0):
            terms = [math.exp(-expected + k * math.log(expected) - math.lgamma(k + 1)) for k in range(size, size + 400)]
            exact = sum(terms) / -math.expm1(-expected)
            found = math.exp(denoise.log_tail(np.array([float(size)]), np.array([math.log(expected)]))[0])
            assert found >= exact * (1 - 1e-9)
            if expected < size and exact > 1e-300:
                assert found <= exact * (size + 1) / (size + 1 - expected) * 1.01


def test_planted_errors(spark):
    draw = random.Random(2)
    true = [letters(draw, 40) for _ in range(3)]
    true.append(true[0][:7] + ("A" if true[0][7] != "A" else "C") + true[0][8:])  # one letter from the largest
    rate = {38: 0.002, 25: 0.01, 12: 0.06}
    reads, wrong = [], {q: [0, 0] for q in rate}
    for i in range(6000):
        t = true[min(int(draw.expovariate(0.7)), 3)]
        qual = draw.choices(list(rate), [6, 3, 1], k=len(t))
        seq = ""
        for c, q in zip(t, qual):
            bad = draw.random() < rate[q]
            wrong[q][0] += bad
            wrong[q][1] += 1
            seq += draw.choice([x for x in "ACGT" if x != c]) if bad else c
        reads.append((i, seq, "".join(chr(33 + q) for q in qual), t))
    reads += [(9000, None, "I", ""), (9001, "ACGN", "IIII", ""), (9002, "ACGT", "I", ""), (9003, letters(draw, 40), "I" * 40, "")]
    df = spark.createDataFrame(reads, "id int, seq string, qual string, truth string")
    best, rates = denoise.learned(df, rounds=4)
    found = {r.seq: r.centre for r in best.collect()}
    assert {c for c in found.values() if c} == set(true)
    hits = sum(found.get(s) == t for i, s, _, t in reads if i < 9000)
    assert hits >= 0.995 * 6000
    assert found[reads[-1][1]] is None
    for q, (bad, all_) in wrong.items():
        measured = 1 - np.average([rates[i, i, q] for i in range(4)])
        assert measured == pytest.approx(bad / all_, rel=0.1)
    mapped = denoise.denoised_reads(df, rounds=1)
    assert mapped.count() == len(reads)
    assert sorted(r.denoised for r in denoise.variants(mapped).collect()) == sorted(true)


def test_denoising_nothing_twice(spark):
    df = spark.createDataFrame([("ACGT", "IIII"), ("AAAA", "IIII")], "seq string, qual string")
    assert [r.denoised for r in denoise.denoised_reads(df).collect()] == [None, None]
    assert denoise.denoised_reads(df.limit(0)).collect() == []


# chimeras


def model_by_hand(q, others, rules):
    """The best ungapped model in plain Python: ``(left, right, break, score)``."""
    best = None
    for a, b in itertools.permutations(range(len(others)), 2):
        for at in range(1, len(q)):
            score = 1.0
            for places, own, other in ((range(at), others[a], others[b]), (range(at, len(q)), others[b], others[a])):
                yes = sum(q[i] == own[i] != other[i] for i in places)
                no = sum(q[i] == other[i] != own[i] for i in places)
                neither = sum(q[i] not in (own[i], other[i]) for i in places)
                score *= yes / (rules.no_weight * (no + rules.prior) + neither)
            if score > 0 and (best is None or score > best[3] + 1e-12):
                best = (a, b, at, score)
    return best


def test_scores_by_hand():
    draw = random.Random(3)
    rules = chimeras.Rules(min_score=0, min_differences=0, min_divergence=-1000)
    for _ in range(40):
        base = letters(draw, 40)
        others = ["".join(draw.choice("ACGT") if draw.random() < 0.1 else c for c in base) for _ in range(3)]
        at = draw.randint(8, 32)
        q = others[0][:at] + others[1][at:]
        expected, found = model_by_hand(q, others, rules), chimeras.best_model(q, others, rules)
        assert (expected is None) == (found is None)
        if found:
            assert found[:3] == expected[:3] and found[3] == pytest.approx(expected[3])


def test_planted_chimeras(spark):
    draw = random.Random(4)
    base = letters(draw, 200)
    parents = [(f"p{i}", "".join(draw.choice("ACGT") if draw.random() < 0.2 else c for c in base), 100 + i) for i in range(8)]
    table, made = list(parents), {}
    for i in range(40):
        (_, a, _), (_, b, _) = draw.sample(parents, 2)
        at, seq = draw.randint(60, 140), None
        seq = list(a[:at] + b[at:])
        for place in draw.sample(range(200), draw.randint(1, 3)):
            seq[place] = draw.choice("ACGT")
        made[f"x{i}"] = "".join(seq)
    table += [(n, s, 10) for n, s in made.items()]
    good = {f"g{i}": edited(draw, draw.choice(parents)[1], 3) for i in range(20)}
    table += [(n, s, 10) for n, s in good.items()] + [("null", None, 5), ("short", "ACG", 5)]
    df = spark.createDataFrame(table, "name string, seq string, size long")
    found = {r["name"] for r in chimeras.denovo(df).collect()}
    assert len(found & set(made)) >= 0.9 * len(made)
    assert not found & set(good) and not found & {n for n, *_ in parents}
    reference = spark.createDataFrame([(n, s) for n, s, _ in parents], "name string, seq string")
    queries = df.filter("size = 10")
    by_reference = {r["name"] for r in chimeras.against_reference(queries, reference).collect()}
    assert len(by_reference & set(made)) >= 0.9 * len(made) and not by_reference & set(good)
    exact = spark.createDataFrame([*((n, s, z) for n, s, z in parents), ("whole", parents[0][1][:90] + parents[1][1][90:], 3), ("off", made["x0"], 3)], "name string, seq string, size long")
    assert "whole" in {r["name"] for r in chimeras.denovo(exact, chimeras.Rules(exact=True)).collect()}


def test_a_chimera_is_no_parent(spark):
    draw = random.Random(5)
    a, b, c = (letters(draw, 120) for _ in range(3))
    first = a[:60] + b[60:]
    second = first[:90] + c[90:]  # of the chimera and c, so of b and c too
    df = spark.createDataFrame([("a", a, 1000), ("b", b, 1000), ("c", c, 1000), ("first", first, 100), ("second", second, 10)], "name string, seq string, size long")
    found = {r["name"]: (r.left_parent, r.right_parent) for r in chimeras.denovo(df).collect()}
    assert found["first"] == ("a", "b") and "first" not in found.get("second", ())


# search


def infix_distance(q, t):
    """The fewest edits between the whole of *q* and any part of *t*."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(q, 1):
        now = [i]
        for j, d in enumerate(t, 1):
            now.append(min(row[j - 1] + (c != d), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_no_pair_is_lost(spark):
    draw = random.Random(6)
    targets = [(f"t{i}", letters(draw, 90)) for i in range(25)]
    targets += [(f"s{i}", edited(draw, targets[i][1], 5)) for i in range(10)] + [("null", None), ("tiny", "AC")]
    queries = [(f"q{i}", edited(draw, draw.choice(targets[:35])[1][10:70], draw.randint(0, 6))) for i in range(60)] + [("none", None), ("short", "ACGTA")]
    index = search.store(spark.createDataFrame(targets, "name string, seq string"), 6, buckets=4)
    asked = spark.createDataFrame(queries, "name string, seq string")
    found = {(r.query, r.target) for r in search.candidates(asked.filter("seq is not null").withColumnRenamed("name", "query"), index, 0.9).collect()}
    expected = set()
    for n, q in queries:
        for t, seq in targets:
            if q and seq and len(q) >= 40 and infix_distance(q, seq) <= int((1 / 0.9 - 1) * len(q) + 1e-9):
                expected.add((n, t))
    assert len(expected) > 50 and expected <= found
    assert [r["name"] for r in search.too_short(asked.filter("seq is not null"), index, 0.9).collect()] == ["short"]
    hits = search.hits(asked, index, 0.9).collect()
    assert {(r.query, r.target) for r in hits if r.strand == "+"} <= found
    for r in hits:
        q, t = dict(queries)[r.query], dict(targets)[r.target]
        q = q if r.strand == "+" else q[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r.matches <= len(q) <= r.columns and r.identity == pytest.approx(r.matches / r.columns)
        assert infix_distance(q, t[r.target_start : r.target_end]) <= r.columns - r.matches


def test_alignment_by_hand():
    """Scores against the plain recursion over whole tables."""
    draw = random.Random(7)

    def by_hand(q, t):
        low = -(10**9)
        best = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
        down, right = [r[:] for r in best], [r[:] for r in best]
        best[0] = [0] * (len(t) + 1)
        for i in range(1, len(q) + 1):
            for j in range(len(t) + 1):
                down[i][j] = max(best[i - 1][j] + search.GAP_OPEN, down[i - 1][j] + search.GAP_EXTEND)
                right[i][j] = max(best[i][j - 1] + search.GAP_OPEN, right[i][j - 1] + search.GAP_EXTEND) if j else low
                across = best[i - 1][j - 1] + (search.MATCH if q[i - 1] == t[j - 1] else search.MISMATCH) if j else low
                best[i][j] = max(across, down[i][j], right[i][j])
        return max(best[-1])

    qs, ts = [], []
    for _ in range(60):
        t = letters(draw, draw.randint(20, 40))
        qs.append(edited(draw, t[4:18], draw.randint(0, 3)))
        ts.append(t)
    out = search.aligned(qs, ts, [4] * 60, 45)
    assert out[:, 0].tolist() == [by_hand(q, t) for q, t in zip(qs, ts)]


def test_both_strands_store_and_remap(spark):
    draw = random.Random(8)
    flip = str.maketrans("ACGT", "TGCA")
    targets = [(f"t{i}", letters(draw, 80)) for i in range(12)]
    reads = [(f"r{i}", t if i % 2 else t[::-1].translate(flip)) for i, (_, t) in enumerate(targets)] + [("lost", letters(draw, 80))]
    df = spark.createDataFrame(reads, "name string, seq string")
    index = search.store(spark.createDataFrame(targets, "name string, seq string"), 10, buckets=4)
    found = {r["name"]: (r.target, r.strand) for r in search.remapped(df, index).collect()}
    assert found == {f"r{i}": (f"t{i}", "+" if i % 2 else "-") for i in range(12)} | {"lost": (None, None)}
    plan = search.candidates(df.withColumnRenamed("name", "query"), index, 0.97)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    where = spark.sql(f"DESCRIBE FORMATTED {index.words}").filter("col_name = 'Location'").first()["data_type"]
    again = search.opened(spark, where.rsplit("/", 1)[0], 10, buckets=4)
    assert {r["name"]: r.target for r in search.remapped(df, again).collect()} == {n: t for n, (t, _) in found.items()}


def test_clusters_on_both_strands(spark):
    draw = random.Random(9)
    flip = str.maketrans("ACGT", "TGCA")
    true = [letters(draw, 100) for _ in range(5)]
    rows = [(f"c{i}", t, 50) for i, t in enumerate(true)] + [(f"m{i}", (t[:50] + "A" + t[51:])[::-1].translate(flip), 2) for i, t in enumerate(true)]
    found = {r["name"]: (r.centroid, r.strand) for r in search.clustered(spark.createDataFrame(rows, "name string, seq string, size long"), 0.97).collect()}
    assert found == {f"c{i}": (f"c{i}", "+") for i in range(5)} | {f"m{i}": (f"c{i}", "-") for i in range(5)}


# steps that keep large tables from being compared in pairs


def test_largest_of_each_neighbourhood(spark):
    draw = random.Random(11)
    base = [letters(draw, n) for n in (20, 20, 21)]
    seqs = sorted({"".join(draw.choice("ACGT") if draw.random() < 0.12 else c for c in draw.choice(base)) for _ in range(150)})
    sizes = {s: draw.randint(2, 9) for s in seqs}

    def near(a, b):
        return a != b and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 4

    expected = sorted(s for s in seqs if not any(near(s, t) and (-sizes[t], t) < (-sizes[s], s) for t in seqs))
    df = spark.createDataFrame(list(sizes.items()), "seq string, size long")
    assert sorted(r.seq for r in denoise._largest(df, 4).collect()) == expected


def test_unique_sequences_of_sorted_sums(spark):
    draw = random.Random(12)
    reads = [(letters(draw, draw.choice((2, 3))), None) for _ in range(500)]
    reads = [(s, "".join(chr(33 + draw.randrange(41)) for _ in s)) for s, _ in reads]
    found = {r.seq: (r["size"], list(r.quality)) for r in denoise.unique_sequences(spark.createDataFrame(reads, "seq string, qual string").repartition(5)).collect()}
    for s in {s for s, _ in reads}:
        quals = [[ord(c) - 33 for c in q] for t, q in reads if t == s]
        assert found.pop(s) == (len(quals), [math.floor(sum(x) / len(quals) + 0.5) for x in zip(*quals)])
    assert not found


def test_letters_are_drawn_by_crc32():
    names = ["1:2:3", "", "77:1:1000"]
    assert fixtures.crcs(names, 64).tolist() == [[zlib.crc32(f"{x}#{i}".encode()) for i in range(1, 65)] for x in names]


def test_best_parents_of_chunks(spark):
    """Candidates against counting all pairs, with copies, unequal lengths, repeated words and sizes that rule out."""
    draw = random.Random(13)
    rows = [(f"p{i}", letters(draw, draw.randint(3, 30)), draw.choice((4, 8, 20))) for i in range(60)]
    rows += [(f"c{i}", rows[i % 7][1], rows[i % 7][2]) for i in range(25)] + [("rep", "ACACACACACACACAC", 30)]
    asked = [(f"q{i}", draw.choice(rows)[1][:9] + draw.choice(rows)[1][-9:], draw.choice((1, 3, 9))) for i in range(30)] + [rows[0]]
    frames = [spark.createDataFrame(x, "name string, seq string, size long").repartition(3) for x in (asked, rows)]
    k, chunks, per_chunk = 4, 3, 4
    for skew in (None, 2.0):
        expected = set()
        for name, seq, size in asked:
            n = len(seq) - k + 1
            for chunk in range(chunks):
                words = {seq[i : i + k] for i in range(max(n, 0)) if i * chunks // n == chunk}
                shared = [(-len(words & {p[i : i + k] for i in range(len(p) - k + 1)}), -s, m) for m, p, s in rows if m != name and (skew is None or s >= skew * size)]
                expected |= {(name, m) for n_, _, m in sorted(shared)[:per_chunk] if n_}
        assert {tuple(r) for r in chimeras.candidates(*frames, k, chunks, per_chunk, skew).collect()} == expected


def test_pairs_of_words_stay_in_blocks(spark, monkeypatch):
    """Small blocks and lots find the same, and no pair of a chunk and a parent is written."""
    draw = random.Random(14)
    parents = [letters(draw, 60) for _ in range(40)]
    args = [a[:30] + b[30:] for a, b in itertools.pairwise(parents)], np.ones(39), parents, np.full(40, 5), 4, 4, 2.0, 5
    whole = chimeras.best_shared(*args)
    monkeypatch.setattr(chimeras, "_POSTINGS", 50)
    assert all((x == y).all() for x, y in zip(whole, chimeras.best_shared(*args)))
    assert len(whole[0]) <= 39 * 4 * 5


def test_seeds_need_their_whole_piece(spark, monkeypatch):
    """A k-mer with other letters beside it makes no candidate; buckets follow the k-mers."""
    draw = random.Random(15)
    query = letters(draw, 40)
    targets = [("whole", query), ("start", query[:20] + letters(draw, 20))]
    # The k-mer of the query's second half in other surroundings.
    targets += [(f"other{i}", letters(draw, 8) + query[26:34] + letters(draw, 8)) for i in range(20)]
    df = spark.createDataFrame(targets, "name string, seq string")
    monkeypatch.setattr(search, "_BUCKET", 40)
    assert search.buckets_for(df, 8) == -(-(2 * 33 + 20 * 17) // 40)
    index = search.store(df, 8, search.buckets_for(df, 8))
    asked = spark.createDataFrame([("q", query)], "query string, seq string")
    assert {r.target for r in search.candidates(asked, index, 0.96).collect()} == {"whole", "start"}
    assert search.buckets_for(df.limit(0), 8) == 8
