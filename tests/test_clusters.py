"""Clustering operators and their queries against brute force."""

from __future__ import annotations

import random
import zlib

from cubeloom.operators import clusters
from cubeloom.plans import catalogue
from cubeloom.plans import fixtures as fx
from cubeloom.plans import sequence_queries as queries


def _chimeras(table: list[tuple[str, str, int]], skew: float = 2.0) -> dict[str, tuple[str, str]]:
    """Every break of every sequence with every pair of parents."""
    found = {}
    for name, seq, size in table:
        parents = sorted(((-s, p, x) for p, x, s in table if p != name and s >= skew * size))
        if any(x.startswith(seq) or x.endswith(seq) for _, _, x in parents):
            continue
        mid = len(seq) // 2
        for at in sorted(range(1, len(seq)), key=lambda b: (abs(b - mid), b)):
            lefts = [p for p in parents if p[2].startswith(seq[:at])]
            rights = [p for p in parents if p[2].endswith(seq[at:])]
            pairs = [(a[1], b[1]) for a in lefts for b in rights if a[2] != b[2]]
            if pairs:
                found[name] = pairs[0]
                break
    return found


def test_chimeras_at_every_break(spark):
    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    parents = [(f"p{i}", word(draw.choice([24, 28, 31])), 40 + i) for i in range(8)]
    table = parents + [(f"q{i}", seq, 90) for i, (_, seq, _) in enumerate(parents[:2])]
    for at in range(1, 24):
        a, b = draw.sample(parents, 2)
        table.append((f"x{at:02d}", a[1][:at] + b[1][-(24 - at) :], 30 if at % 6 == 0 else 5))
    insert = parents[0][1]
    table += [("deleted", insert[:9] + insert[10:], 3), ("head", insert[:12], 3), ("tail", insert[-12:], 3), ("one", "A", 1)]
    expected = _chimeras(table)
    assert len(expected) >= 15
    found = clusters.two_parent_chimeras(spark.createDataFrame(table, "name string, seq string, size long"))
    assert {r.name: (r.left_parent, r.right_parent) for r in found.collect()} == expected


def test_chimeras_of_short_alphabet(spark):
    draw = random.Random(8)
    for skew in (1.0, 2.0):
        table = [(f"s{i:02d}", "".join(draw.choice("AC") for _ in range(draw.randint(1, 9))), draw.randint(1, 9)) for i in range(60)]
        expected = _chimeras(table, skew)
        assert expected
        found = clusters.two_parent_chimeras(spark.createDataFrame(table, "name string, seq string, size long"), skew)
        assert {r.name: (r.left_parent, r.right_parent) for r in found.collect()} == expected


def test_chimera_flag_takes_all_documents(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, f"text {draw.randint(0, 60)}", "en", "web", 7) for i in range(150, 260)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seqs = [(r.name, r.seq, 100 + r.doc_id % 7) for r in fx.seq_d(spark, str(tmp_path)).collect()]
    of = {name: seq for name, seq, _ in seqs}
    made = [(f"x{n}", s[:16] + of[f"d{int(n[1:]) - 1}"][16:], 10) for n, s, _ in seqs if f"d{int(n[1:]) - 1}" in of]
    found = catalogue.queries()["chimera_flag"](spark, str(tmp_path))
    assert {r.name: (r.left_parent, r.right_parent) for r in found.collect()} == _chimeras(seqs + made)


def _documents(spark, path, texts: list[str]) -> str:
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_remap_reads_searches_all_documents(spark, tmp_path):
    draw = random.Random(10)
    d = _documents(spark, tmp_path, [f"text {draw.randint(0, 50)}" for _ in range(120)])
    seqs = [(r.doc_id, r.name, r.seq) for r in fx.seq_d(spark, d).collect()]
    expected = {}
    grams = lambda s: {s[i : i + 8] for i in range(len(s) - 7)}
    for i, _, seq in seqs:
        read = seq[:15] + "A" + seq[16:]
        near = [(n, t) for _, n, t in seqs if len(grams(read) & grams(t)) >= 4] if i % 20 == 0 else []
        hits = [(-share, n) for share, (n, _) in zip(clusters.identities([read] * len(near), [t for _, t in near]), near)]
        if hits and -min(hits)[0] >= 0.95:
            expected[f"r{i}"] = (min(hits)[1], round(-min(hits)[0], 9))
    assert any(int(target[1:]) % 20 for target, _ in expected.values())
    found = catalogue.queries()["remap_reads"](spark, d)
    assert sorted((r.query, r.target, round(r.identity, 9)) for r in found.collect()) == sorted((q, *x) for q, x in expected.items())


def test_best_match_by_ranges_is_the_best_of_all_pairs(spark, monkeypatch):
    draw = random.Random(21)
    letters = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    targets = [(f"t{i}", letters(draw.choice([5, 20, 28]))) for i in range(150)] + [("same", "ACGTACGTTTGACCA"), ("é", "ÄCGTTGCAÄCGT"), ("gone", None)]
    asked = [(f"q{i}", t[:9] + "A" + t[10:]) for i, (_, t) in enumerate(targets[::3]) if t] + [("same", "ACGTACGTTTGACCA"), ("u", "ÄCGTTGCAÄCGT"), ("q", None), ("short", "AC")]
    q, t = (spark.createDataFrame(rows, "name string, seq string") for rows in (asked, targets))
    for name, small in (("_BLOCK", 300), ("_CHUNK", 200), ("_FIRST", 1)):
        monkeypatch.setattr(clusters, name, small)
    for share in (0.0, 0.9):
        expected = clusters.best_match(clusters.shared_kmer_hits(q, t, k=4, min_shared=2, min_identity=share))
        found = clusters.best_shared_kmer_match(q, t, k=4, min_shared=2, min_identity=share)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.select("query", "target", "identity").collect()))
    none = spark.createDataFrame([], "name string, seq string")
    assert clusters.best_shared_kmer_match(q, none).isEmpty() and clusters.best_shared_kmer_match(none, t).isEmpty()


def test_nothing_is_aligned_behind_an_equal_target(monkeypatch):
    draw = random.Random(22)
    seq = "".join(draw.choice("ACGT") for _ in range(30))
    targets = [(f"t{i:04}", seq[: 20 + i % 3]) for i in range(1000)]
    seen, plain = [], clusters.identities
    monkeypatch.setattr(clusters, "identities", lambda a, b: seen.extend(a) or plain(a, b))
    for postings in (50, 2_000_000):
        monkeypatch.setattr(clusters, "_POSTINGS", postings)
        seen.clear()
        queries = [("a", seq), ("t0000", seq[:25])]
        assert list(clusters.best_of_chunk(queries, targets, 8, 4, 0.95)) == [("a", "t0000", 1.0), ("t0000", "t0001", 1.0)]
        assert len(seen) == 2
        pairs = [(q, t) for a, b in clusters.sharing([seq], [t for _, t in targets], 8, 14) for q, t in zip(a.tolist(), b.tolist())]
        assert pairs == [(0, i) for i in range(1000) if i % 3 >= 1]


def _one_apart(a: str, b: str) -> bool:
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def test_links_join_what_differs_in_one_place(spark):
    draw = random.Random(11)
    seqs = sorted({"".join(draw.choice("ACG") for _ in range(draw.choice([4, 5]))) for _ in range(80)})
    expected = sorted((a, b) for a in seqs for b in seqs if _one_apart(a, b))
    found = queries._hamming_links(spark.createDataFrame([(s, s) for s in seqs], "name string, seq string"))
    assert sorted((r.query, r.target) for r in found.collect()) == expected


def test_clusters_and_denoising_take_whole_sequences(spark, tmp_path):
    draw = random.Random(12)
    d = _documents(spark, tmp_path, [f"text {draw.randint(0, 60)}" for _ in range(120)])
    table: dict[str, list] = {}
    for r in fx.seq_d(spark, d).collect():
        at = zlib.crc32(r.seq.encode()) % 32
        wrong = r.seq[:at] + dict(zip("ACGT", "CGTA"))[r.seq[at]] + r.seq[at + 1 :]
        for name, seq, size in ((r.name, r.seq, 4), ("v" + r.name, wrong, 1)):
            first, total = table.get(seq, (name, 0))
            table[seq] = (min(first, name), total + size)
    for query, power, skew in (("centroid_cluster", 1, 0), ("denoise", 3, 2**1.5)):
        chosen: dict[str, str] = {}
        rows = sorted(((-(size**power), name, seq) for seq, (name, size) in table.items()))
        for size, name, seq in rows:
            near = [n for s, n, other in rows if chosen.get(n) == n and _one_apart(seq, other) and s <= skew * size]
            chosen[name] = near[0] if near else name
        assert len(set(chosen.values())) < len(chosen)
        found = catalogue.queries()[query](spark, d)
        other = "centroid" if query == "centroid_cluster" else "denoised"
        assert {r["name"]: r[other] for r in found.collect()} == chosen
