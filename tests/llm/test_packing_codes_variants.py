"""Packing, vector codes and spelling variants against brute-force versions and on edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cubeloom.llm import packing, queries, spelling_variants, vector_codes
from cubeloom.llm.common import Scratch
from tests.conftest import SMALL

DOCS = "doc_id long, text string, length string, word string"


# 11. packing


def library_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.word_bpe_path())
    model.no_truncation()
    model.no_padding()
    return [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, docs, capacity):
    """Pieces tile their documents, sequences are gapless and full or a power of two, and checksums are right."""
    expected = Counter()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
    ids = {}
    for (doc_id, text), found in zip(docs, library_ids([t or "" for _, t in docs])):
        ids.setdefault(doc_id, []).append(found + [1])
        expected[doc_id] += len(found) + 1
    for doc_id, total in expected.items():
        mine = [r for r in rows if r.doc_id == doc_id]
        assert sum(r.length for r in mine) == total
        if len(ids[doc_id]) == 1:
            at = 0
            for r in sorted(mine, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == total
                assert r.ids_crc32 == zlib.crc32(np.array(ids[doc_id][0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == total
        else:
            sums = Counter(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[doc_id] for r in mine)
            assert all(r.ids_crc32 in sums for r in mine)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_packing_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.op11_packing(spark, SMALL).collect()
    check_packing(rows, docs, 2048)
    whole = sum(1 for r in rows if r.length == r.doc_tokens or r.length == 2048)
    assert whole > 0.5 * len(rows)


def test_packing_odd_rows(spark):
    draw = random.Random(1)
    words = ["alpha", "Beta's", "ünïcödé", "日本語", "<|endoftext|>", "x́y", "́z", "it's", "12,5", "ΣΑΣ", " wide", "a b", "--", "🎉"]
    docs = [(1, None), (2, ""), (3, " \t\n "), (4, "word " * 5000), (None, "null id"), (5, "twice"), (5, "twice"), (6, "q" * 3000)]
    docs += [(10 + i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))) for i in range(80)]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], DOCS)
    for capacity in (2048, 64, 16):
        check_packing(packing.pack(df, queries.word_bpe_path(), capacity).collect(), docs, capacity)
    assert packing.pack(df.limit(0), queries.word_bpe_path()).collect() == []


def test_encoder_equals_library_on_random_strings():
    draw = random.Random(2)
    letters = "abcXYZ é́​ \n\t'sdll<|>endoftext09İßΣ漢字🎉\x0b\x1c\x85"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    with open(queries.word_bpe_path(), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        at = 0
        for expected, n in zip(library_ids(texts), counts.tolist()):
            assert ids[at : at + n].tolist() == expected
            at += n
    sliced = pa.array(["x", None, "hello there", "again"]).slice(1, 2)
    assert encoder.encode(sliced)[1].tolist() == [0, 2]


def test_linear_program_against_all_patterns():
    """The optimum of small programs, by the best prices over all patterns: no basis of all patterns is better."""
    draw = random.Random(3)
    for _ in range(30):
        capacity = draw.randint(8, 16)
        lengths = draw.sample(range(1, capacity + 1), 3)
        histogram = {n: draw.randint(1, 30) for n in lengths}
        found, bound = packing.solve(histogram, capacity, gap=0.0, slack=0.0)
        used = Counter()
        for p, x in found:
            assert sum(n * a for n, a in p.items()) <= capacity
            for n, a in p.items():
                used[n] += a * x
        assert all(abs(used[n] - d) < 1e-6 for n, d in histogram.items())
        patterns = [c for c in itertools.product(*(range(capacity // n + 1) for n in lengths)) if any(c) and sum(a * n for a, n in zip(c, lengths)) <= capacity]
        best = math.inf
        demand = np.array([histogram[n] for n in lengths], float)
        for three in itertools.combinations(patterns, 3):
            basis = np.array(three, float).T
            if abs(np.linalg.det(basis)) > 1e-9:
                x = np.linalg.solve(basis, demand)
                if (x > -1e-9).all():
                    best = min(best, x.sum())
        assert sum(x for _, x in found) == pytest.approx(best, abs=1e-6)
        assert bound <= best + 1e-6


def test_knapsack_against_brute_force():
    draw = random.Random(4)
    for _ in range(20):
        capacity = draw.randint(1, 14)
        price = np.full(capacity + 1, -np.inf)
        for n in draw.sample(range(1, capacity + 1), min(3, capacity)):
            price[n] = draw.random()
        best, pick = packing.best_patterns(price, capacity)
        some = [n for n in range(1, capacity + 1) if price[n] > 0]
        all_worths = [sum(a * price[n] for a, n in zip(c, some)) for c in itertools.product(*(range(capacity // n + 1) for n in some)) if sum(a * n for a, n in zip(c, some)) <= capacity]
        assert best[capacity] == pytest.approx(max(all_worths))
        items = packing._read_off(pick, capacity)
        assert sum(items) <= capacity and sum(price[n] for n in items) == pytest.approx(best[capacity])


@pytest.mark.parametrize("kind", ["one length", "halves", "mixed", "small"])
def test_plan_covers_all_items(kind):
    draw = random.Random(5)
    histogram = {
        "one length": {1100: 1001},
        "halves": {1025: 500, 1024: 3},
        "mixed": dict(Counter(min(2048, int(draw.lognormvariate(5, 1.2)) + 1) for _ in range(20_000))),
        "small": {1: 3},
    }[kind]
    plan = packing.planned(histogram, 2048)
    filled: dict[int, list] = defaultdict(list)
    items = [n for n in sorted(histogram) for _ in range(histogram[n])]
    slots = plan.slots.tolist()
    s, cut = 0, 0
    for place, n in enumerate(items):
        while s + 1 < len(slots) and slots[s + 1][0] <= place:
            s += 1
        first, length, many, base, offset, stream = slots[s]
        assert length == n
        if stream < 0:
            number, inside = divmod(place - first, many)
            filled[base + number].append((offset + inside * n, n))
        else:
            parts = packing.cuts(plan, stream + (place - first) * n, n)
            cut += len(parts) > 1
            for _, take, sequence, offset in parts:
                filled[sequence].append((offset, take))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    if kind == "mixed":
        assert cut < 0.02 * len(items)


# 12. vector codes


def codes_by_hand(rows, scale=4096, parts=8, entries=16, rounds=6):
    """``(vec_id, label, code, error), books`` in plain Python."""
    kept = [(i, label, [math.floor(scale * float(x)) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts if kept else 0
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    first = sorted((i, v) for i, _, v in kept if i is not None)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, _, v in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, members in groups.items():
                books[p][k] = tuple(sum(c) // len(members) for c in zip(*members))
    out = []
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, part string, n string, row string"


def test_codes_by_hand(spark):
    draw = random.Random(6)
    vector = lambda: [float(np.float32(draw.gauss(0, 0.3))) for _ in range(16)]
    common = vector()
    rows = [(i, common if i % 3 == 0 else vector(), draw.choice([0, 1, None])) for i in range(150)]
    rows += [(3, common, 0), (200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] + [0.0] * 15, 2), (204, [], 0), (None, vector(), 1)]
    expected, sha = codes_by_hand(rows)
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)
    found = vector_codes.compress(df).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r.vec_id, r.label, r.code, r.error)) for r in found)
    by_label = Counter()
    for _, label, _, error in expected:
        by_label[label] += error
    assert all(r.label_error == by_label[r.label] and r.codebooks_sha256 == sha for r in found)
    # Another number of parts, entries and rounds; more than eight parts take a second number.
    expected, sha = codes_by_hand(rows, 100, 16, 5, 2)
    found = vector_codes.compress(df, scale=100, parts=16, entries=5, rounds=2).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r.vec_id, r.label, r.code, r.error)) for r in found)
    assert {r.codebooks_sha256 for r in found} == {sha}


def test_codes_edges(spark):
    assert vector_codes.code_digests(spark.createDataFrame([], VECTORS)).collect() == []
    df = spark.createDataFrame([(None, [1.0] * 8, 1, "", "", ""), (1, None, 1, "", "", "")], VECTORS)
    assert vector_codes.code_digests(df).collect() == []
    df = spark.createDataFrame([(1, [1.0] * 8, None, "", "", ""), (2, [1.0] * 16, 1, "", "", ""), (3, [1e30] * 8, 1, "", "", ""), (4, [-1.5] * 8, 1, "", "", "")], VECTORS)
    found = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.code_digests(df).collect()}
    assert found == {1: ("00" * 8, 0, 0), 4: ("01" * 8, 0, 0)}


def test_codes_light_parts_are_joined_too(spark, monkeypatch):
    rows = [(i, [i % 7 / 8 + j / 64 for j in range(8)], i % 5 or None) for i in range(60)]
    expected, _ = codes_by_hand(rows)
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], VECTORS)
    for heavy in (1, 9, 2000):  # none, some and all are heavy
        monkeypatch.setattr(vector_codes, "_HEAVY", heavy)
        assert sorted(map(repr, expected)) == sorted(repr((r.vec_id, r.label, r.code, r.error)) for r in vector_codes.compress(df).collect())


# 13. spelling variants


def variants_by_hand(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    around = defaultdict(set)
    masks = defaultdict(list)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i] + "." + w[i + 1 :]].append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                around[w].add(shorter)
                around[shorter].add(w)
    for group in masks.values():
        for a, b in itertools.permutations(group, 2):
            around[a].add(b)
    form = {}
    for w, near in around.items():
        n, best = min((-counts[x], x) for x in near)
        if -n >= 10 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), counts[form[w]] if w in form else None))
    return out


def as_rows(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_variants_of_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    expected = variants_by_hand(docs)
    assert any(x[1] for x in expected)
    assert as_rows(queries.op13_spelling_variants(spark, SMALL)) == sorted(expected, key=repr)


def odd_words(seed):
    draw = random.Random(seed)
    stem = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 12))) for _ in range(25)]
    docs = [(1, None), (2, ""), (None, "Abcdefgh ABCDEFGH abcdefgh"), (3, "z" * 3000 + " " + "z" * 3000), (4, "z" * 2999 + " " + "z" * 2999), (5, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa baaaaaa baaaaaa"), (6, "ééééééé ééééééé 12 ééééééx ééééééx")]
    for i in range(60):
        words = []
        for _ in range(60):
            w = draw.choice(stem)
            kind, at = draw.randint(0, 12), draw.randrange(len(w))
            w = w[:at] + w[at + 1 :] if kind == 0 else w[:at] + draw.choice("abÿ") + w[at + (kind == 1) :] if kind <= 2 else w
            words.append(w if draw.random() < 0.8 else w.upper())
        docs.append((10 + i, " ".join(words)))
    return docs


@pytest.mark.parametrize("group", [10_000, 60, 12])
def test_variants_with_split_postings(spark, group):
    docs = odd_words(group)
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], DOCS)
    found = spelling_variants.group_variants(spelling_variants.corpus_words(df), group=group)
    assert as_rows(found) == sorted(variants_by_hand(docs), key=repr)


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b")], DOCS)
    assert spelling_variants.spelling_variants(df).collect() == []
    assert spelling_variants.spelling_variants(df.limit(0)).collect() == []


def test_chains_of_forms(spark):
    words = spark.createDataFrame([("abcdefg", 1), ("abcdefgh", 10), ("abcdefghi", 100), ("abcdefghij", 1000), ("abcdefghijk", 10**5), ("lonely", 7)], "word string, n long")
    found = {r.word: (r.form, r.root, r.n_near) for r in spelling_variants.group_variants(words).collect()}
    assert found["abcdefg"] == ("abcdefgh", "abcdefghijk", 1) and found["abcdefghij"] == ("abcdefghijk", "abcdefghijk", 2) and found["lonely"] == (None, "lonely", 0)


def test_heap_and_count_filter():
    ids = [1, 4, 9, 2, 4, 7, 4, 9]
    assert spelling_variants.merged([(0, 3), (3, 6), (6, 8)], ids, 2) == [4, 9]
    assert spelling_variants.merged([(0, 3), (3, 6), (6, 8)], ids, 3) == [4]
    draw = random.Random(8)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    words = sorted(set(words))
    expected = {frozenset((a, b)) for a, b in itertools.combinations(words, 2) if spelling_variants.near(a, b)}
    grams = spelling_variants.Grams(words)
    for a, b in itertools.combinations(range(len(words)), 2):
        if frozenset((words[a], words[b])) in expected:
            assert spelling_variants.overlap(grams, np.array([a]), np.array([b]))[0] >= max(len(words[a]), len(words[b])) - 1
    pairs = spelling_variants.near_pairs(np.zeros(len(words), np.int64), words)
    assert {frozenset((words[a], words[b])) for a, b in pairs} == expected and len(pairs) == len(expected)


def test_near_words_once(spark):
    words = spark.createDataFrame([("abcdefgh", 3), ("abcdefgx", 2), ("abcdefg", 9)], "word string, n long")
    found = sorted(tuple(r) for r in spelling_variants.near_words(words, Scratch(spark)).collect())
    assert found == [("abcdefg", "abcdefgh", 9, 3), ("abcdefg", "abcdefgx", 9, 2), ("abcdefgh", "abcdefgx", 3, 2)]
