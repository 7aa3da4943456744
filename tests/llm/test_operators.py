"""The training-data operators against brute-force versions and on edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from cubeloom.llm import bpe, brown_lm, components, html_text, jaccard_join, line_rules, page_model, positional_index, quality, queries, substring_dedup, token_counts, url_filter
from cubeloom.llm.common import Scratch
from tests.conftest import SMALL, rows_of

DOCS = "doc_id long, text string, source string, n_words string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash."""
    random.seed(9)
    base = " ".join(f"w{random.randint(0, 300)}" for _ in range(120))
    rows = [
        (1, base, "a"),
        (2, base + " tail", "a"),
        (2, base + " tail", "a"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n\x0b ", "b"),
        (None, base, "b"),
        (None, None, None),
        (6, "x" * 30000, "b"),
        (7, "By " * 400, "b"),
        (8, "One. two\nOne. two\n#a $b", "a"),
        (9, "Ünï cödé   sp\u00a0x <|endoftext|> 日本 🎉", "c"),
        (10, " ".join(f"w{random.randint(0, 300)}" for _ in range(20000)), "c"),
    ]
    return spark.createDataFrame([(i, t, s, "n", "s") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# 1. language model


def test_language_model_base_and_normalisation(spark, odd, small):
    for docs in (odd, small.select("doc_id", "text")):
        rows = pairs(docs)
        tokens = {k: WORD.findall(lower(t)) + [None] for k, (_, t) in enumerate(rows)}
        held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
        counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
        total, kinds = sum(counts.values()), len(counts)
        expected = sorted(
            (str(d), held[k], len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens[k]), 6))
            for k, (d, _) in enumerate(rows)
        )
        found = brown_lm.score_documents(docs, n_classes=8, unit_share=0.002).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
        assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [r for r in brown_lm.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    # Words that choose their own classes beat words that keep those of their endings.
    endings = [r for r in brown_lm.score_documents(docs, min_count=1 << 40).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.score for r in endings)


def test_language_model_scores_and_sums(spark, small, monkeypatch):
    import numpy as np

    seen = []
    score = brown_lm.score_chunks
    monkeypatch.setattr(brown_lm, "score_chunks", lambda labelled, model: seen.append((labelled.collect(), model)) or score(labelled, model))
    found = {r.doc_id: r for r in brown_lm.score_documents(small, n_classes=8, unit_share=0.002, chunk_rows=50).collect()}
    labelled, model = seen[0]
    texts = {d: WORD.findall(lower(t)) for d, t in pairs(small)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    # The class of every word, the same in all chunks.
    own = {}
    for row in labelled:
        classes, flat, at = np.frombuffer(row.classes, "<i2"), np.frombuffer(row.tokens, "<i4"), 0
        for d, size in zip(row.doc_ids, row.sizes):
            for w, k in zip(texts[d], flat[at : at + size]):
                assert own.setdefault(w, classes[k]) == classes[k]
            at += size
    end = 8
    table, totals, kinds = Counter(), Counter(), Counter()
    for d, ws in texts.items():
        if not held[d]:
            line = [end, *(own[w] for w in ws), end]
            table.update(zip(line, line[1:]))
            totals.update(line[1:])
    kinds.update(own[w] for w in counts)
    share = {c: (totals[c] + 1) / sum(totals[x] + 1 for x in range(9)) for c in range(9)}
    before = {a: sum(table[a, b] for b in range(9)) for a in range(9)}
    go = {(a, b): (table[a, b] + 20 * share[b]) / (before[a] + 20) for a in range(9) for b in range(9)}
    for c in range(9):
        assert abs(sum(go[c, b] for b in range(9)) - 1) < 1e-9
        assert abs(sum(10 ** model.transitions[c]) - 1) < 1e-9
    for c in range(8):  # words of the class, and as many unseen ones as were seen and one more
        mass = sum((counts[w] - model.discount[c]) / totals[c] for w in counts if own[w] == c) + (kinds[c] + 1) * 10 ** model.unseen[c]
        assert abs(mass - 1) < 1e-9
    for d, ws in texts.items():
        line, total = [end, *(own[w] for w in ws), end], 0.0
        for a, b, w in zip(line, line[1:], [*ws, None]):
            p = 1.0 if w is None else (counts[w] - model.discount[b]) / totals[b] if counts[w] else 10 ** model.unseen[b]
            total += math.log10(go[a, b] * p)
        assert abs(total - found[d].score) < 1e-6 * max(1, abs(total))
        assert abs(found[d].perplexity - 10 ** (-total / (len(ws) + 1))) < 1e-6 * found[d].perplexity


def test_language_model_of_nothing(spark, odd):
    assert brown_lm.score_documents(odd.limit(0)).collect() == []


def some_neighbours(words):
    import numpy as np

    rng = np.random.default_rng(3)
    both = np.concatenate([rng.integers(0, 40, (5, 5)), rng.integers(0, 40, (5, 5))]).astype(float) + 5
    return both, [Counter(rng.integers(0, 10, rng.integers(0, 9)).tolist()) for _ in range(words)]


def test_words_move_to_the_class_of_most_likelihood():
    import numpy as np

    both, around = some_neighbours(60)
    x = lambda v: v * np.log(max(v, 1e-300))
    own = np.arange(60) % 4
    expected = []
    for a, sums in zip(own, around):
        gains = []
        for b in range(4):
            total = 0.0
            for c, n in sums.items():
                value = max(both[c, b] - (n if a == b else 0), 0)
                total += x(value + n) - x(value)
            for side in (0, 1):
                n = sum(k for c, k in sums.items() if c // 5 == side)
                margin = max(both[5 * side : 5 * side + 5, b].sum() - (n if a == b else 0), 0)
                total -= x(margin + n) - x(margin)
            gains.append(total)
        expected.append(a if gains[a] >= max(gains) - 1e-9 else int(np.argmax(gains)))
    entries = [(w, c, n) for w, sums in enumerate(around) for c, n in sorted(sums.items())]
    word, code, count = (np.array(column) for column in zip(*entries))
    assert brown_lm.best_classes(word, code, count, own, both).tolist() == expected


def test_word_exchange_does_not_depend_on_batches(spark):
    import numpy as np

    both, around = some_neighbours(200)
    endings, rows, totals = np.arange(brown_lm.ENDINGS) % 4, [], Counter()
    for i, sums in enumerate(around):
        for part in (sums, Counter()):  # as from two chunks
            packed = np.array(sorted(part.items()), dtype="<i4").tobytes() if part else b""
            rows.append((bytearray(f"w{i}".encode()), 1 + i % 2, bytearray(packed)))
            totals[f"w{i}".encode()] += 1 + i % 2
    found = []
    for batch, partitions in (("3", "4"), ("10000", "1")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        frame = spark.createDataFrame(rows, "word binary, n long, around binary")
        found.append({bytes(r.word): r["class"] for r in brown_lm.exchanged_words(frame, endings, both, 4, 3).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and set(found[0]) == {w for w, n in totals.items() if n >= 4}
    assert any(c != endings[brown_lm.ending_of(w)] for w, c in found[0].items())


def test_exchange_raises_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(1)
    block = np.kron(np.array([[9, 1], [1, 9]]), np.ones((5, 5))) + rng.integers(0, 2, (10, 10))
    counts = np.zeros((11, 11))
    counts[:10, :10] = block
    classes = np.array([k % 2 for k in range(10)] + [2])

    def likelihood(c):
        t = np.zeros((3, 3))
        np.add.at(t, (np.repeat(c, 11), np.tile(c, 11)), counts.ravel())
        x = lambda v: v * np.log(np.maximum(v, 1e-300))
        return x(t).sum() - x(t.sum(0)).sum() - x(t.sum(1)).sum()

    scores = [likelihood(classes)]
    for _ in range(4):
        after, before = np.zeros((11, 3)), np.zeros((11, 3))
        for u in range(11):
            np.add.at(after[u], classes, counts[u])
            np.add.at(before[u], classes, counts[:, u])
        if not brown_lm.exchange_round(classes, after, before, np.diagonal(counts).copy(), list(range(10)), 3):
            break
        scores.append(likelihood(classes))
    assert len(set(classes[:5])) == 1 and len(set(classes[5:10])) == 1 and classes[0] != classes[5]
    assert scores[-1] > scores[0]


# 2. substring deduplication


def brute_dedup(rows, window=13):
    first = {}
    for d, t in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - window + 1) if d is not None else ():
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1) if d is not None else ():
            if first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, hashlib.sha256(kept).hexdigest(), len(gone), len(words)))
    return out


def dedup_rows(df):
    return sorted(((r.doc_id, r.kept_sha256, r.n_removed, r.n_words) for r in substring_dedup.dedup_digests(df).collect()), key=repr)


def test_dedup_matches_brute_force(spark, odd, small):
    random.seed(5)
    rows = [(d, " ".join(random.choice(random.choice([["a"], ["a", "b"], list("abcde")])) for _ in range(random.choice([0, 12, 13, 14, 30, 60])))) for d in range(60)]
    line = [f"w{i}" for i in range(200)]
    for d in range(60, 90):
        i = random.randint(0, 150)
        rows.append((d, " ".join(line[i : i + random.randint(10, 40)])))
    rows += [(200, "z " * 40), (201, "z " * 13), (202, "q " + "z " * 20), (203, " ".join(["u", "v"] * 30)), (204, " ".join(["v", "u"] * 30))]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd, small):
        assert dedup_rows(docs) == sorted(brute_dedup(pairs(docs)), key=repr)


def test_dedup_of_nothing(spark, odd):
    assert dedup_rows(odd.limit(0)) == []


# 3. page text


def test_page_text(spark):
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies. Accept them.</div>"
        "<nav><a href=x>Home</a></nav><aside class=sidebar><p>Side text that is long enough. More of it.</p></aside><div id=content><h1>Title</h1>"
        "<p>Hello &amp; goodbye &nbsp; &lt;b&gt;.</p><p>ok</p><form><label>Name</label></form><div class=ad>Buy now! Buy.</div><p>More <a href=1>link</a> text, and so on.</p></div>"
        "<section id=comments><h2>Comments</h2><p>Great article. I liked it a lot, and so did everyone.</p></section><footer>c</footer><script>if(a<b){}</script></body>"
    )
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (2, "u", "", "x"), (None, "u", "<p>", "x")], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    text = "Title\nHello & goodbye <b>.\nok\nMore link text, and so on."
    assert found == {(1, "u"): (text, len(text)), (2, None): ("", 0), (2, "u"): ("", 0), (None, "u"): ("", 0)}


def test_pages_of_nothing_and_broken_markup(spark):
    schema = "page_id long, url string, html string"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    assert html_text.main_text("<article><p>One two three four five.<p title='a>b'>Six seven eight nine ten.</section></div>") == "One two three four five.\nSix seven eight nine ten."
    assert html_text.main_text("<article><p>One two three four five.</p><p x=\"y>Six seven eight nine ten.</p>") == "One two three four five.\nSix seven eight nine ten."
    assert html_text.main_text("<article><p>One two three four five.</p><!-- never <p>closed") == "One two three four five."
    for bad in ('<p x="', "<p x='>", "<script>", "<!--", "</p>", "<div>", '<p x=">" ', "&amp", "<a \"'>"):
        began = time.process_time()
        html_text.main_text(bad * (500_000 // len(bad)))
        assert time.process_time() - began < 10  # in proportion to the length, whatever the markup


def test_long_page():
    began = time.process_time()
    page = "<body>" + "".join(("<p>Words that are content here, and more.</p>", "<div class=ad>Buy</div>", "<p>maybe</p>")[i * i % 7 % 3] for i in range(100_000))
    assert html_text.main_text(page).count("content") > 10_000
    assert time.process_time() - began < 30


@pytest.mark.parametrize("around", ['<div class="right-sidebar">{}</div>', '<div class="site has-sidebar">{}</div>', '<div class="modal-open">{}</div>', "<form>{}</form>", "<form><div class='ad'>Buy it now.</div>{}</form>"])
def test_an_element_around_the_page_takes_nothing_away(around):
    body = "<h1>A title here</h1><p>" + "One two three four five six seven. " * 8 + "</p><p>Nine words are in this last one, they say.</p>"
    wanted = "A title here\n" + ("One two three four five six seven. " * 8).strip() + "\nNine words are in this last one, they say."
    assert html_text.main_text(around.format(f"<article>{body}</article>") + "<footer>All rights.</footer>") == wanted
    assert html_text.main_text(around.format(body) + "<footer>All rights.</footer>") == wanted


def test_what_stands_outside_the_article_goes_under_any_name():
    said = "I do not agree with what is said there. " * 20
    page = (
        '<div class="sponsorship"><p>Buy our new shoes today, they are as cheap as they are good.</p></div>'
        "<main><h1>A title here</h1><p>Some words that make a sentence of the text.</p></main>"
        f'<div class="feedback-list"><p>{said}</p></div><section id="comments"><article><p>{said}</p></article></section>'
    )
    assert html_text.main_text(page) == "A title here\nSome words that make a sentence of the text."


def test_labelling_of_small_pages_is_the_cheapest(small):
    texts = [r.text for r in small.orderBy("doc_id").collect() if r.text]
    tried = turned = 0
    for page, _ in page_model.laid_out(texts, 3, 400):
        blocks = html_text.blocks_of(page)
        if len(blocks) > 10:
            continue
        away, content, edges = html_text.costs_of(blocks)
        best = min(
            sum(away[i] if not s else content[i] for i, s in enumerate(sides)) + sum(c for a, b, c in edges if sides[a] != sides[b])
            for sides in itertools.product((False, True), repeat=len(blocks))
        )
        sides = html_text.minimum_cut(away, content, edges)
        cost = sum(away[i] if not s else content[i] for i, s in enumerate(sides)) + sum(c for a, b, c in edges if sides[a] != sides[b])
        assert abs(cost - best) < 1e-6
        assert html_text.main_text(page) == "\n".join(b.text for b, s in zip(blocks, sides) if s)
        tried += 1
        turned += any(s != (x > y) for s, x, y in zip(sides, away, content))
    assert tried > 50 and turned > 0


def test_block_classifier_is_the_fit_of_its_layouts(spark, small):
    texts = [r.text for r in small.orderBy("doc_id").collect() if r.text]
    pages = list(page_model.laid_out(texts, 1, 3000))
    assert abs(page_model.fit_weights(pages) - html_text.WEIGHTS).max() <= 0.2
    good = total = 0
    for page, labels in page_model.laid_out(texts, 2, 300):
        blocks = html_text.blocks_of(page)
        kept = Counter(html_text.main_text(page).split("\n"))
        good += sum((kept[b.text] > 0) == label for b, label in zip(blocks, labels))
        total += len(labels)
    assert good > 0.97 * total


def test_minimum_cut_is_minimal():
    random.seed(3)
    for _ in range(200):
        n = random.randint(1, 9)
        a, b = ([random.random() * random.choice([0.3, 3]) for _ in range(n)] for _ in range(2))
        edges = [(i, j, random.random()) for i in range(n) for j in range(i) if random.random() < 0.5]

        def cost(side, a=a, b=b, edges=edges):
            return sum(b[i] if s else a[i] for i, s in enumerate(side)) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.minimum_cut(a, b, edges)) - best) < 1e-6


# 4. quality


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels, max_rows=2500).join(labels, "doc_id").filter("held_out").collect()
    assert sum((r.predicted == 1) == (r.quality == 1) for r in found) / len(found) > 0.95


def test_quality_scores_everything(spark, odd):
    labels = spark.createDataFrame([(1, 1), (7, 0), (2, 1), (10, 1), (6, None), (8, 5)], "doc_id long, quality int")
    found = quality.classify(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd.limit(0), labels).collect() == []


def test_quality_sample_is_one_row_an_id(spark, monkeypatch):
    rows = [(1, f"copy {i} of one id") for i in range(400)] + [(i, f"text {i} " + "good words " * 5) for i in range(2, 60)]
    labels = [(i, i % 2) for i in range(1, 60)] * 2 + [(4, 1)]
    seen = []
    fit = quality._fit
    monkeypatch.setattr(quality, "_fit", lambda rows, *x: seen.append([(r["doc_id"], r["label"]) for r in rows]) or fit(rows, *x))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (10, 6000):
        quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), max_rows=limit)
    trained = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5 and i != 4]
    assert len(seen[0]) == 10 and seen[1] == [(i, i % 2) for i in trained]


def test_sum_of_squares_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    machine = quality.Machine(32, np.zeros((quality.N_STATS, 3)), 0.1, rng.normal(size=32 + quality.N_STATS * 4) / 9, rng.normal(size=(32 + quality.N_STATS * 4, 3)) / 9)
    texts = [b"one two two three", b"", b"x ! y"]
    metas = [5.0, 0.0, 90.0]
    row, slot, value, stats = quality.vectors(texts, metas, 32)
    bins = quality.binned(stats, machine.edges, 32)
    for k, got in enumerate(quality.scores(machine, texts, metas)):
        x = [(s, v) for r, s, v in zip(row, slot, value) if r == k] + [(s, 1.0) for s in bins[k]]
        z = machine.bias + sum(machine.weights[s] * v for s, v in x)
        z += sum(machine.factors[s] @ machine.factors[t] * v * w for i, (s, v) in enumerate(x) for t, w in x[:i])
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


# 5. urls


def test_url_rules_and_parts(spark):
    urls = [None, "nothing", "HTTP://Ex.NET", "x://a.example.net/en/1?q#f", "x://example.net/fr/", "x://example.com/de/x", "x://b.org/fr/a", "x://fnet/", "x://h#/a"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, labels).collect()}
    assert found == {
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("ex.net", "", None, "allow"),
        3: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        4: ("example.net", "/fr/", "net/", "block"),
        5: ("example.com", "/de/x", "example.com/de/", "block"),
        6: ("b.org", "/fr/a", "org/fr/", "allow"),
        7: ("fnet", "/", None, "allow"),
        8: ("h", "", None, "allow"),
    }


def test_url_tree_rejects_bad_branches(spark):
    rows, marks = [], []
    for i in range(400):
        kind = ("spam", "news", "blog")[i % 3]
        rows.append((i, f"http://h.xx/{kind}/{i}.html"))
        marks.append((i, int(kind != "spam")))
    rows.append((1000, "http://h.xx/spam/new"))
    found = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    assert all(found[i] == ("block" if i % 3 == 0 else "allow") for i in range(400)) and found[1000] == "block"


def brute_verdicts(rows, marks):
    """The path-template tree, level by level, in plain Python (no rules)."""
    label = {}
    for i, q in marks:
        if q in (0, 1) and i is not None:
            label.setdefault(i, []).append(q == 0)
    pages = []
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        pages.append([lower(host), path.split("/"), label.get(i, []) if i is not None else [], (), ()])
    every = [b for p in pages for b in p[2]]
    prior = sum(every) / len(every) if every else 0.0

    def z(part, whole):
        n, m, b, c = len(part) + 10, len(whole) - len(part) + 10, sum(part) + 10 * prior, sum(whole) - sum(part) + 10 * prior
        pooled = (b + c) / (n + m)
        return abs(b / n - c / m) / math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / n + 1 / m))

    for level in range(1, max(len(p[1]) for p in pages)):
        nodes, kids = {}, {}
        for p in pages:
            if len(p[1]) > level:
                nodes.setdefault((p[0], p[4]), []).append(p)
                kids.setdefault((p[0], p[4], p[1][level]), []).append(p)
        for (host, node, segment), inside in kids.items():
            whole = nodes[host, node]
            labels, of_all = ([b for p in x for b in p[2]] for x in (inside, whole))
            literal = len(inside) >= 20 and (len(inside) >= 0.05 * len(whole) or z(labels, of_all) > 1.96)
            for p in inside:
                p[3], p[4] = node, (*node, ("=" + segment) if literal else "*")
    leaves, families = {}, {}
    for p in pages:
        leaves.setdefault((p[0], p[3], p[4]), []).extend(p[2])
        families.setdefault((p[0], p[3]), []).extend(p[2])
    branch, pools = {}, {}
    for key, labels in leaves.items():
        far = z(labels, families[key[:2]]) > 1.96
        branch[key] = (*key[:2], math.floor(10 * (sum(labels) + 10 * prior) / (len(labels) + 10)) if far else -1)
        pools.setdefault(branch[key], []).extend(labels)
    return [("block" if (sum(x := pools[branch[p[0], p[3], p[4]]]) + 10 * prior) / (len(x) + 10) >= 0.5 else "allow") for p in pages]


def test_url_tree_matches_brute_force(spark):
    random.seed(8)
    rows, marks = [], []
    for i in range(1500):
        host = random.choice(["h.aa", "h.aa", "g.bb"])
        top = random.choice(["*", "news", "shop", "\\\\x", f"s{random.randint(0, 30)}"])
        deep = random.choice(["a/b/c/d/bad", "a/b/c/d/good", "x", ""])
        rows.append((i, f"http://{host}/{top}/{deep}/{random.randint(0, 9)}?q"))
        bad = 0.95 if top in ("*", "s3") or deep.endswith("bad") else 0.05
        if random.random() < 0.8:
            marks.append((i, int(random.random() > bad)))
    rows += [(None, "http://h.aa/*/x"), (5, "http://h.aa/*/x"), (2000, None), (2001, "x")]
    marks += [(5, 7), (6, None), (None, 0), (7, 0), (7, 0)]
    pages = spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id long, url string, path string")
    found = url_filter.judge_urls(pages, spark.createDataFrame(marks, "doc_id long, quality int"), rules=())
    expected = brute_verdicts(rows, marks)
    assert len(set(expected)) == 2
    hosts = [(i, r[:2]) for (i, _), r in zip(rows, [u.split("://")[1].split("?")[0].split("/", 1) if u and "://" in u else ("", "") for _, u in rows])]
    assert rows_of(found.select("page_id", "host", "path", "verdict")) == [(h, i, ("/" + p) if h else "", v) for (i, (h, p)), v in zip(hosts, expected)]


def test_url_wildcard_is_no_literal(spark):
    rows = [(i, f"http://h.xx/{'*' if i < 60 else f'r{i}'}") for i in range(90)]
    marks = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)], "doc_id long, quality int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, marks, rules=()).collect()} == {i: "block" if i < 60 else "allow" for i in range(90)}
    assert url_filter.judge_urls(pages.limit(0), marks).collect() == []


# 6. benchmark


def brute_hits(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = {}
    for item, t in items:
        w = word.findall(lower(t))
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            known.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for d, t in rows:
        w, hit, owners = word.findall(lower(t)), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    owners |= known[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), tuple(sorted(owners))))
    return sorted(out, key=repr)


def test_benchmark_hits(spark, odd, small):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    short = spark.createDataFrame([(1, "by BY by"), (2, "One two"), (2, "w1"), (3, None), (None, "by"), (4, "--")], "item_id long, text string")
    for docs, items in ((small, bench), (odd, short), (odd, short.limit(0))):
        for block in (3, 50_000) if docs is odd else (50_000,):
            found = positional_index.find_contamination(docs, items, block_windows=block).collect()
            assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found), key=repr) == brute_hits(pairs(docs), [(r.item_id, r.text) for r in items.collect()])


def brute_spans(rows, items, span, window=10):
    known = [(item, set(words[i : i + window])) for item, words in items for i in range(max(1, len(words) - window + 1))]
    out = []
    for d, t in rows:
        words, hit, owners = t.split(), set(), set()
        for i in range(len(words)):
            for item, terms in known:
                if terms <= set(words[i : i + span]):
                    hit.update(range(i, min(i + span, len(words))))
                    owners.add(item)
        out.append((d, len(words), len(hit), tuple(sorted(owners))))
    return sorted(out)


def test_proximity_matches_brute_force(spark):
    random.seed(4)
    rows = [(1, "q q q"), (2, "a b c d"), (3, "z z"), (4, "d x c b y a"), (5, "a b c " + "z " * 9 + "d"), (6, "")]
    rows += [(d, " ".join(random.choice("abcdez") for _ in range(random.choice([1, 4, 12, 40])))) for d in range(10, 40)]
    items = [(7, "a b c d".split()), (8, "e e a".split()), (9, ["z"]), (11, list("abcdeabcdezzab"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for span in (3, 6):
        found = positional_index.find_contamination(docs, tests, span=span).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == brute_spans(rows, items, span)


def test_index_of_nothing(spark, odd):
    items = spark.createDataFrame([(1, "by BY by")], "item_id long, text string")
    assert positional_index.find_contamination(odd.limit(0), items).collect() == []


# 7. line rules


def test_line_rules_figures(spark, odd):
    for r, t in zip(line_rules.apply_rules(odd.select("doc_id", "text", "source").repartition(1)).collect(), [None] * 99):
        assert t is None
        assert r.kept in (True, False)
    texts = {d: t or "" for d, t in pairs(odd) if d is not None}
    for r in line_rules.apply_rules(odd).collect():
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(zip(words, words[1:], words[2:]))
        cover = {k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in (i, i + 1, i + 2)}
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(cover) > 50 * len(words))


def test_common_lines_deplete(spark):
    own = lambda i: " ".join(f"v{i}x{k}" for k in range(60))
    ad = " ".join(f"ad{k}" for k in range(100))
    rows = [(i, own(i) + ("\n" + ad.upper() if i < 30 else ""), "h") for i in range(100)] + [(i, own(i) + "\n" + ad, "other") for i in range(100, 105)]
    found = {r.doc_id: (r.removed_words, r.kept) for r in line_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i] == ((100, False) if i < 30 else (0, True)) for i in range(105))


def test_line_counts_match_brute_force(spark, odd):
    random.seed(6)
    common = [" ".join(f"c{k}x{j}" for j in range(random.randint(5, 30))) for k in range(8)]
    rows = []
    for i in range(150):
        lines = [" ".join(f"o{i}y{j}" for j in range(random.randint(10, 60)))] + random.sample(common, random.choice([0, 1, 2]))
        lines += lines[-1:] * random.choice([0, 1])
        random.shuffle(lines)
        rows += [(len(rows) + k, "\n".join(x.upper() if random.random() < 0.2 else f" {x}\t" for x in lines), random.choice(["a", "a", None])) for k in range(random.choice([1, 1, 3]))]
    rows += [(500 + k, rows[0][1], rows[0][2]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for distinct in (False, True):
        having, hosts = {}, Counter()
        texts = {(t, h) for _, t, h in rows}
        every = [(t, h, (t, h)) for t, h in texts] if distinct else [(t, h, d) for d, t, h in rows]
        normal = lambda x: " ".join(x.lower().split())
        for t, h, name in every:
            hosts[h] += 1
            for x in {normal(x) for x in t.split("\n")}:
                having.setdefault((h, x), set()).add(name)
        gone = {k for k, v in having.items() if len(v) >= 20 and len(v) > 0.05 * hosts[k[0]]}
        expected = [(d, sum(len(x.split()) for x in t.split("\n") if (h, normal(x)) in gone)) for d, t, h in rows]
        found = line_rules.apply_rules(docs, distinct_texts=distinct).collect()
        assert sorted((r.doc_id, r.removed_words) for r in found) == sorted(expected)
        assert all(r.kept == (not r.base_failed and r.removed_words <= 0.5 * r.n_words) for r in found)
    assert line_rules.apply_rules(odd.limit(0)).collect() == []


# 8. similarity join


def brute_components(rows, width=3, percent=90):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append((d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()))
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, r in sets[:i]:
            if d is not None and e is not None and s and r and 100 * len(s & r) >= percent * len(s | r):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else top(d)) for d, s in sets), key=repr)


def family_rows():
    random.seed(3)
    rows = []
    for f in range(10):
        base = [f"{f}w{random.randint(0, 400)}" for _ in range(random.choice([3, 8, 9, 10, 11, 12, 15, 20, 40, 150]))]
        for _ in range(random.choice([2, 5, 20])):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 25))):
                w[random.randrange(len(w))] = f"e{random.randint(0, 9999)}"
            rows.append(" ".join(w))
    ids = list(range(len(rows)))
    random.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize(("width", "percent", "leaders"), [(3, 90, 256), (5, 80, 1)])
def test_join_matches_brute_force(spark, odd, width, percent, leaders):
    docs = spark.createDataFrame(family_rows(), "doc_id long, text string").unionByName(odd.selectExpr("doc_id + 500 as doc_id", "text"))
    found = jaccard_join.near_duplicates(docs, shingle=width, percent=percent, leaders=leaders)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute_components(pairs(docs), width, percent)


def test_tokens_of_nothing(spark, odd):
    for operator in (bpe.round_trip_digests, token_counts.count_by_section):
        assert operator(odd.limit(0), queries.byte_bpe_path()).collect() == []


def test_join_of_nothing(spark, odd):
    assert jaccard_join.near_duplicates(odd.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    assert {r.node: r.component for r in components.components(edges, Scratch(spark)).collect()} == {i: 0 for i in range(1, 41)} | {90: 80}


# 9 and 10. tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_bpe_path())


def test_tokens_equal_the_library(spark, odd, small, library):
    for docs in (odd, small):
        expected = []
        for d, t in pairs(docs):
            ids = library.encode(t or "", add_special_tokens=False).ids
            packed = b"".join(i.to_bytes(4, "little") for i in ids)
            text = library.decode(ids, skip_special_tokens=False)
            expected.append((hashlib.sha256(text.encode()).hexdigest(), d, hashlib.sha256(packed).hexdigest(), len(ids)))
        assert rows_of(bpe.round_trip_digests(docs, queries.byte_bpe_path())) == expected
        twice = bpe.decode(bpe.encode(docs.select("doc_id", "text"), queries.byte_bpe_path()), queries.byte_bpe_path())
        assert rows_of(twice) == rows_of(bpe.round_trip(docs.select("doc_id", "text"), queries.byte_bpe_path()))


def test_random_words_equal_the_library(library):
    model = bpe.BpeModel(open(queries.byte_bpe_path(), encoding="utf-8").read())
    random.seed(1)
    letters = "  \n\t\x1c\x85\xa0'sTrevdlm aAbcé1２٣²Ⅷ!?#日🎉\u200d\u3000"
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        assert list(memoryview(model.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids
    for text in ("a" * 3000, "thethe" * 300, "=-" * 900):
        assert list(memoryview(model.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_section_counts_add_up(spark, odd, library):
    counts = {}
    found = token_counts.count_by_section(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), queries.byte_bpe_path()).collect()
    for r in found:
        counts.setdefault(r.doc_id, [0, 0])
        counts[r.doc_id][0] += r.n_tokens
        counts[r.doc_id][1] += r.n_chars
    texts = {d: t or "" for d, t in pairs(odd) if d is not None}
    assert counts == {d: [len(library.encode(t, add_special_tokens=False).ids), len(t)] for d, t in texts.items()}


def brute_sections(library, text, ranges, rule):
    """Tokens by section, token by token and character by character."""
    ids = library.encode(text, add_special_tokens=False).ids
    place = [None] * len(text)
    for start, section, end in sorted(ranges, reverse=True):
        place[start:end] = [section] * len(place[start:end])
    owner = [k for k, c in enumerate(text) for _ in c.encode()]  # the character of each byte
    counts, crossing, at = Counter(), Counter(), 0
    for i in ids:
        size = token_bytes(library, i)
        chars = sorted(set(owner[at : at + size]))
        at += size
        inside = Counter(place[c] for c in chars)
        first = list(dict.fromkeys(place[c] for c in chars))
        if rule == "split":
            for k, n in inside.items():
                counts[k] += n / len(chars)
        else:
            counts[first[0] if rule == "first" else max(first, key=lambda k: inside[k])] += 1
        if len(first) > 1:
            crossing.update(first)
    return counts, crossing, Counter(place)


def token_bytes(library, i):
    return len(library.id_to_token(i)) if not library.id_to_token(i).startswith("<|") else len(library.id_to_token(i).encode())


@pytest.mark.parametrize("rule", ["largest", "first", "split"])
def test_given_sections_match_brute_force(spark, library, rule):
    random.seed(12)
    texts = ["The quick brown fox jumps over the lazy dog.\nAnd more words follow here, of course.", "Ünï cödé 日本語 text 🎉🎉 with emoji", "internationalisation " * 8, "ab"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (7, None), (8, ""), (None, "no id"), (9, "no sections")]
    table, ranges = [], {}
    for i, t in enumerate(texts):
        cuts = sorted(random.sample(range(len(t) + 1), min(6, len(t))))
        ranges[i] = [(a, k, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if k != 2]
        table += [(i, k, a, b) for a, k, b in ranges[i]]
    table += [(7, 4, 0, 3), (8, 5, 0, 1), (None, 1, 0, 2), (0, None, 0, 4), (0, 9, 5, 5), (0, 77, 5000, 6000)]
    sections = spark.createDataFrame(table, "doc_id long, section long, start long, end long")
    found = token_counts.count_by_section(spark.createDataFrame(docs, "doc_id long, text string"), queries.byte_bpe_path(), rule, sections).collect()
    got = Counter()
    for r in found:
        got[(r.doc_id, r.section, "n")] += 1
        for key in ("n_chars", "n_tokens", "n_crossing"):
            got[(r.doc_id, r.section, key)] += r[key]
    expected = Counter()
    for d, t in docs:
        if t:
            counts, crossing, chars = brute_sections(library, t, ranges.get(d, []), rule)
            for k in chars:
                expected[(d, k, "n_chars")] += chars[k]
                expected[(d, k, "n_tokens")] += counts[k]
                expected[(d, k, "n_crossing")] += crossing[k]
    names = {k for k in (*got, *expected) if k[2] != "n"}
    assert {k for k in names if abs(got[k] - expected[k]) > 1e-9 and k[2] != "n_crossing"} == set()
    assert got[(0, 77, "n")] == got[(7, 4, "n")] == got[(8, 5, "n")] == 1
    assert {k for k in names if k[2] == "n_crossing" and got[k] != expected[k]} == set()


def test_lines_match_brute_force(spark, library):
    random.seed(13)
    docs = [(i, "".join(random.choice(["word ", "\n", "\n\n  ", "日本", "x", " of", "."]) for _ in range(40))) for i in range(30)]
    found = {(r.doc_id, r.section): (r.n_chars, r.n_tokens, r.n_crossing) for r in token_counts.count_by_section(spark.createDataFrame(docs, "doc_id long, text string"), queries.byte_bpe_path()).collect()}
    expected = {}
    for d, t in docs:
        cuts = [0, *(i + 1 for i, c in enumerate(t) if c == "\n" and i + 1 < len(t)), len(t)]
        counts, crossing, chars = brute_sections(library, t, [(a, k, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "largest")
        expected |= {(d, k): (chars[k], counts[k], crossing[k]) for k in chars}
    assert found == expected


def test_attribution_rules():
    import numpy as np

    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert token_counts.attribute(starts, ends, bounds, "first")[0].tolist() == [2, 1]
    assert token_counts.attribute(starts, ends, bounds, "largest")[0].tolist() == [1, 2]
    split, touched = token_counts.attribute(starts, ends, bounds, "split")
    assert np.allclose(split, [4 / 3, 5 / 3]) and touched.tolist() == [1, 1]
