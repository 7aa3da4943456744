"""The stages of the corpus pipeline against brute force, on nulls, repeated ids and empty tables."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import quality
from tests.conftest import SMALL, rows_of
from tests.llm.test_operators import brute_components, brute_dedup, brute_hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(2)
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 20)
    base = [f"w{random.randint(0, 900)}" for _ in range(150)]
    near = [*base[:70], "other", *base[71:]]
    shared = [f"s{k}" for k in range(60)]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (2, " ".join(near)), (2, "another text with the same id " + " ".join(f"q{k}" for k in range(40)))]
    texts += [(3, " ".join([f"a{k}" for k in range(30)] + shared)), (4, " ".join(shared + [f"b{k}" for k in range(30)])), (5, "Some words before. " + item), (6, None), (7, ""), (7, ""), (None, " ".join(base))]
    texts += [(None, "a text without an id " + " ".join(f"n{k}" for k in range(30))), (8, " ".join(f"c{k}" for k in range(20000)))]
    return spark.createDataFrame([(i, t, "en", f"src{k % 2}", len(t or "")) for k, (i, t) in enumerate(texts)], SCHEMA)


def plain_rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality_stage_keeps_what_the_machine_passes(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    machine = quality.fit(docs, labels)
    good = [quality.scores(machine, [(r.text or "").encode()], [float(r.n_chars)])[0] >= 0.3 for r in docs.collect()]
    assert rows_of(kept) == [(r.doc_id, r.lang, r.n_chars, r.source, r.text) for r, ok in zip(docs.collect(), good) if ok]


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL)
    rows = plain_rows(docs)
    # Rows as documents of their own, numbered in the order of ids, null ids last.
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    groups = brute_components([(n, rows[k][1]) for n, k in enumerate(order)], 5, 80)
    assert sorted(plain_rows(kept), key=repr) == sorted((rows[order[n]] for n, size, component in groups if not size or n == component), key=repr)
    assert kept.columns == docs.columns


def test_substring_stage_cuts_repeated_windows(spark, docs):
    found = corpus_pipeline.substring_stage(spark, docs, SMALL)
    expected = sorted(brute_dedup(plain_rows(docs)), key=repr)
    words = [(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in found.collect()]
    assert sorted(words, key=repr) == sorted(((d, sha) for d, sha, _, _ in expected), key=repr)
    assert all(r.n_chars == len(r.text or "") for r in found.collect())


def test_decontamination_stage_drops_hits_by_id_and_text(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = plain_rows(docs)
    clean = [(d, t) for d, t in rows if brute_hits([(d, t)], items)[0][2] == 0]
    assert len(clean) == len(rows) - 1
    assert sorted(plain_rows(corpus_pipeline.decontamination_stage(spark, docs, SMALL)), key=repr) == sorted(clean, key=repr)


def test_stages_of_nothing(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_further_columns_are_carried_as_they_are(spark, docs):
    """Columns under the names that a stage might take for its own, in any case of letters, and a column of maps."""
    extra = {n: F.lit(f"own {n}") for n in ("__key", "__cut", "__rest", "__document_key", "__quality_meta", "document_key", "Text_Key", "cut_text", "CUT_text_", "quality_meta", "further_columns", "least_columns", "key", "component_id", "a.b")}
    wide = docs.withColumns(extra | {"pairs": F.create_map(F.lit("k"), F.col("source"))})
    for name in ("quality", "near_duplicates", "substring_dedup", "decontamination"):
        stage = dict(corpus_pipeline.STAGES)[name]
        found, plain = stage(spark, wide, SMALL), stage(spark, docs, SMALL)
        assert found.columns == wide.columns
        assert sorted(map(repr, plain_rows(found))) == sorted(map(repr, plain_rows(plain)))
        for r in found.collect():
            assert all(r[n] == f"own {n}" for n in extra) and r["pairs"] == {"k": r["source"]}
