"""The pipeline against its stages taken one by one, and its effects on planted documents."""
from __future__ import annotations

import corpus_pipeline
from foresift.llm import decontam, secret_scan
from tests.llm.helpers import DOCS
from tests.llm.test_parity_join import brute
from tests.llm.test_tokens import check_pieces  # noqa: F401


def test_stages_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "decontamination", "secret_scan", "packing"]
    one = stages["language_id"](spark, docs, sf)
    assert one.columns == docs.columns
    assert one.count() == docs.where("text rlike '[a-zA-Z]'").count()
    two = {r.doc_id for r in stages["ngram_join"](spark, one, sf).collect()}
    assert two == {d for d, (_, c) in brute([(r.doc_id, r.text) for r in one.collect()]).items() if d == c}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    three = {r.doc_id for r in stages["decontamination"](spark, one, sf).collect()}
    assert three == {r.doc_id for r in one.collect()} - {r.doc_id for r in decontam.find_leaks(one, bench).collect()}
    four = stages["secret_scan"](spark, one, sf).collect()
    assert len(four) == one.count() and all(secret_scan.base_spans(r.text) == [] and r.n_chars == len(r.text) for r in four)


def test_awkward_documents(spark, sf):
    text = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "12 34", "en", "s", 5),
            (None, text + " again", None, "s", 1), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id or 0 for r in stages["language_id"](spark, docs, sf).collect()) == [0, 1, 1, 2]
    assert sorted(r.doc_id or 0 for r in stages["ngram_join"](spark, docs, sf).collect()) == [0, 1, 3, 4, 5]
    for name, stage in stages.items():
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0, name


def test_documents_stay_where_no_language_is_named(spark, sf):
    texts = ["the quick brown fox", "été", None, "", "12 34", "\U0001d4d0"]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()) == [0, 1, 5]


def test_run_returns_pieces_of_what_is_kept(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert all(a == b for a, b in total.values())
