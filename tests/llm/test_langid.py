from __future__ import annotations

import numpy as np

from foresift.llm import langid as L
from tests.llm.helpers import awkward, empty


def test_held_out_accuracy_and_confidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = L.train_language_model(docs.where(~L.held_out()), sample_rows=400)
    got = L.predict_language(docs, model, ["doc_id", "lang"]).where(L.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0.0 <= r.score <= 1.0 for r in got)


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(1)
    xs, ys = [], []
    for i in range(300):
        at = np.sort(rng.choice(50, 10, replace=False)) + 100 * (i % 3)
        xs.append((at, np.full(10, 0.3)))
        ys.append(i % 3)
    w = L.fit_ftrl(xs, np.array(ys), 3)
    assert all((v @ w[a]).argmax() == y for (a, v), y in zip(xs, ys))
    assert (w != 0).any(axis=1).sum() <= 150


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3)) * 2
    p = L.softmax(logits)
    ys = np.array([rng.choice(3, p=q) for q in p])
    assert abs(L.fit_temperature(logits * 5, ys) - 5) < 0.6
    assert L.fit_temperature(np.array([[9.0, 0.0]]), np.array([0])) > 0.02


def test_features_count_whole_text():
    assert L.features(None) is None and L.features("12 \n!") is None
    a, b = L.features("ab " * 5), L.features("ab " * 5000)
    assert (a[0] == b[0]).all() and (b[1] >= a[1]).all() and b[1].max() > 8
    assert L.features("\U0001d4d0") is not None


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = L.train_language_model(docs, sample_rows=10)
    rows = L.predict_language(docs, model, ["doc_id"]).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == 8
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == "en"
    none = L.train_language_model(empty(spark))
    assert none.languages == [] and none.predict("text") == ("und", 0.0)
    assert L.predict_language(empty(spark), none).count() == 0
    assert L.predict_language(docs, none).columns[:len(docs.columns)] == docs.columns
