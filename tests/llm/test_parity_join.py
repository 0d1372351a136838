from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foresift.llm import parity_join as P
from foresift.llm.components import connected_components
from tests.llm.helpers import awkward, documents, empty


def brute(rows):
    """id -> (size, least linked id) from all pairs of distinct shingle sets, by Python sets of words."""
    sets = {}
    for name, text in rows:
        words = [bytes(w) for w in (text or "").encode().lower().split()]
        sets[name] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 4 * len(y) <= 5 * len(x) and 4 * len(x) <= 5 * len(y) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in names}


def result(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in P.similarity_components(docs).collect()}


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def family(rng, n, size, edits, vocabulary=5000):
    base = rng.integers(0, vocabulary, size)
    out = []
    for _ in range(n):
        words = base.copy()
        at = rng.integers(0, size, edits)
        words[at] = rng.integers(vocabulary, 2 * vocabulary, edits)
        out.append(" ".join(f"w{x}" for x in words))
    return out


def test_families_chains_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT_IN_SLICE", 10)
    monkeypatch.setattr(P, "SLICE", 64)
    monkeypatch.setattr(P, "BUCKET_KEYS", 500)
    rng = np.random.default_rng(4)
    texts = family(rng, 60, 120, 2) + family(rng, 40, 60, 3) + family(rng, 30, 30, 1) + family(rng, 25, 9, 1)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"q{x}" for x in rng.integers(0, 10**6, 70)) + " " + passage for _ in range(60)]
    chain = [f"c{i}" for i in range(100)]
    for k in range(40):                         # neighbours link, ends do not
        texts.append(" ".join(chain[k * 4:] + [f"d{i}" for i in range(k * 4)]))
    texts += [texts[0].upper()] * 30
    docs = documents(spark, texts, extra=True)
    assert result(docs) == brute(list(enumerate(texts)))


def test_pigeonhole_holds_at_every_size():
    rng = np.random.default_rng(6)
    for n in [*range(1, 60), 200, 777]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for _ in range(8):
            drop = int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]))
            if len(b) and P.similar(a, b):
                x, y = P.sketch(a), P.sketch(b)
                assert len(np.intersect1d(x.keys, y.keys)) >= max(x.shared, y.shared, 1)


def test_bands_cover_partners():
    for n in range(1, 3000):
        assert P._bands.of(P.reach(n)) <= P._bands.of(n) + 1
        assert P.parts_of(P._bands.of(n)) > P.most_apart(n, P.reach(n)) or P.reach(n) > P._bands.top(P._bands.of(n))


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 200), (200, 300), (-5, 100), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: -5, 200: -5, 300: -5, -5: -5}


def test_awkward_rows(spark):
    rows = P.similarity_components(awkward(spark)).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in rows)
    assert [g[:2] for g in got if g[0] != 3] == [(-1, 1), (0, 0), (1, 0), (2, 0), (4, 1), (4, 1), (5, 1)]
    assert all(c == (d if d >= 0 else None) for d, _, c in got)
    assert P.similarity_components(empty(spark)).count() == 0
    two = documents(spark, ["a b c", "A  b\tc", "b a c", "a b", None, ""])
    assert result(two) == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 3), 4: (0, 4), 5: (0, 5)}
    assert P.similarity_components(documents(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("bigint"))).first().component_id is None
