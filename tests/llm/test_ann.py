from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foresift.llm import ann as A
from tests.llm.helpers import clash

SCHEMA = "vec_id bigint, embedding array<float>"


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[ids[q]]
        assert sorted(mine) == list(range(1, 21))
        hit += len({x for x, _ in mine.values()} & set(ids[best]))
        n += 20
        for x, score in mine.values():
            assert abs(score - v[np.flatnonzero(ids == x)[0]] @ v[q]) < 1e-12
    assert hit / n >= 0.95


def test_shards_and_unequal_norms(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_ROWS", 300)
    monkeypatch.setattr(A, "QUERY_ROWS", 20)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 12)) * rng.uniform(0.2, 3, size=(1500, 1))
    v[500:900] = v[500]                                     # a group of equal vectors
    v = v.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hit = 0
    for q in range(0, 1500, 20):
        s = np.array([float(x @ v[q]) for x in v])
        s[q] = -np.inf
        hit += len({x for _, x in got[q]} & set(np.lexsort((np.arange(1500), -np.round(s, 9)))[:5].tolist()))
    assert hit / (75 * 5) >= 0.9


def test_quantile():
    assert abs(A.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(A.chi_square_quantile(0.5, 2) - 1.386) < 1e-3


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (20, [0.5, 0.0])]
    got = A.nearest(clash(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {0: [(1, 1.0), (1, 1.0), (None, 1.0), (20, 0.5)], 20: [(0, 0.5), (1, 0.5), (1, 0.5), (None, 0.5)]}
    assert A.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
