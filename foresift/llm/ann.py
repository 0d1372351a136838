"""Nearest neighbours by stable projections and a kd-tree (operator 4).

Largest inner product becomes least distance: every vector gets one more component that lifts it to the largest norm, queries
get 0 there. A Gaussian (2-stable) projection to a few dimensions keeps distances in distribution: the squared projected
distance of two points is their squared distance times a chi-square variable. A kd-tree indexes the projections; its leaves
are taken in the order of their distance from the projected query and their points verified on the original vectors, until
the next projected distance lies beyond the chi-square quantile of the k-th distance so far: with that probability no
neighbour is left.

Vectors are dealt into shards and queries into blocks, each of bounded size, so one task holds one shard and one block; the
k best of each shard are merged for each query. Every row is indexed and none is capped; equal vectors spread over shards.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries nor
as candidates; only vectors of the same length are compared; ties go to the smaller vec_id (null last); repeated rows are
candidates of each other; fewer candidates than k are all returned; extra columns are ignored; an empty table gives an
empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import arrow_schema, materialise

NEIGHBOURS = 20
DIMENSIONS = 8              # of the projection; even
CONFIDENCE = 0.98
SHARD_ROWS = 4096
QUERY_ROWS = 4096
LEAF_ROWS = 64


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""
    def below(x):
        return 1.0 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 20.0 * m + 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim, m]).standard_normal((dim, m))


def kd_leaves(points: np.ndarray, rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Leaves of a kd-tree that halves the widest dimension at its median row."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            leaves.append(at)
            continue
        own = points[at]
        order = np.argsort(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], kind="stable")
        half = len(at) // 2
        todo += [at[order[half:]], at[order[:half]]]
    return leaves


class ProjectedIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, m: int = DIMENSIONS, confidence: float = CONFIDENCE):
        """most: squared norm of the longest vector of the whole table."""
        self.most = most
        lift = np.sqrt(np.maximum(most - (vectors * vectors).sum(axis=1), 0.0))
        self.basis = projection(vectors.shape[1] + 1, m)
        low = vectors @ self.basis[:-1] + lift[:, None] * self.basis[-1]
        leaves = kd_leaves(low)
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.cut = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.box_low = np.array([low[x].min(axis=0) for x in leaves])
        self.box_high = np.array([low[x].max(axis=0) for x in leaves])
        self.quantile = chi_square_quantile(confidence, m)

    def search(self, query: np.ndarray, skip: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and inner products of the k best rows other than the one whose row number is skip."""
        low = query @ self.basis[:-1]
        gap = np.maximum(np.maximum(self.box_low - low, low - self.box_high), 0.0)
        near = (gap * gap).sum(axis=1)
        order = np.argsort(near, kind="stable")
        norm = float(query @ query)
        best = np.zeros(0, np.int64)
        score = np.zeros(0)
        at, step = 0, 4
        while at < len(order):
            if len(best) >= k:
                apart = max(self.most + norm - 2.0 * score[k - 1], 0.0) + 1e-7 * self.most
                if near[order[at]] > self.quantile * apart:
                    break
            rows = np.concatenate([np.arange(self.cut[i], self.cut[i + 1]) for i in order[at:at + step]])
            rows = rows[self.ids[rows, 0] != skip]
            best = np.concatenate([best, rows])
            score = np.concatenate([score, self.vectors[rows] @ query])
            keep = np.lexsort((self.ids[best, 1], -score))[:k]
            best, score = best[keep], score[keep]
            at, step = at + step, step * 2
        return best, score


def _good(name: str) -> Column:
    """Known, finite and not all zero."""
    v = F.col(name)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding",
            dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each row for which `is_query` holds."""
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"),
                                      is_query.alias("is_query"), F.col(vector_col).cast("array<double>").alias("v"))
                       .where(_good("v")).withColumn("dim", F.size("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, asked, most = rows.agg(F.count("*"), F.count_if(F.coalesce("is_query", F.lit(False))), F.max(square)).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))
    mixed = F.xxhash64("row")
    index = rows.select("dim", F.pmod(mixed, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                        "row", "vec_id", "v")
    asks = rows.where("is_query").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
        F.pmod(F.shiftright(mixed, 20), F.lit(blocks)).cast("int").alias("block"), "row", "vec_id", "v")
    schema, arrow = arrow_schema("row bigint, query_id bigint, vec_id bigint, score double")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        # a null id sorts behind all others
        ids = table.column("vec_id").fill_null(2**63 - 1).to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        return np.stack([table.column("row").to_numpy(), ids], axis=1), flat.reshape(len(ids), -1)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema_empty
        found = ProjectedIndex(*matrix(left), most, dimensions, confidence)
        ids, queries = matrix(right)
        out = [(i, *found.search(q, i[0], k)) for i, q in zip(ids, queries)]
        reps = [len(b) for _, b, _ in out]
        return pa.Table.from_arrays([
            pa.array(np.repeat(ids[:, 0], reps)), pa.array(np.repeat(ids[:, 1], reps)),
            pa.array(np.concatenate([found.ids[b, 1] for _, b, _ in out])), pa.array(np.concatenate([s for *_, s in out]))],
            schema=arrow)

    schema_empty = arrow.empty_table()
    keys = ["dim", "shard", "block"]
    met = index.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(cell, schema)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    unknown = F.lit(2**63 - 1)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select(F.nullif("query_id", unknown).alias("query_id"), "rank", F.nullif("vec_id", unknown).alias("vec_id"), "score")
