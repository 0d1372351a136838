"""Similarity join on word n-grams by parity sketches (operator 9).

The shingle set of a document toggles one bit for each shingle in a sketch of p parts; a part is wide and sparse, so it is
kept as the exclusive or of 64-bit names of its bits, and equal words mean equal parts. Bits that differ are never more than
the shingles in which two sets differ, so two sets within a symmetric difference of T differ in at most T parts and share one
of p > T (pigeonhole). Sets of n shingles can only link with sets of at most n / 0.8: sizes fall into bands, a set sends
its parts to its own band and the next, and T = (a + b) / 9 follows from the largest sizes of the band. Empty parts are sent
only by the few sets that have no more than T parts with shingles; of a pair whose equal parts are all empty, both do so.

Keys are dealt into buckets of bounded size, sorted in arrays, and only keys that several sets share leave the bucket. More
parts than T + 1 make sure that linked sets share several keys, so each set may drop its most frequent ones (one less than it
surely shares): the rarest shared key is dropped by neither. This rids the join of keys that a common passage makes, and of
all sets that share too few. Of each key's sets, all are paired with the one that has the most shared keys and with the first; pairs are verified by a short
sketch of which the differing bits are never more than the differing shingles, then on whole texts. Where a key's sets are then still in several components, the pairs across components are verified as well, so no link
between components is lost, while a group of near copies costs two pairs a document. A key that is frequent within one slice
of rows is combined there before the shuffle. Equal sets are one node throughout.

Defined cases: a null text or one without words has an empty set, links with nothing and is its own component; fewer words
than the width make one shingle; repeated rows are one node; rows with a null id report their size, link with nothing and
have a null component; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import arrow_schema, map_rows, materialise, mix64, release_caches, shingle_set
from foresift.llm.components import connected_components

WIDTH = 5
BUCKET_KEYS = 2_000_000         # keys in a bucket, about
SLICE = 2048                    # rows whose keys are dealt out together
HOT_IN_SLICE = 64               # sets of one slice that share a key and are combined before the shuffle
HOT_WEIGHT = 1 << 40            # of keys that are combined in some slice
WORDS = 16                      # 64-bit words of the short parity sketch that pairs are compared by before their texts
NUM, DEN = 80, 100              # links: DEN * intersection >= NUM * union
_U = np.uint64


def reach(n: int) -> int:
    """Largest set that a set of n can link with."""
    return n * DEN // NUM


def most_apart(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


class Bands:
    """Bounds of the size bands, grown as needed: what a set of one band can link with is in that band or the next."""

    def __init__(self):
        self.low = [1, 2]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, reach(self.low[-1] - 1) + 1))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def top(self, band: int) -> int:
        while len(self.low) < band + 2:
            self.of(self.low[-1])
        return self.low[band + 1] - 1


_bands = Bands()


def parts_of(band: int) -> int:
    top = _bands.top(band)
    return most_apart(top, top) * 2 + 4


@dataclass
class Sketch:
    keys: np.ndarray            # 64-bit keys of the parts sent to both bands
    shared: int                 # parts with shingles that any partner shares at least, in either band


def sketch(shingles: np.ndarray) -> Sketch:
    n = len(shingles)
    own = _bands.of(n)
    keys, shared = [], []
    for band in (own, own + 1):
        top, p = _bands.top(band), parts_of(band)
        if band > own and reach(n) < _bands.low[band]:
            continue                        # no partner of the next band is near enough
        salt = _U(band * 2654435761 + 1)
        part = ((shingles >> _U(32)) * _U(p)) >> _U(32)
        words = np.zeros(p, np.uint64)
        np.bitwise_xor.at(words, part.astype(np.int64), mix64(shingles ^ salt))
        full = np.bincount(part.astype(np.int64), minlength=p) > 0
        sure = int(full.sum()) - most_apart(n, min(top, reach(n)))
        shared.append(max(sure, 0))
        if sure >= 1:
            keys.append(mix64(words[full] + np.flatnonzero(full).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + salt))
        else:
            keys.append(mix64(words + np.arange(p, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + salt))
    return Sketch(np.concatenate(keys), min(shared))


def parity_words(shingles: np.ndarray) -> np.ndarray:
    """The short sketch: one bit toggled for each shingle, as signed 64-bit words."""
    at = (mix64(shingles ^ _U(0x5851F42D4C957F2D)) & _U(64 * WORDS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


SKETCH = [f"w{i}" for i in range(WORDS)]


def may_link(n_a: str, n_b: str, a: str, b: str) -> Column:
    """Sizes and sketches that linked sets can have: differing bits are never more than differing shingles."""
    apart = " + ".join(f"bit_count({a}{i} ^ {b}{i})" for i in range(WORDS))
    return F.expr(f"least({n_a}, {n_b}) * {DEN} >= greatest({n_a}, {n_b}) * {NUM} AND "
                  f"{apart} <= ({n_a} + {n_b}) * {DEN - NUM} div {DEN + NUM}")


def node_of(shingles: np.ndarray) -> int:
    """Name of a shingle set: equal sets have equal names."""
    with np.errstate(over="ignore"):
        a, b = mix64(shingles).sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles)
        return int(mix64(np.array([a + mix64(np.array([b]))[0] * _U(3) + _U(len(shingles))]))[0].astype(np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, node and the parts that partners surely share."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(cols):
            sizes, nodes, shared, words = [], [], [], []
            for name, text in zip(*cols):
                s = shingle_set(text, WIDTH)
                sizes.append(len(s))
                linked = len(s) > 0 and name is not None
                nodes.append(node_of(s) if linked else None)
                shared.append(sketch(s).shared if linked else None)
                words.append(parity_words(s).tolist() if linked else [None] * WORDS)
            return [cols[0], sizes, nodes, shared, *(list(c) for c in zip(*words))]
        return run

    ddl = f"{id_col} {kind}, n_shingles bigint, node bigint, shared int, " + ", ".join(f"{w} bigint" for w in SKETCH)
    return map_rows(docs, [id_col, text_col], ddl, make)


def _deal(keys, nodes, buckets, lane, hot):
    """Rows (bucket, lane, hot, keys, nodes, counts) of one slice."""
    bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, nodes = bucket[order], keys[order], nodes[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        at = np.flatnonzero(np.diff(nodes[a:b], prepend=nodes[a] - 1 if nodes[a] > -2**63 else 0))
        if not len(at) or at[0]:
            at = np.append(0, at)
        count = np.diff(np.append(at, b - a))
        yield (int(bucket[a]), lane, hot, (keys[a:b] & _U(0xFFFFFFFF)).astype("<u4").tobytes(), nodes[a:b][at].tobytes(),
               count.astype("<u4").tobytes())


def dealt_keys(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Keys of all sets by bucket. Lane -1 has what meets in the bucket; other lanes pass on what a slice has combined."""
    schema, arrow = arrow_schema("bucket int, lane bigint, hot boolean, keys binary, nodes binary, counts binary")

    def rows_of(texts, lane):
        keys, nodes, done = [], [], set()
        for text in texts:
            s = shingle_set(text, WIDTH)
            if not len(s):
                continue
            node = node_of(s)
            if node not in done:
                done.add(node)
                k = sketch(s).keys
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
        if not keys:
            return
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        value, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        hot = (count > HOT_IN_SLICE)[inverse]
        if hot.any():
            k, nd = keys[hot], nodes[hot]
            order = np.lexsort((nd, k))
            k, nd = k[order], nd[order]
            first = np.flatnonzero(np.diff(k, prepend=k[0] - _U(1)) != 0)
            full = ((k >> _U(32)) * _U(buckets) >> _U(32) << _U(32) | k & _U(0xFFFFFFFF)).astype(np.int64)
            yield (int(k[0] % _U(buckets)), lane, True, full.tobytes(), nd.tobytes(), b"")
            yield from _deal(k[first], nd[first], buckets, -1, True)
        yield from _deal(keys[~hot], nodes[~hot], buckets, -1, False)

    def run(batches):
        release_caches()
        lane = TaskContext.get().partitionId() << 20
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = list(rows_of(batch.column(0).slice(at, SLICE).to_pylist(), lane))
                lane += 1
                for i in range(0, len(rows), 64):
                    cols = list(zip(*rows[i:i + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return docs.where(F.col(id_col).isNotNull()).select(text_col).mapInArrow(run, schema)


def _shared_keys(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """(key, node, weight) of the keys of a bucket that several sets have; the weight orders keys by frequency."""
    cols = {c: table.column(c).to_pylist() for c in ("bucket", "lane", "hot", "keys", "nodes", "counts")}
    if cols["lane"][0] >= 0:
        key = np.concatenate([np.frombuffer(k, np.int64) for k in cols["keys"]])
        nodes = np.concatenate([np.frombuffer(n, np.int64) for n in cols["nodes"]])
        return pa.Table.from_arrays([pa.array(key), pa.array(nodes), pa.array(np.full(len(key), HOT_WEIGHT))], schema=schema)
    keys = np.concatenate([np.frombuffer(k, "<u4") for k in cols["keys"]])
    nodes = np.concatenate([np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, "<u4"))
                            for n, c in zip(cols["nodes"], cols["counts"])])
    hot = np.concatenate([np.full(len(k) // 4, h, bool) for k, h in zip(cols["keys"], cols["hot"])])
    # keys that stand alone are the most; they go before the sort by node
    order = np.argsort(keys, kind="stable")
    if len(order) > 1:
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]
    else:
        order = order[:0]
    keys, nodes, hot = keys[order], nodes[order], hot[order]
    order = np.lexsort((nodes, keys))
    keys, nodes, hot = keys[order], nodes[order], hot[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    at = np.flatnonzero(new)
    hot = np.logical_or.reduceat(hot, at) if len(at) else hot
    keys, nodes = keys[at], nodes[at]
    first = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
    size = np.diff(np.append(first, len(keys)))
    weight = np.where(np.logical_or.reduceat(hot, first), HOT_WEIGHT, size) if len(first) else size
    keep = np.repeat(size > 1, size)
    full = np.int64(cols["bucket"][0]) << 32 | keys.astype(np.int64)
    return pa.Table.from_arrays([pa.array(full[keep]), pa.array(nodes[keep]), pa.array(np.repeat(weight, size)[keep])],
                                schema=schema)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and DEN * common >= NUM * (len(a) + len(b) - common)


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts link. `nodes` has a document of each node."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    one, two = (nodes.select(F.col("node").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"),
                             *[F.col(w).alias(f"{x}{w[1:]}") for w in SKETCH]) for x in "ab")
    sized = materialise(pairs.join(one, "a").join(two, "b").where(may_link("n_a", "n_b", "a", "b"))
                        .select("a", "b", "doc_a", "doc_b"))
    left = texts.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b"))
    rows = sized.join(left, "doc_a").join(right, "doc_b")

    def make():
        known: dict[int, np.ndarray] = {}

        def shingles(node, text):
            if node not in known:
                if len(known) > 256:
                    known.clear()
                s = shingle_set(text, WIDTH)
                if node_of(s) != node:          # another text under the same id
                    return None
                known[node] = s
            return known[node]

        def run(cols):
            keep = []
            for a, b, x, y in zip(*cols):
                s, t = shingles(a, x), shingles(b, y)
                if s is not None and t is not None and similar(s, t):
                    keep.append((a, b))
            return [list(c) for c in zip(*keep)] if keep else [[], []]
        return run

    return map_rows(rows, ["a", "b", "text_a", "text_b"], "a bigint, b bigint", make)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id that links reach) of every row."""
    sizes = materialise(signatures(docs, id_col, text_col))
    linked = sizes.where(F.col("node").isNotNull())
    nodes = materialise(linked.groupBy("node").agg(F.min(id_col).alias("doc"), F.first("n_shingles").alias("n"),
                                                   F.first("shared").alias("shared"), *[F.first(w).alias(w) for w in SKETCH]))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * 0.7) // BUCKET_KEYS)
    schema, arrow = arrow_schema("key bigint, node bigint, weight bigint")

    def in_bucket(table: pa.Table) -> pa.Table:
        return _shared_keys(table, arrow)

    met = dealt_keys(docs, buckets, id_col, text_col).groupBy("bucket", "lane").applyInArrow(in_bucket, schema).distinct()
    # linked sets share `shared` keys at least, and the rarest of them survives when each set drops that many less one
    common_first = Window.partitionBy("node").orderBy(F.desc("weight"), "key")
    kept = materialise(met.join(nodes.select("node", "n", "shared"), "node").withColumn("place", F.row_number().over(common_first))
                       .withColumn("keys", F.count("*").over(Window.partitionBy("node"))).where("place >= shared")
                       .select("key", "node", "n", "keys"))
    # the set with the most shared keys is the likeliest centre of a group of near copies
    ends = kept.groupBy("key").agg(F.max(F.struct("keys", "node"))["node"].alias("hub"), F.min("node").alias("low"),
                                   F.max("node").alias("high")).where("low < high")
    star = kept.join(ends, "key")
    pairs = star.select(F.explode(F.array("hub", "low")).alias("end"), "node").where("end <> node") \
        .select(F.least("end", "node").alias("a"), F.greatest("end", "node").alias("b")).distinct()
    links = materialise(verify(pairs, nodes, docs, id_col, text_col))
    labels = connected_components(links)
    # keys whose sets are still in several components
    named = kept.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_ = materialise(named.join(split, "key").join(nodes.select("node", *SKETCH), "node"))
    one, two = (open_.select("key", F.col("node").alias(f"node_{x}"), F.col("label").alias(f"label_{x}"), F.col("n").alias(f"n_{x}"),
                             *[F.col(w).alias(f"{x}{w[1:]}") for w in SKETCH]) for x in "ab")
    near = (one["key"] == two["key"]) & (F.col("label_a") < F.col("label_b")) & may_link("n_a", "n_b", "a", "b")
    across = one.join(two, near).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")) \
        .distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialise(verify(across, nodes, docs, id_col, text_col))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    # a row per set, stored: the join below is plain, so Spark may split the partition of a hot set
    named = nodes.select("node", "doc").join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    least = named.groupBy("part").agg(F.min("doc").alias("component_id"))
    placed = materialise(named.join(least, "part").select("node", "component_id"))
    return sizes.select(id_col, "n_shingles", "node").join(placed, "node", "left") \
        .select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id"))
