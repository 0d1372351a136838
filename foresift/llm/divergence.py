"""Source divergence audit: how far the sources of a language differ in the frequencies of its terms.

Single-pass in-memory indexing. A task builds postings (language, term) -> (source, documents, occurrences) until BLOCK_BYTES of
text fill its memory, then spills them as a run sorted by term and cut into blocks, one sequence of blocks for each hash shard.
The shards bring the blocks of all runs together in order of their first terms, and a heap merges them block by block: a term is
complete as soon as the next block starts behind it, so only blocks that overlap the current term are open. What comes out is
the index of all terms with their document and occurrence counts; terms in fewer than `min_docs` documents of a language go.

Divergence of two sources is the sum over all kept terms of f = floor((p-q)^2 / (p+q)), where p and q are smoothed frequencies
in parts of 10^9. A term absent from a source has one and the same p there, so with p0, q0 for absent terms
    sum f(p, q) = V f(p0, q0) + sum over terms of the one (f(p, q0) - f(p0, q0)) + the same for the other
                + sum over shared terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).
The first three parts need only each source's histogram of counts. The last part, the pair corrections, is streamed over the
postings and summed in each task before anything is shuffled. All arithmetic is on integers and exact.

Null texts, languages and sources count as ''. A document without terms makes its group exist and adds nothing else. Repeated
rows count as documents of their own. An empty table gives an empty result; a language without kept terms has divergences of 0.
Extra columns of any name are not read. Texts are read whole, however long.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import arrow_schema, hash_spans, materialise, release_caches

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
# bytes of text that a task holds before it spills their postings as a run, terms of a block, pairs summed before they are
# passed on, cells of one array of pairs
BLOCK_BYTES = 16_000_000
BLOCK_TERMS = 1024
PAIR_SUMS = 1_000_000
PAIR_CHUNK = 4_000_000

# every byte that belongs to no term becomes a blank, A-Z become a-z; bytes of characters beyond ASCII stay
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCKS = ("shard int, lang string, first binary, terms array<binary>, sizes array<int>, sources array<string>, docs array<int>, "
          "counts array<int>")
INDEX = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"


def words_of_block(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All term occurrences of some texts, and the number of the text that each lies in."""
    data = np.frombuffer(b" ".join(texts).translate(_FOLD), dtype=np.uint8)
    inside = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    start, end = edge[0::2], edge[1::2]
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    offsets = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.searchsorted(first, start, side="right") - 1


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def index_block(texts: list[bytes], group: np.ndarray, groups: list[tuple[str, str]], n_shards: int,
                schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The postings of some texts as one run: blocks of terms, ascending within each language and shard."""
    words, doc = words_of_block(texts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    terms = coded.dictionary
    order = pc.array_sort_indices(terms).to_numpy()
    terms = terms.take(pa.array(order))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    key, times = np.unique(doc << 32 | rank[coded.indices.to_numpy()], return_counts=True)
    doc, term = key >> 32, key & 0xFFFFFFFF
    # one posting for each language, term and group; each row so far is one document
    langs = sorted({lang for lang, _ in groups})
    lang_of = np.array([langs.index(lang) for lang, _ in groups], dtype=np.int64)
    own = group[doc]
    posting = (lang_of[own] * len(terms) + term) * len(groups) + own
    at = np.argsort(posting, kind="stable")
    posting, times = posting[at], times[at]
    start = _starts(posting)
    docs, counts = np.diff(np.append(start, len(posting))), np.add.reduceat(times, start)
    posting = posting[start]
    start = _starts(posting // len(groups))             # of each language and term
    size, entry = np.diff(np.append(start, len(posting))), posting[start] // len(groups)
    lang, term = entry // len(terms), entry % len(terms)
    buffers = terms.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int32, count=terms.offset + len(terms) + 1)[terms.offset:]
    hashed = hash_spans(np.frombuffer(buffers[2] or b"", dtype=np.uint8), ends[:-1], ends[1:])
    shard = (hashed % np.uint64(n_shards)).astype(np.int64)[term]
    by = np.lexsort((term, shard, lang))
    start, size, lang, term, shard = start[by], size[by], lang[by], term[by], shard[by]
    to = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat(start - to[:-1], size) + np.arange(to[-1])      # postings in the order of the blocks
    part = _starts(lang * n_shards + shard)
    cut = np.concatenate([np.arange(a, b, BLOCK_TERMS) for a, b in zip(part, np.append(part[1:], len(term)))])
    names = pa.array([s for _, s in groups])
    for i in range(0, len(cut), 256):
        c = np.append(cut[i:i + 256], cut[i + 256] if i + 256 < len(cut) else len(term))
        a, b = c[0], c[-1]
        p, values = flat[to[a]:to[b]], terms.take(pa.array(term[a:b]))
        of_terms, of_postings = pa.array(c - a, pa.int32()), pa.array(to[c] - to[a], pa.int32())
        columns = [pa.array(shard[c[:-1]], pa.int32()), pa.array([langs[x] for x in lang[c[:-1]]]),
                   values.take(pa.array(c[:-1] - a)), pa.ListArray.from_arrays(of_terms, values),
                   pa.ListArray.from_arrays(of_terms, pa.array(size[a:b], pa.int32())),
                   pa.ListArray.from_arrays(of_postings, names.take(pa.array(posting[p] % len(groups)))),
                   pa.ListArray.from_arrays(of_postings, pa.array(docs[p], pa.int32())),
                   pa.ListArray.from_arrays(of_postings, pa.array(counts[p], pa.int32()))]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)


def sorted_runs(docs: DataFrame, n_shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every task indexes its documents in memory and passes on term-sorted runs, cut into blocks for the shards."""
    spark_schema, schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        groups: dict[tuple[str, str], int] = {}
        texts, own, held = [], [], 0
        for batch in batches:
            for text, lang, source in zip(*[batch.column(i) for i in range(3)]):
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                own.append(groups.setdefault((lang.as_py() or "", source.as_py() or ""), len(groups)))
                held += len(texts[-1])
                if held >= block_bytes:
                    yield from index_block(texts, np.array(own), list(groups), n_shards, schema)
                    groups, texts, own, held = {}, [], [], 0
        if texts:
            yield from index_block(texts, np.array(own), list(groups), n_shards, schema)

    return docs.select("text", "lang", "source").mapInArrow(run, spark_schema)


def merge_blocks(blocks: Iterator[tuple]) -> Iterator[tuple[bytes, int, dict[str, int]]]:
    """Heap merge of blocks that come in order of their first terms: (term, documents, occurrences by source), ascending."""
    heap: list = []
    turn = 0

    def until(limit: bytes | None) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        while heap and (limit is None or heap[0][0] < limit):
            term, total, by_source = heap[0][0], 0, {}
            while heap and heap[0][0] == term:
                _, order, own = heap[0]
                terms, sizes, sources, docs, counts, at, low = own
                high = low + sizes[at]
                for i in range(low, high):
                    total += docs[i]
                    by_source[sources[i]] = by_source.get(sources[i], 0) + counts[i]
                own[5], own[6] = at + 1, high
                if at + 1 < len(terms):
                    heapq.heapreplace(heap, (terms[at + 1], order, own))
                else:
                    heapq.heappop(heap)
            yield term, total, by_source

    for first, terms, sizes, sources, docs, counts in blocks:
        yield from until(first)
        turn += 1
        heapq.heappush(heap, (first, turn, [terms, sizes, sources, docs, counts, 0, 0]))
    yield from until(None)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def term_index(docs: DataFrame, min_docs: int = MIN_DOCS, n_shards: int | None = None,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each language and term in at least `min_docs` of its documents: documents, sources and their occurrences."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_shards = n_shards or 4 * partitions
    spark_schema, schema = arrow_schema(INDEX)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        blocks = (row for batch in batches for at in range(0, batch.num_rows, 16)
                  for row in zip(*[c.to_pylist() for c in batch.slice(at, 16).columns]))
        held = []
        # a task serves several shards and languages, one after the other
        for (_, lang), own in groupby(blocks, key=lambda b: b[:2]):
            for term, total, by_source in merge_blocks(b[2:] for b in own):
                if total >= min_docs:
                    held.append([lang, term.decode("utf-8", "surrogatepass"), total, list(by_source), list(by_source.values())])
                    if len(held) == 4096:
                        yield _batch(held, schema)
                        held = []
        if held:
            yield _batch(held, schema)

    runs = sorted_runs(docs, n_shards, block_bytes).repartition(partitions, "shard")
    return runs.sortWithinPartitions("shard", "lang", "first").mapInArrow(merge, spark_schema)


def _frequency(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in decimals, since the product may exceed 64 bits."""
    wide = "decimal(38,0)"
    return F.call_function("div", F.lit(SCALE).cast(wide) * (count + 2).cast("decimal(20,0)"),
                           (total + 2 * kept).cast("decimal(20,0)")) + 1


def _distance(p: Column, q: Column) -> Column:
    """p and q are at most 10^9 + 1, so their squared difference fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


PAIRS = "lang string, source string, item string, value bigint"


def pair_corrections(postings: DataFrame) -> DataFrame:
    """Corrections of shared terms, summed over the terms of each task, for pairs with source < item.

    `postings` has a row for each term: lang, and `own`, an array of (source, p, p0). A task keeps one sum for each pair of
    sources that it has met, and passes its sums on when there are more than PAIR_SUMS.
    """
    spark_schema, schema = arrow_schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        sums: dict[str, tuple[dict, dict]] = {}       # by language: numbers of the sources, sums by pair of numbers
        for batch in batches:
            langs, own = batch.column(0).to_pylist(), batch.column(1)
            offsets = own.offsets.to_numpy()
            names, p, p0 = own.values.flatten()
            names, p, p0 = names.to_pylist(), p.to_numpy(), p0.to_numpy()
            alike: dict[tuple[str, int], list] = {}
            for i, lang in enumerate(langs):
                a, b = offsets[i], offsets[i + 1]
                number = sums.setdefault(lang, ({}, {}))[0]
                ids = np.array([number.setdefault(s, len(number)) for s in names[a:b]], dtype=np.int64)
                alike.setdefault((lang, int(b - a)), []).append((ids, p[a:b], p0[a:b]))
            for (lang, size), terms in alike.items():
                for pair, value in _corrections(size, terms):
                    total = sums.setdefault(lang, ({}, {}))[1]
                    for k, v in zip(pair, value):
                        total[k] = total.get(k, 0) + v
                    if sum(len(t) for _, t in sums.values()) > PAIR_SUMS:
                        yield from _flush(sums, schema)
                        for _, t in sums.values():
                            t.clear()
        yield from _flush(sums, schema)

    return postings.select("lang", "own").mapInArrow(run, spark_schema)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(size: int, terms: list[tuple]) -> Iterator[tuple[list, list]]:
    """Pairs of source numbers and their corrections summed over terms with equally many sources, in chunks of bounded size."""
    per_chunk = max(1, PAIR_CHUNK // (size * size))
    rows = max(1, PAIR_CHUNK // size)
    for at in range(0, len(terms), per_chunk):
        ids, p, p0 = (np.stack(x) for x in zip(*terms[at:at + per_chunk]))
        for top in range(0, size - 1, rows):
            i, j = np.nonzero(np.arange(size)[None, :] > np.arange(top, min(top + rows, size - 1))[:, None])
            i += top
            part = _f(p[:, i], p[:, j]) - _f(p[:, i], p0[:, j]) - _f(p0[:, i], p[:, j]) + _f(p0[:, i], p0[:, j])
            low, high = np.minimum(ids[:, i], ids[:, j]), np.maximum(ids[:, i], ids[:, j])
            pair, place = np.unique((low << 32 | high).ravel(), return_inverse=True)
            value = np.zeros(len(pair), dtype=np.int64)
            np.add.at(value, place.ravel(), part.ravel())
            yield pair.tolist(), value.tolist()


def _flush(sums: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lang, (number, total) in sums.items():
        of = list(number)
        if total:
            yield _batch([[lang, *sorted((of[k >> 32], of[k & 0xFFFFFFFF]), key=str.encode), v] for k, v in total.items()], schema)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair', 'term'), item, value, rank.

    Part 'pair' holds the divergence of each source from each other one of its language, all ranks; part 'term' the `top` terms
    that are more frequent in a source than in its language, by their share f of the divergence from the language.
    """
    read = docs.select("text", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")])
    index = materialise(term_index(read, min_docs).withColumn("all", F.aggregate("counts", F.lit(0).cast("bigint"),
                                                                                lambda s, x: s + x)))
    groups = read.select("lang", "source").distinct()
    kept = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("n_lang"))
    cells = index.select("lang", "term", "all", F.explode(F.arrays_zip("sources", "counts")).alias("c")) \
        .select("lang", "term", "all", F.col("c.sources").alias("source"), F.col("c.counts").alias("count"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    params = groups.join(kept, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n"])
    zero = F.when(F.col("v") > 0, _frequency(F.lit(0), F.col("n"), F.col("v"))).cast("bigint")
    params = materialise(params.withColumn("p0", zero))
    used = params.where("v > 0")
    scored = cells.join(used, ["lang", "source"]).withColumn("p", _frequency(F.col("count"), F.col("n"), F.col("v")).cast("bigint"))
    scored = materialise(scored.select("lang", "source", "term", "all", "p", "p0", "v", "n_lang"))
    return _ranked(_pairs(params, scored), "pair").unionByName(_top_terms(scored, top))


def _pairs(params: DataFrame, scored: DataFrame) -> DataFrame:
    other = params.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = params.join(other, "lang").where(F.col("source") != F.col("item"))      # each is a row of the result
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * _distance(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # a row for each source and frequency that occurs in it; the other sources are dealt out over salts, for few languages
    salts = int(params.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    histogram = scored.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms")) \
        .withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(salts)))
    met = histogram.join(other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "salt"]) \
        .where(F.col("source") != F.col("item"))
    alone = met.groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (_distance(F.col("p"), F.col("q0")) - _distance(F.col("p0"), F.col("q0")))).alias("value"))
    postings = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("own"))
    shared = pair_corrections(postings)
    columns = ["lang", "source", "item", "value"]
    turned = [x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for x in (alone, shared)]
    every = base.select(columns)
    for x in (alone, shared, *turned):
        every = every.unionByName(x.select(columns))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _top_terms(scored: DataFrame, top: int) -> DataFrame:
    q = _frequency(F.col("all"), F.col("n_lang"), F.col("v")).cast("bigint")
    more = scored.withColumn("q", q).where(F.col("p") > F.col("q"))
    value = more.select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(value, "term").where(F.col("rank") <= top)


def _ranked(values: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"),
                         F.row_number().over(w).alias("rank"))
