from __future__ import annotations

import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.llm import divergence as D
from tests.llm.helpers import DOCS, awkward, clash, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs=10, top=10):
    """All groups by all kept terms in Python integers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: [t for t, n in docs[lang].items() if n >= min_docs] for lang, _ in groups}

    def freq(count, lang, n):
        return 1 + 10 ** 9 * (count + 2) // (n + 2 * len(kept[lang]))

    p, q = {}, {}
    for g in groups:
        n = sum(counts[g][t] for t in kept[g[0]])
        p[g] = {t: freq(counts[g][t], g[0], n) for t in kept[g[0]]}
    for lang in kept:
        whole = {t: sum(counts[g][t] for g in groups if g[0] == lang) for t in kept[lang]}
        n = sum(whole.values())
        q[lang] = {t: freq(whole[t], lang, n) for t in kept[lang]}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for g in groups:
        lang = g[0]
        pairs = [(h[1], sum(f(p[g][t], p[h][t]) for t in kept[lang])) for h in groups if h[0] == lang and h != g]
        terms = [(t, f(p[g][t], q[lang][t])) for t in kept[lang] if counts[g][t] and p[g][t] > q[lang][t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def check(docs, **how):
    assert rows_of(D.audit(docs, **how)) == brute([(r.text, r.lang, r.source) for r in docs.collect()], **how)


def made(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    words = ["Ab", "ab", "é", "É", "x1y2", "naïve", "z" * 400, "中文", "don't", "\U0001d4d0", "a\x00b", *(f"w{'abcdefghij'[i % 10]}{chr(97 + i // 10)}" for i in range(80))]
    langs, sources = ["en", None, "de", ""], ["s1", "s2", None, "Ä", "s\x001", "zz"]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 60)) if i % 7 else 0
        text = " ".join(words[int(w) % len(words)] for w in rng.zipf(1.3, k) - 1) if i % 11 else None
        rows.append((i // 2, text, langs[i % 4 if i % 3 else 0], sources[int(rng.integers(0, 6))], 0))
    return clash(spark.createDataFrame(rows, DOCS))


def test_made_documents_match_brute_force(spark):
    check(made(spark))
    check(made(spark, seed=1), min_docs=1, top=3)
    check(made(spark, 40, seed=2), min_docs=1000)       # no kept terms: divergences of 0


def test_given_documents_match_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_runs_and_shards_do_not_matter(spark, monkeypatch):
    docs = made(spark, seed=3)
    index = lambda **how: sorted((r.lang or "", r.term, r.docs, sorted(zip(r.sources, r.counts)))
                                 for r in D.term_index(docs.repartition(3), 2, **how).collect())
    want = index()
    assert want and index(n_shards=1, block_bytes=100) == index(n_shards=7, block_bytes=1) == want
    monkeypatch.setattr(D, "BLOCK_TERMS", 2)
    assert index(block_bytes=500) == want


def test_merge_needs_only_overlapping_blocks():
    one = (b"a", [b"a", b"c"], [1, 2], ["s", "s", "t"], [1, 1, 1], [5, 1, 2])
    two = (b"c", [b"c"], [1], ["t"], [3], [4])
    three = (b"d", [b"d"], [1], ["s"], [1], [1])
    opened = []

    def blocks():
        for b in (one, two, three):
            opened.append(b[0])
            yield b

    merged = D.merge_blocks(blocks())
    assert next(merged) == (b"a", 1, {"s": 5}) and opened == [b"a", b"c"]
    assert next(merged) == (b"c", 5, {"s": 1, "t": 6}) and next(merged) == (b"d", 1, {"s": 1})
    assert next(merged, None) is None


def test_pairs_in_chunks(spark, monkeypatch):
    want = rows_of(D.audit(made(spark), min_docs=1))
    rng = np.random.default_rng(2)
    terms = [(rng.permutation(40)[:9].astype(np.int64), rng.integers(1, 10 ** 9, 9), rng.integers(1, 100, 9)) for _ in range(30)]

    def total(chunk):
        monkeypatch.setattr(D, "PAIR_CHUNK", chunk)
        out = Counter()
        for pair, value in D._corrections(9, terms):
            for k, v in zip(pair, value):
                out[k] += v
        return out

    assert total(10) == total(100) == total(10 ** 6)
    monkeypatch.undo()
    assert rows_of(D.audit(made(spark).repartition(5), min_docs=1)) == want


@pytest.mark.parametrize("count,total,kept", [(10 ** 12, 10 ** 13, 10 ** 7), (0, 1, 1), (5, 5, 1)])
def test_large_counts_stay_exact(spark, count, total, kept):
    row = spark.range(1).select(D._frequency(F.lit(count).cast("bigint"), F.lit(total).cast("bigint"), F.lit(kept).cast("bigint"))
                                .cast("bigint").alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (count + 2) // (total + 2 * kept)


def test_awkward_rows(spark):
    check(awkward(spark), min_docs=2)
    check(awkward(spark))
    assert D.audit(empty(spark)).count() == 0


def test_sql(spark, con, sf):
    assert compare.check(spark, con, "op11_source_divergence", sf)[2] == []
