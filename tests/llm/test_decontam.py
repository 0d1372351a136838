from __future__ import annotations

import numpy as np

from foresift.llm import decontam as D
from tests.llm.helpers import awkward, clash, documents, empty

ITEMS = "item_id bigint, text string"


def brute_scores(index, text):
    """BM25 of every item for the distinct terms of a passage, as a share of its own score."""
    terms = {t for t in index.numbers(text).tolist() if t >= 0}
    scores = {}
    for t in terms:
        for item, v in zip(*index.lists[t][:2]):
            scores[item] = scores.get(item, 0.0) + v
    return scores


def test_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, rng.integers(3, 30)))) for i in range(300)]
    for threshold in (0.2, 0.5, 0.8):
        index = D.ItemIndex(items, threshold)
        for _ in range(60):
            text = " ".join(rng.choice(words, rng.integers(1, 40)))
            terms = sorted({t for t in index.numbers(text).tolist() if t >= 0})
            want = {i: s for i, s in brute_scores(index, text).items() if s >= threshold - 1e-9}
            got = dict(index.wand(terms))
            assert got.keys() == want.keys()
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_bounds_never_drop_a_passage():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(100)]
    index = D.ItemIndex(items, 0.6, 0.0)
    index_all = D.ItemIndex(items, 0.6, 0.0)
    index_all._hopeful = lambda half, term: np.arange(int(half[-1]) + 1)
    for _ in range(20):
        text = " ".join(rng.choice(words, 400)) + " " + items[rng.integers(100)][1]
        assert index.search(text) == index_all.search(text)


def test_given_documents(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    items = bench.collect()
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if b.text in d.text}
    assert want and got == want
    kept = {r.doc_id for r in D.drop_leaks(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_awkward_rows(spark, monkeypatch):
    item = "What is the colour of the quiet seventh lantern over the old harbour? It is a deep cobalt blue with amber edges."
    bench = clash(spark.createDataFrame([(0, None), (1, ""), (2, "...."), (3, item), (3, item), (4, item)], ITEMS))
    near = item.replace("quiet ", "").upper()
    docs = documents(spark, [None, "", "filler " * 5000 + item + " filler" * 5000, near, "clean words only here", item[:60]], extra=True)
    for shard in (2048, 2):
        monkeypatch.setattr(D.item_shards, "__defaults__", ("item_id", "text", shard))
        rows = D.find_leaks(docs, bench).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(2, 3), (2, 3), (2, 4), (3, 3), (3, 3), (3, 4)]
        assert sorted(r.doc_id for r in D.drop_leaks(docs, bench).collect()) == [0, 1, 4, 5]
    assert D.find_leaks(empty(spark), bench).count() == 0
    nothing = spark.createDataFrame([], ITEMS)
    assert D.find_leaks(docs, nothing).count() == 0
    assert D.drop_leaks(awkward(spark), nothing).count() == 8


def test_results_do_not_depend_on_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(rng.choice(words, 20)) + ". " + " ".join(rng.choice(words, 10)) + "." for _ in range(40)]
    texts.append(" ".join(f"long{i}" for i in range(3000)) + ".")
    bench = spark.createDataFrame(list(enumerate(texts)), ITEMS)
    docs = []
    for t in texts[:40]:
        kept = [w if rng.random() > 0.12 else "changed" for w in t.split()]
        docs.append(" ".join(rng.choice(words, 50)) + " " + " ".join(kept))
    # the words of an item, in two halves of its trigrams far apart, are no copy of it
    w = texts[7].split()
    pieces = [w[:8], w[8:16], w[16:24], w[24:]]
    docs.append((" filler" * 300).join(" " + " ".join(p) for p in pieces))
    docs = documents(spark, docs)
    seen = []
    for shard in (2048, 10, 3):
        monkeypatch.setattr(D.item_shards, "__defaults__", ("item_id", "text", shard))
        seen.append(sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in D.find_leaks(docs, bench).collect()))
    assert seen[0] and seen[0] == seen[1] == seen[2]
    assert all(d != 40 for d, *_ in seen[0])


def test_near_copies_with_another_end(spark):
    rng = np.random.default_rng(9)
    body = [". ".join(" ".join(f"w{k}" for k in rng.integers(0, 400, 14)) for _ in range(3)) for _ in range(4)]
    items = [f"{body[0]}. B.", f"{body[1]}. Not one sank.", f"Why? {body[2].replace('. ', ' ')}.",
             f"{body[3]}. All of those ships came back to the harbour in autumn."]
    texts = [f"{body[0]}. C.", f"{body[0]}.", f"{body[1]}. Not one", f"How? {body[2].replace('. ', ' ')}.",
             f"{body[3]}. All of those ships came back to the harbour in winter.", "B. Not one sank. Why? " + body[3][:40],
             f"{body[3]}."]
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    found = sorted((r.doc_id, r.item_id) for r in D.find_leaks(documents(spark, texts), bench).collect())
    # an answer of some length that is missing is no leak of its item
    assert found == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted(r.doc_id for r in D.drop_leaks(documents(spark, texts), bench).collect()) == [5, 6]
