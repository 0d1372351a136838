from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foresift.llm import token_alignment as A
from tests.llm.helpers import awkward, documents, empty

ODD = ["<|endoftext|> a<s>b</s> <unk>", "tab\there  two   blanks\r\n\n x", "▁ lower one eighth", "中文 字 naïve ﬁ Å", "é", " ", "\n", "a" * 3000,
       "don't I'LL we've 12345 3.14 --- ***", "\x00\x1c\x1f\x85\xa0 x y", "İΣ ſ K ½ß \U0001f600\U0001f468‍\U0001f469", "ﷺ <0x41>", "x­ y"]


@pytest.fixture(scope="module")
def tok():
    return A.tokenizers(*A.default_paths())


def library_ids(tok, text):
    """Ids by the two libraries alone."""
    return tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)


def brute(tok, text):
    """Ids, groups and links of one text by scanning the byte offsets."""
    if not text:
        return [], [], [], []
    a, b = library_ids(tok, text)
    want = b" " + text.encode()
    if b"".join(tok.bytes_a[i] for i in a) != want or b"".join(tok.bytes_b[i] for i in b) != want:
        return [], [], [], []
    cut_a, cut_b = np.cumsum([len(tok.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(tok.bytes_b[i]) for i in b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for c in sorted(set(cut_a) & set(cut_b)):
        p, q = cut_a.index(c, i) + 1, cut_b.index(c, j) + 1
        groups.append((a[i:p], b[j:q]))
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return a, b, groups, links


def brute_table(tok, texts):
    all_of = [brute(tok, t) for t in texts]
    counts = Counter(x for *_, links in all_of for x in links)
    top: Counter = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    for a, b, groups, links in all_of:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
               hashlib.sha256(text.encode()).hexdigest() if text else "")


def values(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_given_and_odd_texts_match_brute_force(spark, sf, tok):
    texts = ODD + [None, "", *[r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]]
    docs = documents(spark, texts, extra=True)
    assert values(A.align_documents(docs).orderBy("doc_id").collect()) == list(brute_table(tok, texts))


def test_rank_encoder_equals_the_library(tok):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x250) if chr(c).isprintable() or c < 0xA1]
    texts = ["".join(rng.choices(letters + [" ", " ", "a", "e", "'", "s", "1"] * 40, k=200)) for _ in range(300)] + ODD
    assert tok.ranks is not None
    assert tok.encode(texts)[0] == [library_ids(tok, t)[0] for t in texts]


def test_pointer_jumping_on_long_chains():
    # tokens of 2 bytes against tokens of 2 bytes shifted by one: a single group, and the chain runs through all of it
    n = 5000
    end_a, end_b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    last = A.terminals(A.farthest_overlap(end_a, end_b))
    assert (last == n - 1).all()
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(2, 60))
        cuts = [np.append(np.flatnonzero(rng.random(size - 1) < p) + 1, size) for p in (0.3, 0.5)]
        last = A.terminals(A.farthest_overlap(*cuts))
        common = np.intersect1d(*cuts)
        want = np.concatenate([np.searchsorted(common, c) for c in cuts])
        assert (np.searchsorted(common, cuts[0][last]) == want).all()


def test_counts_are_bounded_by_the_vocabularies(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = A.link_counts(A.align_texts(docs)).collect()
    assert len({r.link for r in counts}) == len(counts) < tok.pair_bound() == 324302
    for r in counts:
        a, b = tok.bytes_a[r.link // tok.n_b], tok.bytes_b[r.link % tok.n_b]
        assert a.endswith(b) or b.endswith(a)


def test_slices_do_not_matter(spark, tok, monkeypatch):
    texts = (ODD + [None, "plain words here"]) * 3
    want = A.align_slice(texts, tok)
    parts = [A.align_slice(texts[i:i + 4], tok) for i in range(0, len(texts), 4)]
    assert [[v for p in parts for v in p[c]] for c in range(len(want))] == want


def test_awkward_rows(spark, tok):
    docs = awkward(spark)
    rows = docs.collect()
    out = A.align_documents(docs, keep=docs.columns)
    assert out.columns[:len(docs.columns)] == docs.columns
    want = Counter((r.doc_id, *v) for r, v in zip(rows, brute_table(tok, [r.text for r in rows])))
    got = out.collect()
    assert Counter((r.doc_id, *v) for r, v in zip(got, values(got))) == want
    assert A.align_documents(empty(spark)).count() == 0
    long = "supercalifragilistic" * 50_000
    assert values(A.align_documents(documents(spark, [long])).collect())[0][0] > 1000
