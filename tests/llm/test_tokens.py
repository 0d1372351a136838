from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.llm import packing as P
from foresift.llm import range_coder as R
from foresift.llm import token_store as S
from foresift.llm import tokens as K
from tests.llm.helpers import awkward, documents, empty

ODD = ["á b c \x1c d\x0be İΣ <|endoftext|>x's i'll 12ab ½ß ſ K don't", "", "  ", "tab\there\r\nx y 中文 字", "Ééanon ÀÉ é é", "a b"]


def plain(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(K.default_path())
    return [np.array(e.ids + [2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = K.encoder(K.default_path()).encode(texts)
    assert [g + b"\2\0\0\0" for g in got] == [p.tobytes() for p in plain(texts)]


def test_new_chunks_go_to_the_library_in_parts(monkeypatch):
    # the encodings of all new chunks at once left a worker larger than the cache itself
    enc, trims, sizes = K.TextEncoder(K.default_path()), [], []
    model = enc.words

    class Spy:
        def encode(self, text, **kw):
            sizes.append(text.count(" ") + 1)
            return model.encode(text, **kw)

    enc.words = Spy()
    monkeypatch.setattr(K, "trim_memory", lambda: trims.append(1))
    text = " ".join(f"{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnop")
    got = [enc.encode([text])[0] for _ in range(2 * K.TRIM_CALLS)]
    assert set(got) == {plain([text])[0][:-1].tobytes()}
    assert max(sizes) <= K.LEARN_CHUNKS < sum(sizes) and len(trims) == 2


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9000])
@pytest.mark.parametrize("kind", ["skewed", "uniform", "constant"])
def test_range_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"skewed": np.minimum(rng.zipf(1.3, n), 49000), "uniform": rng.integers(0, 1 << 17, n), "constant": np.full(n, 7)}[kind]
    coded = R.encode(ids.astype(np.int64), 17)
    assert len(coded) == -(-n // R.BLOCK)
    assert (R.decode(coded, n, 17) == ids).all()
    if kind == "constant" and n > 2048:
        assert sum(map(len, coded)) < n / 8
    if n > 2049:        # blocks are independent
        assert (R.decode(coded[1:2], R.BLOCK, 17) == ids[R.BLOCK:2 * R.BLOCK]).all()


def test_damage_is_noticed():
    ids = np.arange(5000) % 300
    data = bytearray(S.pack_file([1], [5000], ids))
    assert (S.unpack_file(bytes(data))[2] == ids).all()
    data[-50] ^= 1
    with pytest.raises(ValueError):
        S.unpack_file(bytes(data))


def check_store(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = plain([t for _, t in rows])
    start, want = 0, []
    for (name, _), p in zip(rows, ids):
        want.append((name, start, len(p), zlib.crc32(p.tobytes())))
        start += len(p)
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_token_files(spark, sf, monkeypatch):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), awkward(spark)):
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in S.token_round_trip(spark, docs).collect()]
        check_store(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert S.token_round_trip(spark, empty(spark)).count() == 0


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.pack_documents(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(rows, texts)
    used = sum(r.length for r in rows) / (4096 * len({r.sequence_id for r in rows}))
    assert used > 0.99


def check_pieces(rows, texts):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    want = {}
    for (name, _), p in zip(texts, plain([t for _, t in texts])):
        want.setdefault(name, []).append(p.tobytes())
    for name, own in pieces.items():
        if len(want[name]) == 1:
            assert b"".join(x for _, x, _ in sorted(own)) == want[name][0]
        # of rows that share an id, each piece lies at its place in one of them
        assert all(any(p[4 * start:4 * start + len(x)] == x for p in want[name]) for start, x, _ in own)
        assert sum(len(x) for _, x, _ in own) == sum(map(len, want[name]))
    assert pieces.keys() == want.keys()


def test_packing_awkward_rows(spark):
    docs = awkward(spark)
    rows = P.pack_documents(docs).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert P.pack_documents(empty(spark)).count() == 0
    digest = P.piece_digest(P.pack_documents(documents(spark, ["a b", "a b"], extra=True)))
    assert digest.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert digest.agg(F.countDistinct("sequence_id")).first()[0] == 1


def test_patterns_use_every_piece():
    rng = np.random.default_rng(5)
    for size in (10, 64, 4096):
        hist = {int(k): int(v) for k, v in zip(rng.permutation(np.arange(1, size + 1))[:200], rng.integers(1, 50, 200))}
        plan = P.plan_patterns(hist, size)
        back = {}
        for lengths, count in plan:
            assert sum(lengths) <= size
            for n in lengths:
                back[n] = back.get(n, 0) + count
        assert back == hist
    assert P.plan_patterns({}) == []
