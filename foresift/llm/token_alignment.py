"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, over the whole corpus.

The tokens of either tokenizer tile the bytes of a text. Every token points to the token that reaches farthest right among those
that overlap it, in either tokenization; a token that ends where its counterpart ends points to itself. Doubling the successors
of all tokens of a slice of texts at once (p = p[p], until nothing changes) takes each to the terminal token of its component,
after as many rounds as the logarithm of the longest chain. Components are the groups between offsets at which both tokenizations
end a token. A link is a pair of tokens that end together: the last tokens of a group.

Links are counted per pair of ids over the corpus: each text passes on its distinct pairs with their numbers, tasks sum them
before the shuffle. Of two tokens that end together, the bytes of one end with the bytes of the other, so the number of different
pairs is bounded by the two vocabularies (`pair_bound`, 324,302 for the given files) however large the corpus is: the table of
counts may go to every task, and documents need no shuffle to look up their links.

Null and empty texts, and texts whose tokens do not join to exactly a blank and the text, have no tokens: counts of 0 and an
empty digest. Rows are aligned one by one: repeated rows each count, any or no doc_id will do, extra columns of any name do not
matter, and an empty table gives an empty result. Texts are encoded whole, however long.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foresift.llm.common import arrow_schema, materialise, release_caches

# texts and bytes of text that are aligned at once
SLICE_ROWS = 256
SLICE_BYTES = 2_000_000
# pairs that a task sums before it passes them on
PAIR_SUMS = 1_000_000

# the split pattern of a byte-level vocabulary, as its library fixes it
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[tuple[str, str], "Tokenizers"] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the decimal numbers of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocabulary = _byte_alphabet(), self.a.get_vocab()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.ranks = self._rank_encoder(spec, {self.bytes_a[i]: i for t, i in vocabulary.items() if t not in special})
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))]
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.lengths = np.array([*map(len, self.bytes_a), *map(len, self.bytes_b)], dtype=np.int64)
        self.numbers = np.array([*map(str, range(self.n_a)), *map(str, range(self.n_b))], dtype="S")

    @staticmethod
    def _rank_encoder(spec: dict, ranks: dict[bytes, int]):
        """A faster encoder of the same vocabulary, where its ids follow the order of its merges; else none."""
        cut = spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        ids = [spec["model"]["vocab"]["".join(m)] for m in merges]
        plain = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                 and not spec.get("normalizer") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges"))
        if not plain or ids != sorted(ids) or len(ids) + 256 != len(ranks):
            return None
        import tiktoken
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers. Texts beyond plain Latin go through the library of a, others through its ranks."""
        fast = [self.ranks is not None and (not t or max(t) < "\u0250") for t in texts]
        slow = iter(self.a.encode_batch_fast([" " + t for t, f in zip(texts, fast) if not f], add_special_tokens=False))
        a = [self.ranks.encode_ordinary(" " + t) if f else next(slow).ids for t, f in zip(texts, fast)]
        return a, self.b.encode(texts, num_threads=1)

    def pair_bound(self) -> int:
        """Pairs of ids of which one's bytes end with the other's."""
        a, b = Counter(self.bytes_a), Counter(self.bytes_b)
        return (sum(b[x[k:]] for x in self.bytes_a for k in range(len(x)))
                + sum(a[x[k:]] for x in self.bytes_b for k in range(1, len(x))))


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair of tokenizers for each worker process."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def farthest_overlap(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Successor of every token (those of a, then those of b) of two tilings of the same bytes."""
    n = int(end_a[-1]) + 1
    # tokens that end before a byte: as many come before the last token that starts before it
    last_b = np.cumsum(np.bincount(end_b, minlength=n))[end_a - 1]
    last_a = np.cumsum(np.bincount(end_a, minlength=n))[end_b - 1]
    # of two tokens that end together, that of a is the terminal one
    to_b = np.where(end_b[last_b] == end_a, np.arange(len(end_a)), len(end_a) + last_b)
    return np.concatenate([to_b, last_a])


def terminals(successor: np.ndarray) -> np.ndarray:
    """Terminal token of each token's chain, by pointer jumping."""
    while True:
        farther = successor[successor]
        if (farther == successor).all():
            return successor
        successor = farther


def align(a: np.ndarray, b: np.ndarray, tok: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token of a and of b, ascending from 0, and the places in b of the last tokens of the groups."""
    end_a, end_b = np.cumsum(tok.lengths[a]), np.cumsum(tok.lengths[tok.n_a + b])
    last = terminals(farthest_overlap(end_a, end_b))
    head = last[:len(a)] == np.arange(len(a))           # terminal tokens are tokens of a, in the order of their groups
    group = (np.cumsum(head) - 1)[last]
    group_b = group[len(a):]
    return group[:len(a)], group_b, np.flatnonzero(np.append(group_b[1:] != group_b[:-1], True))


def digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends: list[tuple[int, int]],
            tok: Tokenizers) -> list[str]:
    """SHA-256 of the groups of each text as text; `ends` has the numbers of tokens of a and b up to the end of each text."""
    n = len(a) + len(b)
    # the tokens of a group: first those of a, then those of b
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
    token, mark = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.uint8)
    token[place_a], token[place_b] = a, tok.n_a + b
    mark[place_a] = np.where(np.append(group_a[1:], -1) == group_a, ord(","), ord("|"))
    mark[place_b] = np.where(np.append(group_b[1:], -1) == group_b, ord(","), ord(";"))
    width = tok.numbers.dtype.itemsize
    cells = np.zeros((n, width + 1), dtype=np.uint8)
    cells[:, :width] = tok.numbers[token].view(np.uint8).reshape(n, width)
    used = cells != 0
    size = used.sum(axis=1)
    cells[np.arange(n), size], used[np.arange(n), size] = mark, True
    joined, to = cells[used].tobytes(), np.cumsum(size + 1)
    out, low = [], 0
    for upto_a, upto_b in ends:
        high = int(to[upto_a + upto_b - 1]) if upto_a + upto_b else 0
        out.append(hashlib.sha256(joined[low:high - 1]).hexdigest() if high > low else "")
        low = max(low, high)
    return out


def align_slice(texts: list[str | None], tok: Tokenizers) -> list[list]:
    """Columns n_a, n_b, n_groups, groups_sha256, and the distinct links (a * n_b + b) with their numbers, of some texts."""
    ids = [[], []]
    whole: list[tuple] = []
    given = [t or "" for t in texts]
    for text, a, b in zip(given, *tok.encode(given)):
        want = b" " + text.encode("utf-8", "surrogatepass")
        same = bool(text) and all(b"".join(map(names.__getitem__, own)) == want
                                  for own, names in ((a, tok.bytes_a), (b, tok.bytes_b)))
        whole.append((a, b) if same else ((), ()))
        ids[0] += whole[-1][0]
        ids[1] += whole[-1][1]
    a, b = (np.array(x, dtype=np.int64) for x in ids)
    sizes = np.array([(len(x), len(y)) for x, y in whole], dtype=np.int64)
    ends = np.cumsum(sizes, axis=0)
    if not len(a):
        return [[0] * len(texts), [0] * len(texts), [0] * len(texts), [""] * len(texts), [b""] * len(texts), [b""] * len(texts)]
    # the texts of a slice lie one behind the other: both tokenizations end at the end of each
    group_a, group_b, linked_b = align(a, b, tok)
    linked_a = np.flatnonzero(np.append(group_a[1:] != group_a[:-1], True))
    link = a[linked_a] * tok.n_b + b[linked_b]
    text = np.searchsorted(ends[:, 0], linked_a, side="right")
    key, times = np.unique(text * (tok.n_a * tok.n_b) + link, return_counts=True)
    of, key = key // (tok.n_a * tok.n_b), (key % (tok.n_a * tok.n_b)).astype("<u8")
    cut = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    times = times.astype("<u4")
    keys = [key[x:y].tobytes() for x, y in zip(cut, cut[1:])]
    return [sizes[:, 0].tolist(), sizes[:, 1].tolist(), np.bincount(text, minlength=len(texts)).tolist(),
            digests(a, b, group_a, group_b, ends.tolist(), tok), keys, [times[x:y].tobytes() for x, y in zip(cut, cut[1:])]]


ALIGNED = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")] + [
    T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType()), T.StructField("times", T.BinaryType())]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i + 1 - low >= SLICE_ROWS or size >= SLICE_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def align_texts(docs: DataFrame, paths: tuple[str, str] | None = None, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep` as k0, k1, ..., the alignment of each text, and its distinct links with their numbers."""
    path_a, path_b = paths or default_paths()
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    spark_schema = T.StructType([*rows.schema.fields[1:], *ALIGNED])
    schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        tok = tokenizers(path_a, path_b)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in _slices(texts):
                out = [pa.array(v, type=f.type) for v, f in zip(align_slice(texts[low:high], tok), list(schema)[-len(ALIGNED):])]
                kept = [c.cast(f.type) for c, f in zip(batch.slice(low, high - low).columns[1:], schema)]
                yield pa.RecordBatch.from_arrays([*kept, *out], schema=schema)

    return rows.mapInArrow(run, spark_schema)


def _joined(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, n: how often each pair of ids is linked, over all texts."""
    spark_schema, schema = arrow_schema("link bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            link, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(link, kind="stable")
            link, n = link[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], link[1:] != link[:-1]]))
            return link[start], np.add.reduceat(n, start)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in summed()], schema=schema)

        for batch in batches:
            link, n = _joined(batch.column(0), "<u8"), _joined(batch.column(1), "<u4").astype(np.int64)
            if len(link):
                held.append((link, n))
            if sum(len(x) for x, _ in held) > PAIR_SUMS:
                held = [summed()]
                if len(held[0][0]) > PAIR_SUMS:
                    yield out()
                    held = []
        if held:
            yield out()

    return aligned.select("links", "times").mapInArrow(run, spark_schema).groupBy("link").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, keep=("doc_id",), paths: tuple[str, str] | None = None, text: str = "text") -> DataFrame:
    """Columns `keep`, then n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text.

    n_best counts the links whose count is the highest of their b id in the corpus, count_sum adds up the counts of all links.
    """
    paths = paths or default_paths()
    tok = tokenizers(*paths)
    aligned = materialise(align_texts(docs, paths, keep, text))
    counts = link_counts(aligned)
    # at most pair_bound() rows, whatever the corpus
    got = counts.toArrow()
    if got.num_rows > tok.pair_bound():
        raise RuntimeError("more pairs of ids than the vocabularies allow")
    link, n = got["link"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(link)
    link, n = link[order], n[order]
    top = np.zeros(tok.n_b, dtype=np.int64)
    np.maximum.at(top, link % tok.n_b, n)
    shared = docs.sparkSession.sparkContext.broadcast((link, n, n == top[link % tok.n_b]))
    numbers = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    spark_schema = T.StructType([*aligned.schema.fields[:len(keep)], *numbers, T.StructField("groups_sha256", T.StringType())])
    schema = to_arrow_schema(spark_schema)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        link, count, best = shared.value
        for batch in batches:
            *kept, n_a, n_b, n_groups, digest, links, times = batch.columns
            own, n = _joined(links, "<u8").astype(np.int64), _joined(times, "<u4").astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in links.to_pylist()])
            at = np.searchsorted(link, own)
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3)]
            for total, value in zip(sums, (n, n * best[at] if len(own) else n, n * count[at] if len(own) else n)):
                np.add.at(total, row, value)
            columns = [*kept[:n_keep], n_a, n_b, n_groups, *map(pa.array, sums), digest]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    out = aligned.mapInArrow(run, spark_schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[n_keep:])
