"""Benchmark decontamination (operator 6): BM25 over test items, searched by block-max WAND with every training passage.

An inverted index of the items holds BM25 impacts, divided by the score that an item has with all of its own words, so one
threshold serves all items; each posting list carries its maximum and the maxima of its blocks. For each class of items
with lengths up to 32, 64, 128 and so on words, a document is cut into overlapping passages that are twice that long and start
every half of it, so that each occurrence of an item lies whole in one of them. Maxima of its terms over ranges of items, summed, bound the score of a passage; passages below the threshold in every
range can hold no result, the others go through block-max WAND, which finds every item at or above it. An item counts as leaked
when at least half of the word trigrams of its question and of its answer (its last sentence) stand in the passage; where one of
the two has under `LEAST_WORDS` words, the whole item takes the place of both.

Items are indexed in shards of `SHARD_ITEMS`, which bounds what is broadcast; every shard sees all documents. Document
frequencies, number and mean length of the items are those of all items, so results do not depend on the shards.
Defined cases: null or empty texts and items have no hits; equal items are all reported; repeated documents are each
reported; texts count whole; extra columns are ignored; empty tables give an empty result. Words are runs of a-z, 0-9 and
characters above 7F (hexadecimal) after A-Z is lower-cased.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import hash_spans, lower_bytes, map_rows, materialise, spans_of

SHARD_ITEMS = 2048
SHORT_WORDS = 32                # words of the items of the shortest length class
THRESHOLD = 0.75                # share of an item's own score
LEAST_WORDS = 8                 # of question and answer: so many that one changed word leaves half of the trigrams
OVERLAP = 0.5                   # share of trigrams of question and answer
K1, B = 1.2, 0.75
BLOCK_POSTINGS = 16
ITEM_BLOCKS = 64                # ranges of items with a maximum of their own for each term
HALVES = 512                    # half passages that are bounded at once


def word_hashes(text: str | None) -> np.ndarray:
    data = lower_bytes(text)
    start, end = spans_of(((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128))
    return hash_spans(data, start, end)


def _trigrams(words) -> set:
    words = list(words)
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: all sentences but the last, and the last; the whole text is both where either would be too short."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if word_hashes(p).size]
    question, answer = " ".join(parts[:-1]), parts[-1] if parts else ""
    return (question, answer) if min(word_hashes(question).size, word_hashes(answer).size) >= LEAST_WORDS else (text, text)


def length_class(words: int) -> int:
    """The least of 32, 64, 128 and so on that is not under the number of words."""
    return max(SHORT_WORDS, 1 << max(0, words - 1).bit_length())


def statistics(items: list[tuple[int, str | None]]) -> tuple[int, float, dict[int, int]]:
    """Number of items with words, their mean length, and in how many of them each word hash stands."""
    words = [w for _, t in items for w in [word_hashes(t)] if len(w)]
    df = Counter(t for w in words for t in np.unique(w).tolist())
    return len(words), sum(map(len, words)) / len(words) if words else 1.0, df


class ItemIndex:
    """Inverted index of (id, text) items with block maxima; terms are numbers in the order of `terms`.

    The items should be of one length class; `stats` are those of all items, where there are others.
    """

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD, overlap: float = OVERLAP,
                 stats: tuple[int, float, dict[int, int]] | None = None):
        self.threshold, self.overlap = threshold, overlap
        total, mean, frequency = stats or statistics(items)
        items = [(i, t, word_hashes(t)) for i, t in items if t]
        items = [x for x in items if len(x[2])]
        self.ids = [x[0] for x in items]
        self.half = max([length_class(len(x[2])) for x in items], default=SHORT_WORDS)
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in items)]))
        words = [np.searchsorted(self.terms, x[2]) for x in items]
        self.question, self.answer = [], []
        for _, text, _ in items:
            q, a = (_trigrams(np.searchsorted(self.terms, word_hashes(p)).tolist()) for p in split_item(text))
            self.question.append(q)
            self.answer.append(a)
        df = [frequency[t] for t in self.terms.tolist()]
        n = len(words)
        postings = defaultdict(list)
        for item, w in enumerate(words):
            tf = Counter(w.tolist())
            impact = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1)
                      / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            own = sum(impact.values())
            for t, v in impact.items():
                postings[t].append((item, v / own))
        # per term: items, impacts, maximum, and for each block its last item and maximum
        self.lists = []
        for t in range(len(self.terms)):
            docs, scores = zip(*sorted(postings[t]))
            cut = range(0, len(docs), BLOCK_POSTINGS)
            self.lists.append((docs, scores, max(scores), [docs[min(a + BLOCK_POSTINGS, len(docs)) - 1] for a in cut],
                               [max(scores[a:a + BLOCK_POSTINGS]) for a in cut]))
        # maxima of each term over ranges of items: sums of these rows bound a passage for each range
        self.bound = np.zeros((len(self.terms), max(1, min(ITEM_BLOCKS, n))), np.float32)
        for t, (docs, scores, *_) in enumerate(self.lists):
            np.maximum.at(self.bound[t], np.array(docs) * self.bound.shape[1] // n, np.array(scores, np.float32))

    def numbers(self, text: str | None, words: np.ndarray | None = None) -> np.ndarray:
        """Term numbers of the words of a text, or of its word hashes; -1 for words of no item."""
        words = word_hashes(text) if words is None else words
        if not len(self.terms) or not len(words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least the threshold for a passage with these distinct terms."""
        least, out = self.threshold - 1e-9, []
        cursors = [[self.lists[t][0][0], 0, 0, self.lists[t]] for t in terms]       # item, posting, block, list
        end = len(self.ids)

        def move(c, to):
            docs, last = c[3][0], c[3][3]
            while c[2] < len(last) and last[c[2]] < to:
                c[2] += 1
                c[1] = c[2] * BLOCK_POSTINGS
            while c[1] < len(docs) and docs[c[1]] < to:
                c[1] += 1
            c[0] = docs[c[1]] if c[1] < len(docs) else end

        def block_max(c, item):
            last, b = c[3][3], c[2]
            while b < len(last) and last[b] < item:
                b += 1
            return (c[3][4][b], last[b]) if b < len(last) else (0.0, end)

        while True:
            cursors = sorted((c for c in cursors if c[0] < end), key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[3][2]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocks = [block_max(c, item) for c in cursors[:pivot + 1]]
            if sum(m for m, _ in blocks) < least:
                # no item up to the end of the nearest block can reach the threshold
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                to = max(item + 1, min(min(e for _, e in blocks) + 1, after))
                for c in cursors[:pivot + 1]:
                    move(c, to)
            elif cursors[0][0] == item:
                score = sum(c[3][1][c[1]] for c in cursors[:pivot + 1])
                if score >= least:
                    out.append((item, score))
                for c in cursors[:pivot + 1]:
                    move(c, item + 1)
            else:
                for c in cursors[:pivot + 1]:
                    if c[0] < item:
                        move(c, item)

    def _hopeful(self, half: np.ndarray, term: np.ndarray) -> np.ndarray:
        """First halves of the passages whose bound reaches the threshold for some range of items."""
        out = []
        for a in range(0, int(half[-1]) + 1, HALVES):
            i, j = np.searchsorted(half, [a, a + HALVES + 1])
            sums = np.zeros((HALVES + 1, self.bound.shape[1]), np.float32)
            if i < j:
                at = np.flatnonzero(np.diff(half[i:j], prepend=-1))
                sums[half[i:j][at] - a] = np.add.reduceat(self.bound[term[i:j]], at, axis=0)
            # float32 sums of a few hundred terms err by less than the allowance
            out.append(a + np.flatnonzero((sums[:-1] + sums[1:]).max(axis=1) >= self.threshold - 1e-4))
        return np.concatenate(out)

    def search(self, text: str | None, words: np.ndarray | None = None) -> list[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of each verified item, with its best passage."""
        terms = self.numbers(text, words)
        found: dict[int, tuple] = {}
        known = np.flatnonzero(terms >= 0)
        if not len(known):
            return []
        half = known // self.half
        width = len(self.terms)
        pairs = np.unique(half * width + terms[known])          # distinct terms of each half passage
        for h in self._hopeful(pairs // width, pairs % width).tolist():
            window = terms[h * self.half:(h + 2) * self.half]
            grams = None
            for item, score in self.wand(np.unique(window[window >= 0]).tolist()):
                grams = grams if grams is not None else _trigrams(window.tolist()) | {(w,) for w in window.tolist()} | set(
                    zip(window.tolist(), window.tolist()[1:]))
                q, a = (len(s & grams) / len(s) for s in (self.question[item], self.answer[item]))
                if min(q, a) >= self.overlap and (item not in found or (min(q, a), score) > found[item][:2]):
                    found[item] = (min(q, a), score, q, a)
        return sorted((self.ids[i], s, q, a) for i, (_, s, q, a) in found.items())


class ShardIndex:
    """An index for each length class of the items of a shard; results do not depend on the other items of the shard."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float, overlap: float,
                 stats: tuple[int, float, dict[int, int]] | None = None):
        stats = stats or statistics(items)
        classes = defaultdict(list)
        for item in items:
            classes[length_class(len(word_hashes(item[1])))].append(item)
        self.indexes = [ItemIndex(classes[k], threshold, overlap, stats) for k in sorted(classes)]

    def search(self, text: str | None) -> list[tuple[int, float, float, float]]:
        words = word_hashes(text)
        return sorted(hit for index in self.indexes for hit in index.search(text, words))


def item_words(items: DataFrame, text_col: str) -> DataFrame:
    """word, n_words: a row for each distinct word hash of each item, and the length of the item."""
    def make():
        def run(cols):
            words = [w for w in map(word_hashes, cols[0]) if len(w)]
            rows = [(t, len(w), i == 0) for w in words for i, t in enumerate(np.unique(w).view(np.int64).tolist())]
            return [list(c) for c in zip(*rows)] if rows else [[]] * 3
        return run
    return map_rows(items, [text_col], "word bigint, n_words bigint, first boolean", make)


def item_shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_items: int = SHARD_ITEMS):
    """The items in lists of about shard_items, and what BM25 needs of all items for the words of each; each list alone is on the
    driver."""
    items = benchmark.select(id_col, text_col)
    n = max(1, -(-items.count() // shard_items))
    if n > 1:
        words = item_words(items, text_col)
        total, length = words.where("first").agg(F.count("*"), F.sum("n_words")).first()
        frequency = materialise(words.groupBy("word").agg(F.count("*").alias("items")))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k) if n > 1 else items
        shard = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        stats = None
        if n > 1:
            own = frequency.join(item_words(part, text_col).select("word").distinct(), "word", "left_semi")
            stats = total, length / total if total else 1.0, {r[0] & (1 << 64) - 1: r[1] for r in own.collect()}
        yield shard, stats


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    ddl = f"{id_col} {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    out = None
    for shard in item_shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def make(shared=shared):
            index = ShardIndex(shared.value[0], threshold, overlap, shared.value[1])

            def run(cols):
                rows = [(d, *hit) for d, t in zip(*cols) for hit in index.search(t)]
                return [list(c) for c in zip(*rows)] if rows else [[]] * 5
            return run

        found = map_rows(docs, [id_col, text_col], ddl, make)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               text_col: str = "text") -> DataFrame:
    """The rows of the table that leak no item."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    place = docs.columns.index(text_col)
    for shard in item_shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def make(shared=shared):
            index = ShardIndex(shared.value[0], threshold, overlap, shared.value[1])

            def run(cols):
                keep = [not index.search(t) for t in cols[place]]
                return [[v for v, k in zip(c, keep) if k] for c in cols]
            return run

        docs = map_rows(docs, docs.columns, ddl, make)
    return docs
