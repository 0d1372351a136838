"""License scan by fuzzy short-notice search (operator 10).

Each notice is split by the pigeonhole principle: with at most k errors, one of k + 1 pieces of its text occurs unchanged.
Exact hits of the pieces (one automaton over all of them) give the places where the notice may start; there the `regex`
library matches the whole notice with bounded errors, and the span with its number of edits is reported. Base labels come
from three phrases of consecutive words and always stay.

Words are runs of a-z, 0-9 and characters above 7F (hexadecimal) after A-Z is lower-cased. Defined cases: a null or empty
text has no words, labels or spans and score 0; texts of any length are searched whole; ties between notices report both;
extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from foresift.llm.common import lower_bytes, map_rows, spans_of

# fixed phrases of the base search
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# short notices of common licences, as words
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("distributed under the boost software license", "boost"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
)
ERROR_RATE = 1 / 15        # seeds of 10 characters or more, so that prose hardly ever holds one


def normalise(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by single spaces with a space at both ends, and start and end of each word in it."""
    data = lower_bytes(text)
    word = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    keep = word | np.concatenate([[False], word[:-1]])          # of each gap one byte stays
    flat = np.where(word, data, 32)[keep].astype(np.uint8)
    flat = np.concatenate([[32], flat, [32]]).astype(np.uint8)
    start, end = spans_of(flat != 32)
    return flat.tobytes(), start, end


class NoticeIndex:
    """Pieces of all notices in one automaton, and a compiled bounded-error pattern for each notice."""

    def __init__(self, notices=NOTICES, error_rate: float = ERROR_RATE):
        import ahocorasick
        import regex
        self.notices = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (text, label) in enumerate(notices):
            k = int(len(text) * error_rate)
            cuts = [round(j * len(text) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((i, a))
            self.notices.append((text, label, k, regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}")))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def windows(self, flat: str):
        """(notice, start) of each place where a piece stands, merged when within the errors of each other."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in self.automaton.iter(flat):
            for i, offset in where:
                hits.setdefault(i, []).append((end - length + 1 - offset, offset))
        for i, places in hits.items():
            text, _, k, _ = self.notices[i]
            places.sort()
            at = 0
            while at < len(places):
                to = at + 1
                while to < len(places) and places[to][0] - places[to - 1][0] <= k:
                    to += 1
                yield i, places[at][0] - k, places[to - 1][0] + len(text) + k
                at = to

    def find(self, flat: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of each verified notice in the normalised text."""
        out = []
        for i, a, b in self.windows(flat):
            text, label, k, pattern = self.notices[i]
            at, b = max(a, 0), min(b, len(flat))
            while m := pattern.search(flat, at, b):
                out.append((m.start(), m.end(), label, sum(m.fuzzy_counts)))
                at = m.end()
        return sorted(set(out))


_MARK = re.compile("|".join(f"(?<= ){re.escape(p)}(?= )" for p, _ in PHRASES).encode())
_LABEL = {p.encode(): label for p, label in PHRASES}


def base_places(flat: bytes, starts: np.ndarray) -> list[tuple[int, str]]:
    """(word index, label) of each place where the words of a phrase stand consecutively."""
    if b"license" not in flat:
        return []
    at = [(m.start(), _LABEL[m[0]]) for m in _MARK.finditer(flat)]
    return [(int(np.searchsorted(starts, a)), label) for a, label in at]


def scan_text(text: str | None, index: NoticeIndex) -> dict:
    flat, starts, ends = normalise(text)
    base = base_places(flat, starts)
    plain = flat.decode("latin-1")             # one character a byte, so that places stay places
    notices = index.find(plain)
    spans = [{"first": int(np.searchsorted(starts, a, "right")) - 1 if a and flat[a] != 32 else int(np.searchsorted(starts, a)),
              "last": int(np.searchsorted(starts, b, "left")) - 1, "label": label, "edits": edits}
             for a, b, label, edits in notices]
    best = max((1 - e / max(b - a, 1) for a, b, _, e in notices), default=0.0)
    return {"n_words": len(starts), "base": base, "spans": spans, "score": 1.0 if base else round(max(best, 0.0), 6)}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES,
                  error_rate: float = ERROR_RATE) -> DataFrame:
    """One row per document: word count, base places, labels and verified notice spans (word indexes) with their edits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        index = NoticeIndex(notices, error_rate)

        def run(cols):
            rows = [scan_text(t, index) for t in cols[1]]
            places = [[p for p, _ in r["base"]] for r in rows]
            base = [sorted({x for _, x in r["base"]}) for r in rows]
            every = [sorted({*b, *(s["label"] for s in r["spans"])}) for b, r in zip(base, rows)]
            return [cols[0], [r["n_words"] for r in rows], [len(p) for p in places],
                    [min(p, default=None) for p in places], [max(p, default=None) for p in places],
                    [",".join(b) for b in base], [",".join(e) for e in every], [r["score"] for r in rows],
                    [r["spans"] for r in rows]]
        return run

    return map_rows(docs, [id_col, text_col],
                    f"{id_col} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                    "labels string, score double, spans array<struct<first:bigint,last:bigint,label:string,edits:bigint>>", make)
