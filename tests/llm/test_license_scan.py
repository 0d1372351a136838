from __future__ import annotations

import re

from foresift.llm import license_scan as L
from tests.llm.helpers import awkward, empty


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(places)


TEXTS = ["MIT License mit-license, MIT\nLICENSE! xmit license mit licensed", "the GNU General  Public License Apache license apache license",
         "é mit license中", "License mit", "", None, "mit license mit license apache license"]


def test_base_matches_brute_force(spark, sf):
    index = L.NoticeIndex()
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        got = L.scan_text(t, index)
        assert (got["n_words"], sorted(got["base"])) == brute(t), t


def labels(text):
    return [(s["label"], s["edits"]) for s in L.scan_text(text, L.NoticeIndex())["spans"]]


def test_fuzzy_notices():
    notice = "Redistribution and use in source and binary forms, with or without modification"
    assert labels(notice) == [("bsd", 0)]
    assert labels("Some words. Redistributoin and use in sorce and binary form, with or without modification, are permitted") == [("bsd", 4)]
    assert labels(notice[:40]) == []
    assert labels("nothing of the kind in this license free text") == []
    row = L.scan_text("aa bb " + notice + " cc", L.NoticeIndex())
    assert [(s["first"], s["last"]) for s in row["spans"]] == [(2, 13)] and row["score"] == 1.0


def test_rows(spark):
    rows = L.scan_licenses(awkward(spark)).collect()
    assert len(rows) == 8
    assert all(r.n_base == 0 and r.first_word is None and r.labels == "" and r.score == 0.0 for r in rows)
    assert L.scan_licenses(empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[6])], "doc_id bigint, text string")
    got = sorted((r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in L.scan_licenses(docs).collect())
    assert got == [(3, 0, 4, "mit", "mit"), (3, 0, 4, "apache,mit", "apache,mit")] or got == sorted(
        [(3, 0, 4, "mit", "mit"), (3, 0, 4, "apache,mit", "apache,mit")])
