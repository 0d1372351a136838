from __future__ import annotations

import re
from collections import Counter

import compare
from pyspark.sql import functions as F

from foresift.llm import quality_rules as Q
from tests.llm.helpers import awkward, documents, empty

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    """Base measures and verdict of one text, straight from their definitions."""
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(covered) > 50 * n
    letters = sum(any(c.isalpha() for c in w) for w in words)
    capitals = sum(sum(c.isupper() for c in w) > 1 and not any(c.islower() for c in w) for w in words)
    bullets = sum(x.lstrip(" \t")[:1] in tuple("-*•") for x in lines)
    dots = sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in lines)
    failed = (base or 10 * symbols > n or chars < 3 * n or chars > 10 * n or 2 * dup > len(lines) or 10 * letters < 6 * n
              or 2 * capitals > n or 10 * bullets > 9 * len(lines) or 10 * dots > 3 * len(lines))
    return n, chars, symbols, dup, len(covered), not failed


def prose(n, start=0, mark=""):
    return " ".join(f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{mark}" for i in range(start, start + n))


TEXTS = [prose(60), prose(49), prose(50), prose(60, mark="#"), prose(40).upper() + " " + prose(30, 50), "a b " * 40, "a b c " * 3,
         "\n".join([prose(8)] * 9 + [prose(40, 100)]), "\n".join("- " + prose(6, 6 * i) for i in range(12)),
         "\n".join(prose(9, 9 * i) + ("... " if i % 2 else "…\r") for i in range(8)), " ".join(["12", "345"] * 5 + [prose(50)]),
         " ".join(f"{i}" for i in range(80)), "x\ty\x0bz\x0cw\rv u\x85t s " * 9 + prose(55), "aa bb cc dd aa bb cc " + prose(60),
         "a a a a a", "  \n \t", "#\n#\n #\n", "\U0001d4d0é中 " * 30 + prose(60), "-" + "y" * 3000 + " " + prose(60)]


def rows_of(df):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in df.orderBy("doc_id").collect()]


def test_measures_and_verdict_match_brute_force(spark, sf):
    docs = documents(spark, TEXTS, extra=True)
    assert rows_of(Q.judge(docs, ["doc_id"], Q.BASE_MEASURES)) == [brute(t) for t in TEXTS]
    given = spark.read.parquet(f"{sf}/documents.parquet")
    want = [brute(r.text) for r in given.orderBy("doc_id").collect()]
    assert rows_of(Q.judge(given, ["doc_id"], Q.BASE_MEASURES)) == want
    # without the base measures of all rows the verdict is the same
    assert [r.kept for r in Q.judge(given).orderBy("doc_id").collect()] == [w[-1] for w in want]


def test_any_order_gives_the_same_verdict(spark):
    docs = documents(spark, TEXTS)
    kept = {tuple(r.kept for r in Q.cascade(docs, order, ["doc_id"]).orderBy("doc_id").collect())
            for order in (list(Q.RULES), list(Q.RULES)[::-1])}
    assert len(kept) == 1


COSTS = {"words": 1.0, "n_words": 0.02, "slow": 10.0, "n_symbols": 0.5}
MADE = {**{m: Q.MEASURES[m] for m in ("words", "n_words", "n_symbols")},
        "slow": Q.Measure("slow", "CASE WHEN _text LIKE '%bomb%' THEN raise_error('evaluated') ELSE size(words) END", ("words",))}
MADE_RULES = (Q.Rule("slow", "slow > 5", ("slow",)), Q.Rule("short", "n_words < 3", ("n_words",)),
              Q.Rule("symbols", "n_symbols > 0", ("n_symbols",)))


def names(ordered):
    return [r.name for r in ordered]


def test_order_is_rejections_per_cost_given_what_is_paid():
    failures = {frozenset({"slow"}): 100, frozenset({"short"}): 30, frozenset({"symbols"}): 20, frozenset({"symbols", "short"}): 5}
    found = Q.Estimate(COSTS, failures)
    assert names(Q.order_rules(MADE_RULES, found, MADE)) == ["symbols", "short", "slow"]    # 50, 29 and 9 a second
    assert names(Q.order_rules(MADE_RULES, found, MADE, paid=["slow"])) == ["slow", "short", "symbols"]
    # what an earlier rule rejects counts no more: alone, each of both would reject 40
    both = Q.Estimate(COSTS, {frozenset({"symbols", "short"}): 40, frozenset({"slow"}): 10})
    assert names(Q.order_rules(MADE_RULES, both, MADE)) == ["symbols", "slow", "short"]
    assert names(Q.order_rules(MADE_RULES, Q.Estimate(COSTS, {}), MADE)) == ["slow", "short", "symbols"]


def test_rejected_documents_cost_nothing_more(spark):
    docs = documents(spark, ["# bomb", "a b c d", "a", "a b c d e f g"])
    order = [MADE_RULES[2], MADE_RULES[1], MADE_RULES[0]]
    got = Q.cascade(docs, order, ["doc_id"], measures=MADE).orderBy("doc_id").collect()
    assert [(r.failed_rule, r.kept) for r in got] == [("symbols", False), (None, True), ("short", False), ("slow", False)]


def test_estimate_on_a_sample(spark):
    docs = documents(spark, TEXTS * 40)
    found = Q.estimate(docs, sample_rows=100)
    assert 30 < sum(found.failures.values()) < 300
    assert set(found.costs) == set(Q.MEASURES) and min(found.costs.values()) > 0


def test_native_plan(spark):
    plan = Q.judge(documents(spark, TEXTS), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = Q.judge(docs, docs.columns, Q.BASE_MEASURES)
    assert out.columns == [*docs.columns, *Q.BASE_MEASURES, "failed_rule", "kept"]
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept)
                   for r in out.collect()) == want
    clashing = documents(spark, TEXTS, extra=True)
    kept = Q.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for t in TEXTS if brute(t)[-1])
    assert Q.judge(empty(spark)).count() == 0 and Q.keep_good(empty(spark)).count() == 0


def test_clean_documents_stay(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.judge(docs, ["doc_id"], ("n_words",)).join(labels, "doc_id").where("n_words >= 50").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in got}
    assert share[1] > 0.99 and share[0] < 0.05


def test_sql(spark, con, sf):
    assert compare.check(spark, con, "op12_quality_rules", sf)[2] == []
