"""Quality rules as a short-circuit cascade of native expressions.

A rule rejects a document by a condition on measures; a measure is an expression over the text and other measures. Cost and
rejections are estimated on a sample: each measure is timed there, and the sample's documents are counted by the set of rules
that they fail. The rules are then ordered greedily: next comes the rule that rejects most of the documents not yet rejected,
per second of the measures that it still needs. On the whole table a measure is evaluated only where no earlier rule has
rejected the document, so a rejected document costs nothing more. The order never changes which documents stay.

Only DataFrame and SQL functions run on the rows. The sample (`sample_rows`, about 2000 whole texts) serves the order alone.

Null and empty texts have no words and are rejected by the least length, as are texts of white space. Documents are judged one
by one: repeated rows get equal verdicts, any doc_id will do, an empty table gives an empty result, and extra columns of any name
do not matter. Very long texts are judged whole. Windows of words are compared by 64-bit hashes.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
SAMPLE_SEED = 17
# time that no measure is taken to undercut, in seconds for the whole sample: below it job start-up decides
LEAST_COST = 0.02
TEXT = "_text"


@dataclass(frozen=True)
class Measure:
    """SQL of a value; `needs` names the measures in it, `_text` is the text."""
    name: str
    sql: str
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """SQL of the condition under which a document is rejected; true or false, never null."""
    name: str
    fails: str
    needs: tuple[str, ...]


MEASURES = {m.name: m for m in (
    # texts whose only white space is blanks and line ends are cut without a pattern
    Measure("words", r"array_remove(CASE WHEN _text RLIKE r'[\x09\x0B-\x0D]' THEN split(_text, r'[\x20\x09-\x0D]+') "
                     r"ELSE flatten(transform(split(_text, '\n'), l -> split(l, ' '))) END, '')"),
    Measure("n_words", "CAST(size(words) AS BIGINT)", ("words",)),
    Measure("word_chars", "CAST(length(array_join(words, '')) AS BIGINT)", ("words",)),
    Measure("n_symbols", "CAST(regexp_count(_text, r'[#*$%&|<>]') AS BIGINT)"),
    Measure("lines", r"filter(split(_text, r'\n', -1), l -> l RLIKE r'[^\x20\x09-\x0D]')"),
    Measure("n_lines", "CAST(size(lines) AS BIGINT)", ("lines",)),
    Measure("n_dup_lines", "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)", ("lines",)),
    Measure("windows", "CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), "
                       "i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) END", ("words",)),
    # windows next to their positions, by hash, where any window repeats
    Measure("sorted_windows", "CASE WHEN size(array_distinct(windows)) < size(windows) THEN "
                              "sort_array(transform(windows, (h, i) -> struct(h, i))) END", ("windows",)),
    Measure("repeat_starts", "sort_array(filter(transform(sorted_windows, (w, i) -> CASE WHEN w.h = get(sorted_windows, i - 1).h "
                             "OR w.h = get(sorted_windows, i + 1).h THEN w.i END), p -> p IS NOT NULL))", ("sorted_windows",)),
    # a repeated window covers three words, or as many as lie before the next one
    Measure("n_repeat_words", "CAST(coalesce(aggregate(zip_with(repeat_starts, slice(repeat_starts, 2, size(repeat_starts)), "
                              "(a, b) -> least(3, b - a)), 0, (s, x) -> s + x), 0) AS BIGINT)", ("repeat_starts",)),
    Measure("n_wordlike", r"size(filter(words, w -> w RLIKE r'\p{L}'))", ("words",)),
    Measure("n_capital_words", r"size(filter(words, w -> w RLIKE r'^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'))", ("words",)),
    Measure("n_bullet_lines", r"size(filter(lines, l -> l RLIKE r'^[\x20\x09]*[-*\x{2022}]'))", ("lines",)),
    Measure("n_ellipsis_lines", r"size(filter(lines, l -> rtrim(' \t\r', l) LIKE '%...' OR rtrim(' \t\r', l) LIKE '%\u2026'))", ("lines",)),
)}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILS = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

RULES = (
    Rule("too_short", "n_words < 50", ("n_words",)),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", ("n_repeat_words", "n_words")),
    Rule("symbols", "10 * n_symbols > n_words", ("n_symbols", "n_words")),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words", ("word_chars", "n_words")),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", ("n_dup_lines", "n_lines")),
    Rule("few_letters", "10 * n_wordlike < 6 * n_words", ("n_wordlike", "n_words")),
    Rule("capitals", "2 * n_capital_words > n_words", ("n_capital_words", "n_words")),
    Rule("bullets", "10 * n_bullet_lines > 9 * n_lines", ("n_bullet_lines", "n_lines")),
    Rule("ellipses", "10 * n_ellipsis_lines > 3 * n_lines", ("n_ellipsis_lines", "n_lines")),
)


def _closure(names, measures: dict[str, Measure]) -> list[str]:
    """The measures and all that they need, each after those that it needs."""
    out: list[str] = []
    for name in names:
        for m in [*_closure(measures[name].needs, measures), name]:
            if m not in out:
                out.append(m)
    return out


def _with(df: DataFrame, names, measures: dict[str, Measure], where: Column | None = None) -> DataFrame:
    for name in names:
        value = F.expr(measures[name].sql)
        df = df.withColumn(name, value if where is None else F.when(where, value))
    return df


def _seconds(sample: DataFrame, names, measures: dict[str, Measure]) -> float:
    """Time of the measures over the sample, the better of two runs; the first also compiles."""
    best = float("inf")
    for _ in range(2):
        t0 = time.monotonic()
        _with(sample, _closure(names, measures), measures).select(*names).write.format("noop").mode("overwrite").save()
        best = min(best, time.monotonic() - t0)
    return best


@dataclass(frozen=True)
class Estimate:
    costs: dict[str, float]                       # seconds of each measure, without those that it needs
    failures: dict[frozenset[str], int]           # documents of the sample by the set of rules that they fail


def estimate(docs: DataFrame, rules=RULES, measures=None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Estimate:
    """Costs and failures on a sample of about `sample_rows` documents. What returns is a row for each set of failed rules."""
    from foresift.sources.storage import materialise
    measures = measures or MEASURES
    needed = _closure([m for r in rules for m in r.needs], measures)
    rows = docs.count()
    if not rows:
        return Estimate({m: LEAST_COST for m in needed}, {})
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(TEXT))
    sample = materialise(texts.sample(min(1.0, sample_rows / rows), SAMPLE_SEED).coalesce(4))
    nothing = _seconds(sample.withColumn("none", F.lit(1)), [], measures)
    costs, through = {}, {}
    for m in needed:
        through[m] = _seconds(sample, [m], measures)
        before = max([nothing, *(through[d] for d in measures[m].needs)])
        costs[m] = max(LEAST_COST, through[m] - before)
    failed = F.array_compact(F.array(*[F.when(F.expr(r.fails), F.lit(r.name)) for r in rules]))
    counted = _with(sample, needed, measures).select(failed.alias("failed")).groupBy("failed").count().collect()
    return Estimate(costs, {frozenset(r["failed"]): r["count"] for r in counted})


def order_rules(rules, found: Estimate, measures=None, paid=()) -> list[Rule]:
    """Greedy order by rejections per second; measures in `paid` cost nothing. Ties keep the given order."""
    measures = measures or MEASURES
    have, left, out = set(_closure(paid, measures)), dict(found.failures), []
    todo = list(rules)
    while todo:
        def worth(rule: Rule) -> float:
            cost = sum(found.costs[m] for m in _closure(rule.needs, measures) if m not in have)
            return sum(n for failed, n in left.items() if rule.name in failed) / max(cost, LEAST_COST / 10)
        best = max(todo, key=worth)
        todo.remove(best)
        out.append(best)
        have |= set(_closure(best.needs, measures))
        left = {failed: n for failed, n in left.items() if best.name not in failed}
    return out


def cascade(docs: DataFrame, ordered, keep=(), always=(), measures=None, text: str = "text") -> DataFrame:
    """Columns `keep` of the documents, the measures `always` of all of them, `failed_rule` (null: none) and `kept`.

    All other measures are evaluated for documents that no earlier rule has rejected.
    """
    measures = measures or MEASURES
    df = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(TEXT))
    done = _closure(always, measures)
    df = _with(df, done, measures).withColumn("_failed", F.lit(None).cast("string"))
    for rule in ordered:
        new = [m for m in _closure(rule.needs, measures) if m not in done]
        done += new
        df = _with(df, new, measures, F.col("_failed").isNull())
        df = df.withColumn("_failed", F.when(F.col("_failed").isNotNull(), F.col("_failed"))
                           .when(F.expr(rule.fails), F.lit(rule.name)))
    # a column that is no function of the row keeps filters on the verdict above the cascade: pushed below it, they would
    # repeat every measure in every later rule
    row = F.monotonically_increasing_id() >= 0
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *always,
                     F.col("_failed").alias("failed_rule"), (row & F.col("_failed").isNull()).alias("kept"))


def judge(docs: DataFrame, keep=("doc_id",), always=(), rules=RULES, measures=None, text: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Verdict on every document by the rules in their estimated best order; see `cascade` for the columns."""
    found = estimate(docs, rules, measures, text, sample_rows)
    return cascade(docs, order_rules(rules, found, measures, always), keep, always, measures, text)


def keep_good(docs: DataFrame, rules=RULES, measures=None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    columns = docs.columns
    return judge(docs, columns, (), rules, measures, text, sample_rows).where("kept").select(*[f"`{c}`" for c in columns])
