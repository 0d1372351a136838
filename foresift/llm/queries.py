"""Registered queries of the training-data operators and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.llm import (ann, decontam, divergence, html_wrapper, langid, license_scan, packing, parity_join, quality_rules,
                           secret_scan, token_alignment, token_store, warc)
from foresift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.span_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train_language_model(docs.where(~langid.held_out()))
    return langid.predict_language(docs, model, ["doc_id"]) \
        .select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_wrapper.extract_main_text(table(spark, sf_dir, "pages")) \
        .withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to coded files and read back."""
    return token_store.token_round_trip(spark, table(spark, sf_dir, "documents")) \
        .select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 ids."""
    return packing.piece_digest(packing.pack_documents(table(spark, sf_dir, "documents")))


@query
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of every page, written and read back."""
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


ORACLE["op8_warc_archive"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f"""


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose shingle sets link."""
    return parity_join.similarity_components(table(spark, sf_dir, "documents"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language, and the terms that set each apart from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
     groups AS (SELECT DISTINCT lang, source FROM d),
     cells AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     totals AS (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
           1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
           FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
           LEFT JOIN cells c USING (lang, source, term)),
     pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     results AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
                 FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
                 LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = o.source
                 UNION ALL
                 SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM results QUALIFY part = 'pair' OR rank <= 10"""


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality rules on every document, with the base measures of all of them."""
    Q = quality_rules
    return Q.judge(table(spark, sf_dir, "documents"), ["doc_id"], Q.BASE_MEASURES) \
        .select("doc_id", *Q.BASE_MEASURES, F.expr(Q.BASE_FAILS).alias("base_failed"), "kept")


ORACLE["op12_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
     win AS (SELECT r, i, words[i] AS a, words[i+1] AS b, words[i+2] AS c FROM (
             SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
     rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM win),
             (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY r),
     m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_wordlike,
           len(list_filter(words, lambda x: regexp_matches(x, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'))) AS n_capital_words,
           len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{2022}]'))) AS n_bullet_lines,
           len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09\x0D]*$'))) AS n_ellipsis_lines
           FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
     v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * n_wordlike < 6 * n_words OR 2 * n_capital_words > n_words
            OR 10 * n_bullet_lines > 9 * n_lines OR 10 * n_ellipsis_lines > 3 * n_lines) AS kept
FROM v"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers over the same bytes, and how usual their links are in the corpus."""
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
