"""The registered queries of this subpackage and their DuckDB SQL.

Each applies one operator, with its production parameters, to its whole
table, and derives the columns to return from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (alignment, decontaminate, html_text, language_id, license_scan, packing, quality_classifier,
                          quality_rules, simhash, token_counts, token_files, url_filter, vector_codes)
from wordloom.llm.common import table, written
from wordloom.session import scratch_path

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 1
SIMHASH_WORDS, SIMHASH_BITS = 3, 2
#: domains blocked by op9 where no rule fits: these names under these parents
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_PARENTS = ("example.com", "example.net", "example.org")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=SIMHASH_WORDS, max_bits=SIMHASH_BITS)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counts only, a few dozen bytes a document: used for the cutoffs and for the verdicts
    measured = written(spark, quality_rules.measures(table(spark, sf_dir, "documents")), "measures")
    chosen = written(spark, quality_rules.cutoffs(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return quality_rules.judged(measured, chosen).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")), toxicity=True)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"),
                                             public_tokenizers.path(WORD_BPE), END_ID)
    return token_files.read_token_files(manifest)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{n}.{p}",) for n in BLOCKED_NAMES for p in BLOCKED_PARENTS], "domain string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                                       public_tokenizers.path(PIECES))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                        F.sha2(F.lit(books.text() if books else ""), 256).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_simhash, op3_quality_rules, op4_token_counts, op5_html_text, op6_quality_classifier,
        op7_token_files, op8_decontamination, op9_url_filter, op10_packing, op11_alignment, op12_license_scan,
        op13_vector_codes)}


def _rules_sql() -> str:
    """op3 in SQL: the same measures, tests and choice of cutoffs."""
    grid = ", ".join(f"('{r}', {i}, {c!r}::double)" for r, g in quality_rules.RULES.items() for i, c in enumerate(g))
    n_rules = len(quality_rules.RULES)
    risk = quality_rules.RISK / n_rules
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text,
        list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w1 FROM w),
t AS (SELECT doc_id, i, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS s(k) WHERE n >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, len(ws)::bigint AS n_words,
        length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, len(ls)::bigint AS n_lines
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
v AS (SELECT doc_id, stratum, base_failed, u.rule, u.value FROM b, LATERAL (VALUES
        ('symbols', n_symbols / greatest(n_words, 1)), ('dup_lines', n_dup_lines / greatest(n_lines, 1)),
        ('repeats', n_repeat_words / greatest(n_words, 1)), ('word_length', word_chars / greatest(n_words, 1))) AS u(rule, value)),
g(rule, step, cutoff) AS (VALUES {grid}),
counts AS (SELECT stratum, g.rule, step, cutoff,
        count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND value > cutoff) AS k,
        count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (quality = 0 AND value > cutoff) AS k_bad
      FROM v JOIN labels USING (doc_id) JOIN g ON g.rule = v.rule
      WHERE NOT base_failed AND quality IN (0, 1) GROUP BY ALL),
tails AS (SELECT stratum, rule, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) AS p
      FROM (SELECT stratum, rule, step, n, unnest(range(0, k + 1)) AS i FROM counts WHERE n > 0) GROUP BY ALL),
tested AS (SELECT counts.*, max(coalesce(CASE WHEN k < n * {risk} THEN p ELSE 1 END, 1)) OVER (PARTITION BY stratum, rule ORDER BY step) AS worst,
        {quality_rules.ERROR / n_rules} / (SELECT count(DISTINCT stratum) FROM counts) AS level
      FROM counts LEFT JOIN tails USING (stratum, rule, step)),
best AS (SELECT stratum, rule, first(cutoff ORDER BY coalesce(k_bad / nullif(n_bad, 0), 0) - k / n DESC, step) AS cutoff
      FROM tested WHERE worst <= level GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM v JOIN best USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""


def _urls_sql() -> str:
    """op9 in SQL: the rules, then a plain list of domains."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    fits = {}
    for action, text in rules:
        domain, slash, tail = text.partition("/")
        fits[text] = f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + tail}'))"
    rule = "CASE " + " ".join(f"WHEN {fits[t]} THEN '{t}'" for _, t in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[t]} THEN '{a}'" for a, t in rules)
    listed = " OR ".join(f"host = '{n}.{p}' OR ends_with(host, '.{n}.{p}')" for n in BLOCKED_NAMES for p in BLOCKED_PARENTS)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM h
"""


def _licenses_sql() -> str:
    """op12 in SQL: phrases by shifted words, overlaps of all blocks and templates counted."""
    rows = license_scan.template_rows(license_scan.TEMPLATES)
    templates = ", ".join(f"({n}, '{label}', {size}, {need}, {span}, '{w}')" for n, label, size, need, span, ws in rows for w in ws)
    spans = ", ".join(f"({s})" for s in sorted({r[4] for r in rows}))
    fits = {label: " AND ".join(f"{c} = '{w}'" for c, w in zip(("w1", "w2", "w3"), phrase.split(" ")))
            for phrase, label in license_scan.PHRASES}
    places = "CASE " + " ".join(f"WHEN {f} THEN '{label}'" for label, f in fits.items()) + " END"
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w1 FROM d),
n AS (SELECT *, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i, {places} AS label FROM n WHERE {places} IS NOT NULL),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY doc_id),
t(template, label, size, need, span, word) AS (VALUES {templates}),
spans(span) AS (VALUES {spans}),
k AS (SELECT doc_id, span, i // span - back AS block, w1 AS word FROM p, spans, (VALUES (0), (1)) AS s(back)
      WHERE i // span - back >= 0 AND w1 IN (SELECT word FROM t)),
c AS (SELECT doc_id, label, size, need, count(DISTINCT word) AS common FROM k JOIN t USING (span, word)
      GROUP BY doc_id, block, template, label, size, need),
hit AS (SELECT doc_id, list(DISTINCT label) AS labels, max(common / size) AS share FROM c WHERE common >= need GROUP BY doc_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word,
  last_word::bigint AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hit.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(share, 0)::double END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN hit USING (doc_id)
"""


def _codes_sql() -> str:
    """op13 in SQL: every distance to every entry."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES

    def assigned(n: int) -> str:
        return f"""
a{n} AS (SELECT vec_id, part, arg_min(k, d * {entries} + k) AS k, min(d) AS d FROM (
        SELECT vec_id, p.part, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d
        FROM p JOIN c{n} ON p.part = c{n}.part) GROUP BY vec_id, part)"""

    def moved(n: int) -> str:
        return f"""
c{n + 1} AS (SELECT c{n}.part, c{n}.k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
        SELECT part, k, list(floor(s / n)::bigint ORDER BY i) AS c FROM (
          SELECT part, k, i, sum(x[i]) AS s, count(*) AS n FROM a{n} JOIN p USING (vec_id, part), (SELECT unnest(range(1, len(x) + 1)) AS i
            FROM (SELECT x FROM p LIMIT 1)) GROUP BY part, k, i) GROUP BY part, k) AS m ON m.part = c{n}.part AND m.k = c{n}.k)"""
    last = vector_codes.ROUNDS
    rounds = ",".join(assigned(n) + "," + moved(n) for n in range(last))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::double)::bigint) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, list_slice(e, part * (len(e) // {parts}) + 1, (part + 1) * (len(e) // {parts})) AS x
        FROM v, (SELECT unnest(range({parts})) AS part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS c FROM p
        WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})),{rounds},{assigned(last)},
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c{last}),
r AS (SELECT vec_id, string_agg(format('{{:02x}}', k), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256
FROM r JOIN v USING (vec_id), s
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express; the others are tested against
    brute force, the tokenizer libraries, round trips and held-out accuracy."""
    return {"op3_quality_rules": _rules_sql(), "op9_url_filter": _urls_sql(),
            "op12_license_scan": _licenses_sql(), "op13_vector_codes": _codes_sql()}
