"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, erasure, fingerprints, host_rules, licenses, lm, mixing, neardup, packing, quality, spelling, tokens, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.digest(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.digest(*(table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH docs AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS key, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS fill FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM f WINDOW b AS (ORDER BY fill, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * coalesce((SELECT arg_min(level, fill) FROM l WHERE level <= fill), 0)) AS target FROM l),
m AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS rounds FROM t),
sums AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs)
SELECT doc_id, size, source_size, round(target, 6) AS target, (rounds * size + greatest(0, least(size, words - rounds * source_size - before)))::BIGINT AS taken, sums.source
FROM sums JOIN m ON sums.source IS NOT DISTINCT FROM m.source
"""

OP10_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT row, i, (w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, k) > 1),
hit AS (SELECT row, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY row),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM split LEFT JOIN hit USING (row)),
r AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, word_chars > 12 * n_words OR word_chars < 2 * n_words, 2 * n_symbols > n_words, 2 * n_dup_lines > n_lines] AS fails FROM m),
h AS (SELECT source, rule, count(*)::DOUBLE AS docs, sum(fails[rule]::INT)::DOUBLE AS failed FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS rule) GROUP BY source, rule),
a AS (SELECT rule, sum(docs) AS n, sum(failed) / sum(docs) AS mean, count(*) AS hosts FROM h GROUP BY rule),
v AS (SELECT rule, any_value(mean) AS mean, greatest(sum(docs * (failed / docs - mean) ** 2) / any_value(n) - any_value(mean * (1 - mean) * hosts / n), 1e-9) AS between_hosts FROM h JOIN a USING (rule) GROUP BY rule),
p AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / between_hosts - 1, 1.0), 1e6) AS strength FROM v),
verdicts AS (SELECT source, bool_or((failed + mean * strength) / (docs + strength) > 0.5) AS host_rejected FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fails[1] OR fails[2]) AS base_failed, NOT (fails[1] OR fails[2]) AND NOT host_rejected AS kept, host_rejected
FROM r JOIN verdicts ON r.source IS NOT DISTINCT FROM verdicts.source
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT row, n, i, phrase FROM places WHERE phrase IN (SELECT phrase FROM windows)),
covered AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM (SELECT row, i, unnest(range(n)) AS k FROM hits) GROUP BY row),
found AS (SELECT row, count(*) AS n_items, array_to_string(list(item ORDER BY encode(item)), ',') AS items FROM (SELECT DISTINCT row, item FROM hits JOIN windows USING (phrase)) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN found USING (row)
"""


def queries() -> dict[str, Query]:
    found = (op1_licenses, op2_lm_scores, op3_quality, op4_token_counts, op5_near_duplicates, op6_packing, op7_fingerprints, op8_mixing, op9_toxicity, op10_host_rules, op11_decontamination, op12_erasure, op13_spelling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": OP8_SQL, "op10_host_rules": OP10_SQL, "op11_decontamination": OP11_SQL}
