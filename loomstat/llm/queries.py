"""One registered query per operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import (
    alignment, divergence, exact_dedup, fingerprints, hamming_index, jaccard_join, language_id, mixing, packing, secrets, simple8b,
    substring_dedup, toxicity,
)
from loomstat.llm.common import table
from loomstat.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf, "documents"))


ORACLE["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.assign(table(spark, sf, "documents"))


ORACLE["op3_mix_sources"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 3 * n AS most FROM s),
w AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight FROM p),
f AS (SELECT *, most / weight AS ratio, sum(n) OVER () AS total,
        sum(most) OVER o - most AS before, sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w WINDOW o AS (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((total - before) / rest, (ratio, place)) AS lev FROM f WHERE (total - before) / rest <= ratio),
t AS (SELECT source, n, least(most::DOUBLE, weight * lev) AS target FROM f, l),
c AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
q AS (SELECT g.source, h, g.size, target - copies * n AS rest, sum(g.size) OVER (PARTITION BY g.source ORDER BY h) AS cum
      FROM g JOIN c ON g.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, d.source, d.size, n AS source_size, target,
       (d.size * (copies + CASE WHEN cum <= rest OR (cum - q.size <= rest AND 2 * (rest - (cum - q.size)) > q.size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
       JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.h = q.h
"""


@query
def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf, "documents")))


@query
def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(table(spark, sf, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    simple8b.write(table(spark, sf, "documents"), path, end=2)
    return simple8b.read(spark, path)


@query
def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), end=1)


@query
def op6_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return hamming_index.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf, "documents"), width=4, percent=85)


@query
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf, "documents"))


@query
def op11_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf, "documents"))


ORACLE["op11_document_fingerprints"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS following
  FROM documents),
e AS MATERIALIZED (SELECT *, left(t, n - n // 2) || left(following, n // 2) AS edited FROM d),
w AS MATERIALIZED (
  SELECT t, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT t FROM e UNION SELECT edited FROM e)),
f AS MATERIALIZED (
  SELECT t, CASE WHEN len(words) = 0 THEN []::BIGINT[] ELSE list_sort(list_distinct(list_transform(
         range(1, greatest(len(words) - 4, 1) + 1),
         lambda i: ('0x' || substr(md5(array_to_string(words[i : i + 4], ' ')), 1, 13))::BIGINT)))[1 : 128] END AS s
  FROM w),
j AS MATERIALIZED (
  SELECT doc_id, n, edited, a.s AS a, b.s AS b, c.s AS c, list_sort(list_distinct(a.s || b.s))[1 : 128] AS ab,
         list_sort(list_distinct(a.s || c.s))[1 : 128] AS ac
  FROM e JOIN f a ON a.t = e.t JOIN f b ON b.t = e.edited JOIN f c ON c.t = e.following)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, ',') AS fingerprint,
       array_to_string(b, ',') AS edited_fingerprint,
       CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(list_intersect(a, b), lambda x: x <= ab[-1]))::DOUBLE / len(ab) END AS near_edited,
       CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(list_intersect(a, c), lambda x: x <= ac[-1]))::DOUBLE / len(ac) END AS near_next
FROM j
"""


@query
def op12_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


ORACLE["op13_source_divergence"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS in_lang FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS MATERIALIZED (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source FROM d GROUP BY ALL),
s AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.in_lang + 5)) // (v.total + 5 * v.v))::BIGINT AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""
