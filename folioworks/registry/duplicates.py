"""Duplicate resolution."""

from pyspark.sql import functions as F

from folioworks.operators import duplicates as dup
from folioworks.registry import query
from folioworks.registry.joins import HASH_SQL
from folioworks.registry.prelude import LIBRARY, using
from folioworks.sources import library as lib

_RECORDS = LIBRARY + rf""",
r AS (SELECT *, {HASH_SQL} AS h, replace(lower(title), 'ß', 'ss') AS tl,
  trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS title_key,
  trim(regexp_replace(replace(lower(coalesce(author, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS author_key,
  lower(regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*')) || regexp_replace(regexp_replace(url_decode(regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*([^?#]*)', 1)), '/+', '/', 'g'), '/$', '') AS identity,
  CASE regexp_extract(canonical_url, '[?&]lang(?:uage)?=([a-z]+)', 1) WHEN 'eng' THEN 'en' WHEN 'spa' THEN 'es' WHEN 'fra' THEN 'fr' WHEN 'deu' THEN 'de' WHEN '' THEN language
    ELSE regexp_extract(canonical_url, '[?&]lang(?:uage)?=([a-z]+)', 1) END AS url_language,
  contains(canonical_url, 'imageView=') AS media, length(trim(text)) >= 500 AS meaningful,
  CASE WHEN lower(canonical_url) LIKE '%discursosud.com%' THEN 0 ELSE 1 END AS official,
  CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(author, '') <> '' THEN 1 ELSE 0 END + CASE WHEN published_on IS NOT NULL THEN 1 ELSE 0 END + 1
    + CASE WHEN coalesce(meta_source_type, meta_source_url, meta_summary, meta_is_seed, meta_error, meta_api_token) IS NOT NULL THEN 1 ELSE 0 END AS complete
  FROM library),
keyed AS (SELECT 1 AS rule, identity AS key, r.* FROM r UNION ALL SELECT 2, h || '|' || language || '|' || title_key, r.* FROM r WHERE meaningful
  UNION ALL SELECT 3, title_key || '|' || author_key || '|' || coalesce(CAST(published_on AS VARCHAR), '') || '|' || language, r.* FROM r WHERE length(title_key) >= 12 AND length(text) >= 500),
placed AS (SELECT *, count(*) OVER (PARTITION BY rule, key) AS members, row_number() OVER (PARTITION BY rule, key
  ORDER BY official DESC, complete DESC, length(text) DESC, created_s, CAST(doc_id AS VARCHAR) DESC) AS place FROM keyed)
"""


def _keyed(spark, d):
    return dup.blocks(dup.features(lib.documents(spark, d)))


@query("canonical_choices", "A17 J16 X10", using(_RECORDS) + """
SELECT rule, doc_id AS canonical_id, members FROM placed WHERE place = 1 AND members > 1""")
def canonical_choices(spark, d):
    return dup.groups(_keyed(spark, d)).select("rule", F.col("c.doc_id").alias("canonical_id"), "members")


@query("pair_verdicts", "X21 J16 X13 X20", using(_RECORDS) + """
SELECT m.rule, m.doc_id AS duplicate_id, c.doc_id AS canonical_id, CASE WHEN m.identity = c.identity AND m.url_language <> c.url_language THEN 'translation'
  WHEN m.media OR c.media THEN 'related_media' WHEN m.h = c.h AND m.url_language = c.url_language AND m.meaningful AND c.meaningful THEN 'exact_duplicate' ELSE 'open' END AS verdict
FROM placed m JOIN placed c ON c.rule = m.rule AND c.key = m.key AND c.place = 1 WHERE m.place > 1""")
def pair_verdicts(spark, d):
    judged = dup.judge_without_text(dup.pairs(_keyed(spark, d)))
    return judged.select("rule", "duplicate_id", "canonical_id",
                         F.coalesce("verdict.classification", F.lit("open")).alias("verdict"))


@query("settled_verdicts", "A18 X21", using(_RECORDS) + """,
judged AS (SELECT m.rule, m.key, m.doc_id AS duplicate_id, c.doc_id AS canonical_id, CASE WHEN m.identity = c.identity AND m.url_language <> c.url_language THEN 'translation'
  WHEN m.media OR c.media THEN 'related_media' WHEN m.h = c.h AND m.url_language = c.url_language AND m.meaningful AND c.meaningful THEN 'exact_duplicate' END AS verdict
  FROM placed m JOIN placed c ON c.rule = m.rule AND c.key = m.key AND c.place = 1 WHERE m.place > 1)
SELECT duplicate_id, canonical_id, classification, rule FROM (SELECT *, verdict AS classification, row_number() OVER (PARTITION BY duplicate_id ORDER BY
  CASE verdict WHEN 'exact_duplicate' THEN 60 WHEN 'translation' THEN 50 WHEN 'related_media' THEN 30 END DESC, rule) AS rn FROM judged WHERE verdict IS NOT NULL) WHERE rn = 1""")
def settled_verdicts(spark, d):
    judged = dup.judge_without_text(dup.pairs(_keyed(spark, d))).where("verdict IS NOT NULL")
    return dup.best_verdicts(judged.withColumn("similarity", F.lit(None).cast("double"))).select(
        "duplicate_id", "canonical_id", "classification", "rule")


@query("duplicate_decisions", "L2 X19 X21 A18 J17 U5")
def duplicate_decisions(spark, d):
    docs = lib.documents(spark, d)
    media = lib.table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("checksum"), F.col("n_chars").alias("size_bytes"))
    return dup.resolve(docs, media)


@query("flattened_roots", "J17", """
WITH RECURSIVE edges AS (SELECT doc_id AS node, doc_id // 3 AS parent, doc_id % 7 <> 0 AS follow FROM documents WHERE doc_id % 5 <> 0 AND doc_id // 3 <> doc_id),
chase AS (SELECT node, parent AS root, 0 AS n FROM edges UNION ALL
  SELECT c.node, e.parent, c.n + 1 FROM chase c JOIN edges e ON e.node = c.root AND e.follow)
SELECT node AS duplicate_id, arg_max(root, n) AS canonical_id, CASE WHEN max(n) > 0 THEN arg_min(root, n) END AS original_canonical_id FROM chase GROUP BY node""")
def flattened_roots(spark, d):
    doc = F.col("doc_id")
    edges = lib.table(spark, d, "documents").where("doc_id % 5 <> 0 AND doc_id div 3 <> doc_id").select(
        doc.alias("duplicate_id"), F.floor(doc / 3).alias("canonical_id"),
        F.when(doc % 7 != 0, "confirmed").otherwise("pending").alias("review_status"),
        F.lit("exact_duplicate").alias("classification"))
    return dup.flatten_roots(edges).select("duplicate_id", "canonical_id", "original_canonical_id")


@query("stored_decisions", "I5 U5", """
SELECT doc_id AS duplicate_id, CASE WHEN quality IS NOT NULL THEN 'stored' ELSE 'new' END AS origin FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL OR doc_id % 2 = 0""")
def stored_decisions(spark, d):
    found = lib.table(spark, d, "documents").where("doc_id % 2 = 0").select(
        F.col("doc_id").alias("duplicate_id"), F.lit("new").alias("origin"))
    stored = lib.table(spark, d, "labels").select(F.col("doc_id").alias("duplicate_id"), F.lit("stored").alias("origin"))
    return dup.store_new(found, stored)
