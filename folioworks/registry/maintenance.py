"""Maintenance jobs."""

from pyspark.sql import functions as F

from folioworks.functions import text as t
from folioworks.functions.spanish import slug
from folioworks.operators import catalog, maintenance as mnt
from folioworks.registry import ENTRIES, query
from folioworks.registry.prelude import LIBRARY, using
from folioworks.registry.scalars import repair_candidates as _  # noqa: F401  (registers the shared SQL)
from folioworks.registry.filters import cleanup_reasons as __  # noqa: F401
from folioworks.sources import library as lib

_TAGS_SQL = """
tags AS (SELECT p_partkey AS tag_id, name, desired, CASE WHEN p_partkey % 3 = 0 THEN desired ELSE 'old-' || p_partkey END AS slug FROM
  (SELECT p_partkey, name, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS desired FROM (SELECT p_partkey, p_name || ' ' || (p_size + p_partkey // 100 * 100) AS name FROM part))),
moves AS (SELECT * FROM tags WHERE slug <> desired),
judged AS (SELECT m.tag_id, m.slug, m.desired, coalesce((SELECT min(o.tag_id) FROM tags o WHERE o.slug = m.desired AND o.tag_id <> m.tag_id),
  (SELECT min(o.tag_id) FROM tags o WHERE o.desired = m.desired AND o.tag_id <> m.tag_id)) AS rival FROM moves m)
"""


def _tags(spark, d):
    name = F.concat("p_name", F.lit(" "), F.col("p_size") + F.floor(F.col("p_partkey") / 100) * 100)
    tags = lib.table(spark, d, "part").select(F.col("p_partkey").alias("tag_id"), name.alias("name"))
    return tags.withColumn("slug", F.when(F.col("tag_id") % 3 == 0, F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"))
                           .otherwise(F.concat(F.lit("old-"), "tag_id")))


@query("tag_slug_updates", "A23 I19 L10", using(_TAGS_SQL) + "SELECT tag_id, slug, desired FROM judged WHERE rival IS NULL")
def tag_slug_updates(spark, d):
    return mnt.tag_updates(_tags(spark, d), slug)[0]


@query("tag_slug_conflicts", "A23 I19 L10", using(_TAGS_SQL) + "SELECT tag_id, slug, desired, rival FROM judged WHERE rival IS NOT NULL")
def tag_slug_conflicts(spark, d):
    return mnt.tag_updates(_tags(spark, d), slug)[1]


@query("change_report", "A22 R33 L10", using(LIBRARY) + r""",
c AS (SELECT doc_id, 'text' AS column_name, text AS before, trim(regexp_replace(text, '\s+', ' ', 'g')) AS after FROM library
  UNION ALL SELECT doc_id, 'title', title, trim(regexp_replace(title, '\s+', ' ', 'g')) FROM library UNION ALL SELECT doc_id, 'author', author, trim(author) FROM library)
SELECT column_name, count(*) AS detected, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE rn <= 3) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY doc_id) AS rn FROM c WHERE before IS DISTINCT FROM after) GROUP BY 1""")
def change_report(spark, d):
    pair = lambda c, after: (F.col(c), after)
    report = mnt.change_report(lib.documents(spark, d), {
        "text": pair("text", t.collapse_ws(F.col("text"))), "title": pair("title", t.collapse_ws(F.col("title"))),
        "author": pair("author", F.trim("author"))})
    return report.withColumn("examples", F.array_join("examples", ","))


@query("new_repairs", "I6 L9", f"""
SELECT r.doc_id, r.field, r.repaired FROM ({ENTRIES['repair_candidates'].sql}) r
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id AND r.field = 'title')""")
def new_repairs(spark, d):
    audit = lib.table(spark, d, "labels").select("doc_id", F.lit("title").alias("field"))
    return mnt.new_audits(mnt.repair_candidates(lib.documents(spark, d)), audit).select("doc_id", "field", "repaired")


@query("repaired_documents", "I6 L9 X24", using(LIBRARY) + f""",
rep AS ({ENTRIES['repair_candidates'].sql})
SELECT doc_id, coalesce((SELECT repaired FROM rep WHERE rep.doc_id = l.doc_id AND field = 'title'), title) AS title,
  coalesce((SELECT repaired FROM rep WHERE rep.doc_id = l.doc_id AND field = 'author'), author) AS author,
  is_indexed AND NOT EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = l.doc_id) AS is_indexed FROM library l""")
def repaired_documents(spark, d):
    docs = lib.documents(spark, d)
    return mnt.apply_repairs(docs, mnt.repair_candidates(docs)).select("doc_id", "title", "author", "is_indexed")


@query("soft_deleted", "I11 L11 F22", using(LIBRARY) + """
SELECT CASE WHEN language = 'en' AND deleted_s IS NULL THEN 'HIDDEN' ELSE status END AS status, count(*) AS n,
  count(*) FILTER (WHERE deleted_s IS NOT NULL OR language = 'en') AS deleted, count(*) FILTER (WHERE is_indexed AND NOT (language = 'en' AND deleted_s IS NULL)) AS indexed FROM library GROUP BY 1""")
def soft_deleted(spark, d):
    docs = lib.documents(spark, d)
    after = mnt.soft_delete(docs, docs.where("language = 'en'"), F.timestamp_seconds(F.lit(1735689600)))
    return after.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if(F.col("is_indexed")).alias("indexed"))


@query("hard_deleted", "I11 R35", """
SELECT d.source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY 1""")
def hard_deleted(spark, d):
    doomed = lib.table(spark, d, "labels").where("toxic = 1")
    return mnt.hard_delete(lib.table(spark, d, "documents"), doomed).groupBy("source").agg(F.count("*").alias("n"))


@query("legacy_sources", "R45 J18", """
SELECT s_suppkey, k AS source_key, CASE k WHEN 'byu_speeches_en' THEN 'byu_speeches' WHEN 'discursosud' THEN 'discursos_sud' WHEN 'josephsmithpapers' THEN 'joseph_smith_papers' END AS replacement,
  k NOT IN ('byu_speeches_en', 'discursosud', 'josephsmithpapers', 'churchofjesuschrist') AS enabled
FROM (SELECT s_suppkey, ['byu_speeches_en', 'discursosud', 'josephsmithpapers', 'churchofjesuschrist', 'scriptures', 'rsc'][s_suppkey % 6 + 1] AS k FROM supplier)""")
def legacy_sources(spark, d):
    from folioworks import fixed_values as fv

    names = F.array(*[F.lit(k) for k in ("byu_speeches_en", "discursosud", "josephsmithpapers", "churchofjesuschrist", "scriptures", "rsc")])
    key = F.get(names, (F.col("s_suppkey") % 6).cast("int"))
    known = {k: v for k, v in fv.LEGACY_REPLACEMENTS.items() if v}
    return lib.table(spark, d, "supplier").select("s_suppkey", key.alias("source_key")).select(
        "s_suppkey", "source_key", t.literal_map(known)[F.col("source_key")].alias("replacement"),
        (~F.col("source_key").isin(*fv.LEGACY_REPLACEMENTS)).alias("enabled"))


@query("active_without_copies", "J5 S1 L2", using(LIBRARY) + r"""
SELECT source_key, count(*) AS n FROM library l WHERE deleted_s IS NULL AND NOT EXISTS (SELECT 1 FROM library o WHERE o.doc_id < l.doc_id AND o.deleted_s IS NULL AND o.language = l.language
  AND sha256(trim(regexp_replace(o.text, '\s+', ' ', 'g'))) = sha256(trim(regexp_replace(l.text, '\s+', ' ', 'g'))) AND trim(regexp_replace(replace(lower(o.title), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) = trim(regexp_replace(replace(lower(l.title), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))) GROUP BY 1""")
def active_without_copies(spark, d):
    kept = catalog.without_exact_copies(lib.documents(spark, d))
    return catalog.active(kept).groupBy("source_key").agg(F.count("*").alias("n"))
