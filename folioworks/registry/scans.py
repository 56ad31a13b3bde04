"""Scans, sources and sinks."""

from pyspark.sql import functions as F, types as T

from folioworks.functions.text import raw_hash
from folioworks.functions.urls import asset_key
from folioworks.operators import catalog, schemas
from folioworks.registry import query
from folioworks.registry.prelude import LIBRARY, using
from folioworks.session import inline_table
from folioworks.sources import library as lib


@query("active_documents", "S1", using(LIBRARY) + """
SELECT language, count(*) AS n FROM library WHERE deleted_s IS NULL GROUP BY language""")
def active_documents(spark, d):
    return catalog.active(lib.documents(spark, d)).groupBy("language").agg(F.count("*").alias("n"))


@query("column_profile", "S2", """
SELECT 'doc_id' AS column_name, 'bigint' AS data_type, count(doc_id) AS filled FROM documents UNION ALL
SELECT 'text', 'string', count(text) FROM documents UNION ALL
SELECT 'lang', 'string', count(lang) FROM documents UNION ALL
SELECT 'source', 'string', count(source) FROM documents UNION ALL
SELECT 'n_chars', 'bigint', count(n_chars) FROM documents""")
def column_profile(spark, d):
    docs = lib.table(spark, d, "documents")
    filled = docs.agg(*[F.count(c).alias(c) for c in docs.columns])
    listed = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"), F.col(name).alias("filled"))
        for name, kind in docs.dtypes])
    return filled.select(F.inline(listed))


@query("scanned_page_ratio", "S6", r"""
SELECT doc_id, low, pages, low / pages > 0.35 AS needs_ocr
FROM (SELECT doc_id, CAST(len(list_filter(p, lambda x: length(trim(x)) < 80)) AS BIGINT) AS low,
        CAST(len(p) AS BIGINT) AS pages
      FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))""")
def scanned_page_ratio(spark, d):
    pages = F.split("text", "\n")
    low = F.size(F.filter(pages, lambda p: F.length(F.trim(p)) < 80)).cast("bigint")
    return (lib.table(spark, d, "documents")
            .select("doc_id", low.alias("low"), F.size(pages).cast("bigint").alias("pages"))
            .withColumn("needs_ocr", F.col("low") / F.col("pages") > 0.35))


@query("stored_objects", "S8 R41 X1b", """
SELECT page_id, 'assets/' || sha256(url) || '.html' AS storage_key, sha256(html) AS checksum,
  CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes FROM pages""")
def stored_objects(spark, d):
    return lib.table(spark, d, "pages").select(
        "page_id", asset_key(F.col("url"), F.lit(".html")).alias("storage_key"),
        raw_hash(F.col("html")).alias("checksum"),
        F.octet_length("html").cast("bigint").alias("size_bytes"))


@query("expected_languages", "S11 J19", """
SELECT e.code, e.label, count(d.doc_id) AS documents
FROM (VALUES ('es', 'Spanish'), ('en', 'English'), ('pt', 'Portuguese'), ('fr', 'French'), ('de', 'German'))
  AS e(code, label) LEFT JOIN documents d ON d.lang = e.code GROUP BY e.code, e.label""")
def expected_languages(spark, d):
    counts = lib.table(spark, d, "documents").groupBy(F.col("lang").alias("code")).agg(
        F.count("*").alias("documents"))
    expected = spark.sql(
        "SELECT * FROM VALUES ('es', 'Spanish'), ('en', 'English'), ('pt', 'Portuguese'), ('fr', 'French'), "
        "('de', 'German') AS e(code, label)")
    return expected.join(counts, "code", "left").select(
        "code", "label", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("table_policies", "A24 R44 J19", using(LIBRARY) + """
SELECT p.visibility, p.allowed, count(l.doc_id) AS rows
FROM (VALUES ('READY', true), ('INDEXED', true), ('PENDING', false), ('FAILED', false), ('HIDDEN', false))
  AS p(visibility, allowed)
LEFT JOIN library l ON p.visibility = CASE WHEN l.is_indexed THEN 'INDEXED' ELSE upper(coalesce(l.status, 'PENDING')) END
GROUP BY p.visibility, p.allowed""")
def table_policies(spark, d):
    policies = inline_table(spark, ["visibility", "allowed"], [
        ("READY", True), ("INDEXED", True), ("PENDING", False), ("FAILED", False), ("HIDDEN", False)])
    counts = lib.documents(spark, d).groupBy(catalog.display_status().alias("visibility")).agg(
        F.count("*").alias("rows"))
    return policies.join(counts, "visibility", "left").select(
        "visibility", "allowed", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("schema_differences", "R32", """
SELECT 'documents' AS table_name, 'doc_id' AS path, 'bigint' AS expected, 'bigint' AS actual, 'same' AS verdict, count(doc_id) AS filled, NULL::BIGINT AS convertible FROM documents UNION ALL
SELECT 'documents', 'text', 'string', 'string', 'same', count(text), NULL FROM documents UNION ALL
SELECT 'documents', 'lang', NULL, 'string', 'extra', count(lang), NULL FROM documents UNION ALL
SELECT 'documents', 'source', 'int', 'string', 'incompatible', count(source), count(TRY_CAST(source AS INTEGER)) FROM documents UNION ALL
SELECT 'documents', 'n_chars', 'int', 'bigint', 'incompatible', count(n_chars), count(TRY_CAST(n_chars AS INTEGER)) FROM documents UNION ALL
SELECT 'documents', 'review', 'struct', NULL, 'missing', NULL, NULL UNION ALL
SELECT 'documents', 'review.score', 'double', NULL, 'missing', NULL, NULL UNION ALL
SELECT 'labels', 'doc_id', 'bigint', 'bigint', 'same', count(doc_id), NULL FROM labels UNION ALL
SELECT 'labels', 'quality', 'decimal(20,0)', 'int', 'widened', count(quality), NULL FROM labels UNION ALL
SELECT 'labels', 'toxic', 'boolean', 'int', 'incompatible', count(toxic), count(CAST(toxic AS BOOLEAN)) FROM labels""")
def schema_differences(spark, d):
    documents = T.StructType.fromDDL("doc_id bigint, text string, source int, n_chars int, review struct<score: double>")
    labels = T.StructType.fromDDL("doc_id bigint, quality decimal(20,0), toxic boolean")
    return schemas.schema_diff(lib.table(spark, d, "documents"), documents, "documents").unionAll(
        schemas.schema_diff(lib.table(spark, d, "labels"), labels, "labels"))
