"""Joins."""

from pyspark.sql import Window, functions as F

from folioworks.functions import text as t
from folioworks.operators import catalog
from folioworks.operators.filters import ilike_any
from folioworks.registry import query
from folioworks.registry.prelude import DUPLICATES, JOBS, LIBRARY, NOTES, PARAGRAPHS, SOURCES, using
from folioworks.registry.projections import STATUS_SQL
from folioworks.sources import library as lib

HASH_SQL = r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("passages_by_source", "J1 J2", using(LIBRARY, SOURCES, PARAGRAPHS) + """
SELECT s.source_name, l.language, count(*) AS passages, CAST(sum(length(p.chunk_text)) AS BIGINT) AS characters
FROM paragraphs p JOIN library l USING (doc_id) JOIN sources s USING (source_key) GROUP BY ALL""")
def passages_by_source(spark, d):
    docs = lib.documents(spark, d).select("doc_id", "language", "source_key")
    return (lib.paragraphs(spark, d).join(docs, "doc_id").groupBy("source_key", "language")
            .agg(F.count("*").alias("passages"), F.sum(F.length("chunk_text")).alias("characters"))
            .join(lib.sources(spark, d), "source_key")
            .select("source_name", "language", "passages", "characters"))


@query("source_dashboard", "J4 A6 P6", using(LIBRARY, SOURCES, JOBS) + """,
ds AS (SELECT source_key, count(doc_id) AS documents, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters
  FROM library GROUP BY 1),
js AS (SELECT source_key, max(created_at) AS latest, count(*) FILTER (WHERE lower(status) IN ('failed', 'error')) AS errors
  FROM jobs WHERE source_key IS NOT NULL GROUP BY 1)
SELECT s.source_key, s.source_name, s.enabled, coalesce(s.rate_limit, CAST(nullif(s.cfg_rate, '') AS INT), 30) AS rate_limit,
  coalesce(CAST(nullif(s.cfg_pages, '') AS INT), 25) AS max_pages, s.cfg_language AS language,
  coalesce(ds.documents, 0) AS documents, coalesce(ds.characters, 0) AS characters,
  coalesce(ds.characters, 0) // 4 AS estimated_tokens, epoch_us(js.latest) AS latest_job_us, coalesce(js.errors, 0) AS errors
FROM sources s LEFT JOIN ds USING (source_key) LEFT JOIN js USING (source_key)""")
def source_dashboard(spark, d):
    return catalog.source_dashboard(lib.documents(spark, d), lib.jobs(spark, d), lib.sources(spark, d))


@query("visible_documents", "J5 A25", using(LIBRARY, DUPLICATES) + """
SELECT language, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS characters FROM library
WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE duplicate_id = doc_id) GROUP BY language""")
def visible_documents(spark, d):
    return (catalog.without_exact_copies(lib.documents(spark, d)).groupBy("language")
            .agg(F.count("*").alias("n"), F.sum("n_chars").alias("characters")))


@query("documents_without_vector", "J7 I9", rf"""
SELECT doc_id, {HASH_SQL} AS text_hash FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label < 7)""")
def documents_without_vector(spark, d):
    docs = lib.table(spark, d, "documents").select("doc_id", t.content_hash(F.col("text")).alias("text_hash"))
    vectors = lib.table(spark, d, "embeddings").where("label < 7").select(F.col("vec_id").alias("doc_id"))
    return docs.join(vectors, "doc_id", "left_anti")


@query("match_flags", "J8 F16", using(LIBRARY, PARAGRAPHS, NOTES) + """
SELECT doc_id, EXISTS (SELECT 1 FROM paragraphs p WHERE p.doc_id = l.doc_id AND (p.chunk_text ILIKE '%tion the%' OR p.chunk_text ILIKE '%de la%')) AS in_chunk,
  EXISTS (SELECT 1 FROM notes n WHERE n.doc_id = l.doc_id AND n.pinned) AS pinned_note FROM library l""")
def match_flags(spark, d):
    hits = (lib.paragraphs(spark, d).where(ilike_any(F.col("chunk_text"), ["%tion the%", "%de la%"]))
            .select("doc_id").distinct().withColumn("in_chunk", F.lit(True)))
    pinned = lib.notes(spark, d).where("pinned").select("doc_id").distinct().withColumn("pinned_note", F.lit(True))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return (lib.table(spark, d, "documents").select("doc_id").join(hits, "doc_id", "left")
            .join(pinned, "doc_id", "left").select("doc_id", flag("in_chunk"), flag("pinned_note")))


@query("first_matching_passage", "J9 R25", using(PARAGRAPHS) + """
SELECT d.doc_id, m.chunk_index, left(m.chunk_text, 450) AS excerpt FROM documents d
LEFT JOIN LATERAL (SELECT chunk_index, chunk_text FROM paragraphs p WHERE p.doc_id = d.doc_id AND p.chunk_text ILIKE '%and the%'
  ORDER BY chunk_index LIMIT 1) m ON TRUE""")
def first_matching_passage(spark, d):
    first = (lib.paragraphs(spark, d).where(F.ilike("chunk_text", F.lit("%and the%"))).groupBy("doc_id")
             .agg(F.min(F.struct("chunk_index", "chunk_text")).alias("m")))
    return lib.table(spark, d, "documents").select("doc_id").join(first, "doc_id", "left").select(
        "doc_id", F.col("m.chunk_index").cast("bigint").alias("chunk_index"),
        F.left("m.chunk_text", F.lit(450)).alias("excerpt"))


@query("largest_line_per_order", "J9 A17", """
SELECT o.o_orderkey, l.l_linenumber, l.l_extendedprice FROM orders o
LEFT JOIN LATERAL (SELECT l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey = o.o_orderkey
  ORDER BY l_extendedprice DESC, l_linenumber, l_partkey LIMIT 1) l ON TRUE""")
def largest_line_per_order(spark, d):
    best = (lib.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("ln"))).alias("b")))
    return lib.table(spark, d, "orders").select("o_orderkey").join(best, "o_orderkey", "left").select(
        "o_orderkey", (-F.col("b.ln")).alias("l_linenumber"), F.col("b.l_extendedprice").alias("l_extendedprice"))


@query("tag_usage", "J10 J20", using(LIBRARY) + """
SELECT tag, count(*) AS n, count(DISTINCT source_key) AS sources FROM (SELECT source_key, unnest(tags) AS tag FROM library) GROUP BY tag""")
def tag_usage(spark, d):
    return (lib.documents(spark, d).select("source_key", F.explode("tags").alias("tag")).groupBy("tag")
            .agg(F.count("*").alias("n"), F.countDistinct("source_key").alias("sources")))


@query("passage_counts", "J11 R18", using(PARAGRAPHS) + """
SELECT d.doc_id, (SELECT count(*) FROM paragraphs p WHERE p.doc_id = d.doc_id) AS chunks FROM documents d""")
def passage_counts(spark, d):
    counts = lib.paragraphs(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return lib.table(spark, d, "documents").select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("document_tags", "J12 J20 R18 U3", using(LIBRARY) + """,
tag_dim AS (SELECT tag, upper(tag) || '!' AS label FROM (SELECT DISTINCT unnest(tags) AS tag FROM library))
SELECT l.doc_id, coalesce((SELECT string_agg(t.label, '|' ORDER BY t.label) FROM (SELECT unnest(x.tags) AS tag FROM library x
    WHERE x.doc_id = l.doc_id) u JOIN tag_dim t USING (tag)), '') AS labels FROM library l""")
def document_tags(spark, d):
    docs = lib.documents(spark, d).select("doc_id", "tags")
    links = docs.select("doc_id", F.explode("tags").alias("tag"))
    dim = links.select("tag").distinct().withColumn("label", F.concat(F.upper("tag"), F.lit("!")))
    named = links.join(dim, "tag").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"))
    return docs.select("doc_id").join(named, "doc_id", "left").select(
        "doc_id", F.coalesce("labels", F.lit("")).alias("labels"))


@query("cached_vectors", "J15 J13", rf"""
SELECT d.doc_id, c.label IS NOT NULL AS cached, c.label FROM (SELECT doc_id, {HASH_SQL} AS h FROM documents) d
LEFT JOIN (SELECT h, max(label) AS label FROM (SELECT {HASH_SQL} AS h, e.label FROM documents x JOIN embeddings e ON e.vec_id = x.doc_id
  WHERE len(e.embedding) = 64) GROUP BY h) c USING (h)""")
def cached_vectors(spark, d):
    docs = lib.table(spark, d, "documents").select("doc_id", t.content_hash(F.col("text")).alias("h"))
    vectors = lib.table(spark, d, "embeddings").where(F.size("embedding") == 64).select(
        F.col("vec_id").alias("doc_id"), "label")
    cache = docs.join(vectors, "doc_id").groupBy("h").agg(F.max("label").alias("label"))
    from folioworks.operators.skew import join_group_facts

    per_hash = docs.groupBy("h").agg(F.count("*").alias("n")).join(cache, "h", "left")
    return join_group_facts(docs, per_hash, ["h"], "n").select(
        "doc_id", F.col("label").isNotNull().alias("cached"), "label")


@query("restore_from_audit", "J18 R45", using(SOURCES) + """,
audit AS (SELECT source_key, enabled AS previous_enabled, cfg_language AS previous_language FROM sources WHERE source_key LIKE 'src1%')
SELECT s.source_key, coalesce(a.previous_enabled, NOT s.enabled) AS enabled,
  CASE WHEN a.source_key IS NOT NULL THEN a.previous_language ELSE 'xx' END AS language
FROM sources s LEFT JOIN audit a USING (source_key)""")
def restore_from_audit(spark, d):
    sources = lib.sources(spark, d).select("source_key", "enabled", F.col("config")["language"].alias("language"))
    audit = sources.where("source_key LIKE 'src1%'").select(
        "source_key", F.col("enabled").alias("previous_enabled"), F.col("language").alias("previous_language"),
        F.lit(True).alias("audited"))
    changed = sources.select("source_key", (~F.col("enabled")).alias("enabled"), F.lit("xx").alias("language"))
    return changed.join(audit, "source_key", "left").select(
        "source_key", F.coalesce("previous_enabled", "enabled").alias("enabled"),
        F.when(F.col("audited"), F.col("previous_language")).otherwise(F.col("language")).alias("language"))


@query("workspaces_with_sources", "J21", using(NOTES, LIBRARY) + """
SELECT DISTINCT n.workspace_id, n.user_id FROM notes n LEFT JOIN library l USING (doc_id)
WHERE n.deleted_s IS NULL AND (l.source_key = 'src3' OR l.language = 'es')""")
def workspaces_with_sources(spark, d):
    wanted = lib.documents(spark, d).where("source_key = 'src3' OR language = 'es'").select("doc_id")
    return (lib.notes(spark, d).where("deleted_at IS NULL").join(wanted, "doc_id", "left_semi")
            .select("workspace_id", "user_id").distinct())


@query("reading_history", "W8 J22", """
SELECT user_id, rn, k, p_name FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, k) AS rn
  FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, max(ts) AS last_ts FROM events GROUP BY 1, 2))
JOIN part ON p_partkey = k WHERE rn <= 80""")
def reading_history(spark, d):
    seen = (lib.table(spark, d, "events")
            .select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")
            .groupBy("user_id", "k").agg(F.max("ts").alias("last_ts")))
    newest = Window.partitionBy("user_id").orderBy(F.desc("last_ts"), "k")
    recent = seen.withColumn("rn", F.row_number().over(newest)).where("rn <= 80")
    part = lib.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return recent.join(part, "k").select("user_id", F.col("rn").cast("bigint").alias("rn"), "k", "p_name")


@query("segment_revenue", "J4 J2", """
SELECT c.c_mktsegment, n.n_name, count(*) AS orders, CAST(sum(v.value) AS DOUBLE) AS value
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS value FROM lineitem GROUP BY 1) v ON v.l_orderkey = o.o_orderkey
GROUP BY ALL""")
def segment_revenue(spark, d):
    value = (lib.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")
                        * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("value")))
    per_customer = (lib.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(value, "o_orderkey")
                    .groupBy(F.col("o_custkey").alias("c_custkey"))
                    .agg(F.count("*").alias("orders"), F.sum("value").alias("value")))
    nation = lib.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return (per_customer.join(lib.table(spark, d, "customer"), "c_custkey").join(nation, "c_nationkey")
            .groupBy("c_mktsegment", "n_name")
            .agg(F.sum("orders").alias("orders"), F.sum("value").cast("double").alias("value")))


@query("document_details", "R18 J11 J12", using(LIBRARY, SOURCES, PARAGRAPHS) + f"""
SELECT l.doc_id, l.title, s.source_name, {STATUS_SQL} AS display_status, CAST(year(l.published_on) AS INTEGER) AS year,
  array_to_string(list_concat(l.tags, CASE WHEN l.doc_id % 2 = 0 THEN ['extra'] ELSE [] END), '|') AS tags, sha256(l.text) AS text_hash,
  coalesce(p.n, 0) AS chunks_available, coalesce(p.shown, '') AS chunks
FROM library l JOIN sources s USING (source_key) LEFT JOIN (SELECT doc_id, count(*) AS n,
    sha256(string_agg(chunk_text, chr(10) ORDER BY chunk_index) FILTER (WHERE rn <= 200)) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS rn FROM paragraphs) GROUP BY 1) p ON p.doc_id = l.doc_id WHERE l.deleted_s IS NULL""")
def document_details(spark, d):
    docs = lib.documents(spark, d)
    tags = docs.where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit("Faith"), F.lit("extra"))).alias("tag"))
    found = catalog.document_detail(docs, lib.sources(spark, d), lib.paragraphs(spark, d), tags)
    shown = F.sha2(F.array_join(F.col("chunks.chunk_text"), "\n"), 256)
    return found.select("doc_id", "title", "source_name", "display_status", "year", F.array_join("tags", "|").alias("tags"),
                        F.sha2("text", 256).alias("text_hash"), "chunks_available", F.coalesce(shown, F.lit("")).alias("chunks"))
