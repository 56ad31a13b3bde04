"""Aggregations."""

from pyspark.sql import functions as F

from folioworks.functions import text as t, urls
from folioworks.operators import catalog, usage
from folioworks.registry import query
from folioworks.registry.joins import HASH_SQL
from folioworks.registry.prelude import DUPLICATES, JOBS, LIBRARY, NOTES, PARAGRAPHS, SOURCES, USAGE, using
from folioworks.registry.projections import STATUS_SQL
from folioworks import fixed_values as fv
from folioworks.session import spread, write_once
from folioworks.sources import library as lib


@query("status_summary", "A1 P3 J5", using(LIBRARY, DUPLICATES) + f"""
SELECT s.status, coalesce(c.n, 0) AS n FROM (VALUES ('READY'), ('PENDING'), ('FAILED'), ('INDEXED')) s(status)
LEFT JOIN (SELECT CASE WHEN st IN ('READY', 'PENDING', 'FAILED', 'INDEXED') THEN st ELSE 'PENDING' END AS status, count(*) AS n
  FROM (SELECT {STATUS_SQL} AS st FROM library WHERE doc_id NOT IN (SELECT duplicate_id FROM hidden)) GROUP BY 1) c USING (status)""")
def status_summary(spark, d):
    return catalog.status_summary(spark, catalog.without_exact_copies(lib.documents(spark, d)))


_CANON = " ".join(
    f"WHEN f IN ({', '.join(repr(a) for a in sorted({k, *v}))}) THEN '{k}'" for k, v in fv.SOURCE_ALIASES.items())
_DOMAIN = ", ".join(f"('{k}', '{v}')" for k, v in fv.SOURCE_LABELS.items())


@query("sources_summary", "A2 P2 X16", using(LIBRARY, SOURCES) + f"""
SELECT coalesce(dom.key, c.t) AS source_type, coalesce(dom.label, c.first_name) AS label, coalesce(c.n, 0) AS n,
  dom.key IS NOT NULL AS canonical
FROM (VALUES {_DOMAIN}) dom(key, label) FULL JOIN (
  SELECT t, CAST(sum(n) AS BIGINT) AS n, first(source_name ORDER BY n DESC, raw, source_key) AS first_name FROM (
    SELECT CASE {_CANON} ELSE f END AS t, raw, source_key, source_name, n FROM (
      SELECT replace(replace(lower(trim(raw)), '-', '_'), ' ', '_') AS f, raw, source_key, source_name, n FROM (
        SELECT coalesce(meta_source_type, source_key) AS raw, source_key, count(*) AS n FROM library GROUP BY 1, 2) JOIN sources USING (source_key)))
  GROUP BY t) c ON c.t = dom.key""")
def sources_summary(spark, d):
    return catalog.sources_summary(spark, lib.documents(spark, d), lib.sources(spark, d))


@query("author_counts", "A3", using(LIBRARY) + """
SELECT author, count(*) AS n FROM library WHERE author IS NOT NULL AND author <> '' GROUP BY author ORDER BY author LIMIT 30""")
def author_counts(spark, d):
    return catalog.author_counts(lib.documents(spark, d), 30)


@query("topic_counts", "A4 U1 J10", using(LIBRARY) + """
SELECT name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT tag AS name, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM library) GROUP BY 1
  UNION ALL SELECT category, count(*) FROM library WHERE category IS NOT NULL AND category <> '' GROUP BY 1)
GROUP BY name ORDER BY name LIMIT 50""")
def topic_counts(spark, d):
    return catalog.topic_counts(lib.documents(spark, d), 50)


@query("job_status_counts", "A5 I12", using(JOBS) + """
SELECT status, count(*) AS n, CAST(sum(documents_found) AS BIGINT) AS found FROM jobs GROUP BY status""")
def job_status_counts(spark, d):
    return lib.jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("documents_found").alias("found"))


@query("usage_by_kind", "A7 A11 R37", using(USAGE) + """
SELECT kind, CAST(sum(input_tokens) AS BIGINT) AS tokens, count(*) AS events,
  round(sum(CASE WHEN kind = 'embedding' THEN round_even(input_tokens / 1000 * CAST(0.00013 AS DOUBLE) * 1e6, 0) / 1e6 ELSE 0.0 END), 6) AS cost
FROM usage WHERE created_at >= (SELECT date_trunc('month', max(created_at)) FROM usage) GROUP BY kind""")
def usage_by_kind(spark, d):
    events = lib.usage(spark, d)
    now = events.agg(F.max("created_at").alias("now")).scalar()
    return usage.usage_by_kind(events, now).withColumn("cost", F.round("cost", 6))


@query("token_budget", "A8 A11 R37", using(USAGE) + """,
t AS (SELECT max(created_at) AS now FROM usage)
SELECT CAST(used_today AS BIGINT) AS used_today, CAST(used_month AS BIGINT) AS used_month,
  CAST(greatest(100000 - used_today, 0) AS BIGINT) AS remaining
FROM (SELECT coalesce(sum(input_tokens) FILTER (WHERE created_at >= date_trunc('day', now)), 0) AS used_today,
    coalesce(sum(input_tokens) FILTER (WHERE created_at >= date_trunc('month', now)), 0) AS used_month
  FROM usage, t WHERE kind = 'embedding' AND status = 'ok')""")
def token_budget(spark, d):
    events = lib.usage(spark, d)
    return usage.budget_state(events, events.agg(F.max("created_at").alias("now")).scalar())


@query("cache_statistics", "A9", rf"""
SELECT count(*) AS entries, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT {HASH_SQL} AS h, count(*) - 1 AS hits FROM documents GROUP BY 1)""")
def cache_statistics(spark, d):
    entries = lib.table(spark, d, "documents").groupBy(t.content_hash(F.col("text")).alias("h")).agg(
        (F.count("*") - 1).alias("hits"))
    return entries.agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"))


@query("indexing_estimate", "A10 A11 J7 J15", using(PARAGRAPHS) + r""",
chunks AS (SELECT doc_id, doc_id * 100000 + chunk_index AS chunk_id, sha256(trim(regexp_replace(chunk_text, '\s+', ' ', 'g'))) AS h,
  len(regexp_extract_all(chunk_text, '[\p{L}\p{N}_]+|[^\t\n\f\r\x0B \p{L}\p{N}_]')) AS tokens FROM paragraphs),
judged AS (SELECT c.*, c.doc_id % 3 = 0 AS done,
  EXISTS (SELECT 1 FROM chunks k WHERE k.h = c.h AND k.doc_id % 5 = 0) AS stored FROM chunks c)
SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(*) FILTER (WHERE done) AS skipped,
  count(*) FILTER (WHERE NOT done AND stored) AS cached, count(*) FILTER (WHERE NOT done AND NOT stored) AS to_embed,
  CAST(sum(CASE WHEN NOT done AND NOT stored THEN tokens ELSE 0 END) AS BIGINT) AS tokens,
  round_even(sum(CASE WHEN NOT done AND NOT stored THEN tokens ELSE 0 END) / 1000 * CAST(0.00013 AS DOUBLE) * 1e6, 0) / 1e6 AS cost FROM judged""")
def indexing_estimate(spark, d):
    chunks = spread(lib.paragraphs(spark, d)).select(
        "doc_id", (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"),
        t.content_hash(F.col("chunk_text")).alias("text_hash"), t.token_count(F.col("chunk_text")).alias("token_count"))
    chunks = write_once(chunks, "chunks")
    records = chunks.where("doc_id % 3 = 0")
    cache = chunks.where("doc_id % 5 = 0")
    return usage.indexing_estimate(chunks, records, cache)


@query("activity_metrics", "A12 A13", using(USAGE) + """
SELECT count(*) AS events, count(DISTINCT user_id) FILTER (WHERE created_at >= (SELECT max(created_at) FROM usage) - INTERVAL 30 DAY) AS active_users,
  count(*) FILTER (WHERE kind = 'embedding') AS embeddings, count(*) FILTER (WHERE status <> 'ok') AS failures FROM usage""")
def activity_metrics(spark, d):
    events = lib.usage(spark, d)
    return catalog.activity_metrics(events, events.agg(F.max("created_at").alias("now")).scalar())


@query("shared_media", "A14", """
SELECT checksum, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(text) AS checksum, n_chars FROM documents)
WHERE n_chars >= 1024 GROUP BY checksum HAVING count(DISTINCT doc_id) > 1""")
def shared_media(spark, d):
    assets = lib.table(spark, d, "documents").where("n_chars >= 1024").select(
        "doc_id", t.raw_hash(F.col("text")).alias("checksum"))
    return (assets.distinct().groupBy("checksum")
            .agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where("documents > 1"))


@query("relation_counts", "A15 A16", using(LIBRARY, PARAGRAPHS, NOTES) + """
SELECT l.doc_id, coalesce(r.n, 0) AS relations, coalesce(a.n, 0) AS assets FROM library l
LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM paragraphs UNION ALL SELECT doc_id FROM notes UNION ALL
  SELECT doc_id FROM labels UNION ALL SELECT vec_id FROM embeddings) GROUP BY 1) r USING (doc_id)
LEFT JOIN (SELECT page_id AS doc_id, count(*) AS n FROM pages GROUP BY 1) a USING (doc_id)""")
def relation_counts(spark, d):
    from folioworks.operators.duplicates import relation_totals

    related = [lib.paragraphs(spark, d), lib.notes(spark, d), lib.table(spark, d, "labels"),
               lib.table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")]
    assets = lib.table(spark, d, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.count("*").alias("assets"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (lib.table(spark, d, "documents").select("doc_id").join(relation_totals(related), "doc_id", "left")
            .join(assets, "doc_id", "left").select("doc_id", zero("relations"), zero("assets")))


@query("repair_counters", "A19 L9 X24", using(LIBRARY) + r"""
SELECT count(*) AS documents, count(*) FILTER (WHERE title = '' OR lower(title) LIKE '%:' AND length(title) < 30
  OR regexp_full_match(lower(title), 'part\s+\d+') OR length(title) > 180) AS needing_title FROM library""")
def repair_counters(spark, d):
    return lib.documents(spark, d).agg(
        F.count("*").alias("documents"), F.count_if(t.title_needs_repair(F.col("title"))).alias("needing_title"))


@query("next_sort_order", "A21", using(NOTES) + """
SELECT w.workspace_id, coalesce(max(n.turn) FILTER (WHERE n.pinned) * 10, 0) + 10 AS next_order
FROM (SELECT DISTINCT workspace_id FROM notes) w LEFT JOIN notes n USING (workspace_id) GROUP BY 1""")
def next_sort_order(spark, d):
    order = F.max(F.when(F.col("pinned"), F.col("turn") * 10))
    return lib.notes(spark, d).groupBy("workspace_id").agg((F.coalesce(order, F.lit(0)) + 10).alias("next_order"))


@query("global_counts", "A25 R48", using(LIBRARY, JOBS) + """
SELECT 'documents' AS metric, count(*) AS n FROM library UNION ALL SELECT 'failed_jobs', count(*) FROM jobs WHERE lower(status) = 'failed'
UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'vector_dimensions', max(len(embedding)) FROM embeddings""")
def global_counts(spark, d):
    one = lambda df, label, agg: df.agg(agg.cast("bigint").alias("n")).select(F.lit(label).alias("metric"), "n")
    vectors = lib.table(spark, d, "embeddings")
    return (one(lib.documents(spark, d), "documents", F.count("*"))
            .unionAll(one(lib.jobs(spark, d), "failed_jobs", F.count_if(F.lower("status") == "failed")))
            .unionAll(one(vectors, "vectors", F.count("*")))
            .unionAll(one(vectors, "vector_dimensions", F.max(F.size("embedding")))))


@query("counts_by_url_type", "X15 A2", using(LIBRARY) + """
SELECT CASE WHEN canonical_url LIKE '%speeches.byu.edu/spa/%' THEN 'byu_speeches_es' WHEN canonical_url LIKE '%speeches.byu.edu%' THEN 'byu_speeches_en'
  WHEN lower(canonical_url) LIKE '%discursosud.com%' THEN 'discursos_sud' WHEN canonical_url LIKE '%josephsmithpapers.org%' THEN 'joseph_smith_papers'
  WHEN canonical_url LIKE '%rsc.byu.edu%' THEN 'byu_rsc' WHEN canonical_url LIKE '%/general-conference%' THEN 'general_conference' END AS source_type, count(*) AS n
FROM library GROUP BY 1""")
def counts_by_url_type(spark, d):
    return lib.documents(spark, d).groupBy(
        urls.source_type(F.col("source_key"), F.col("canonical_url")).alias("source_type")).agg(F.count("*").alias("n"))


@query("usage_dashboard", "A13", using(LIBRARY, JOBS, USAGE, NOTES) + """,
ws AS (SELECT workspace_id, min(user_id) AS user_id, max(updated_s) AS updated_s, max(deleted_s) AS deleted_s FROM notes GROUP BY 1)
SELECT (SELECT count(*) FROM customer) AS beta_users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS approved_users,
  (SELECT count(DISTINCT user_id) FROM ws WHERE updated_s >= (SELECT max(updated_s) FROM notes) - 30 * 86400) AS active_users,
  (SELECT count(*) FROM ws WHERE deleted_s IS NULL) AS workspaces_created,
  (SELECT count(*) FROM notes WHERE deleted_s IS NULL AND NOT pinned) AS saved_quotes, (SELECT count(*) FROM notes WHERE deleted_s IS NULL AND pinned) AS post_its_created,
  (SELECT count(*) FROM usage WHERE kind = 'rerank') AS exports, (SELECT count(*) FROM conversations WHERE role = 'user') AS feedback,
  (SELECT count(*) FROM library WHERE is_indexed) AS documents_indexed, (SELECT count(*) FROM jobs WHERE lower(status) IN ('failed', 'error')) AS recent_errors""")
def usage_dashboard(spark, d):
    notes = lib.notes(spark, d)
    spaces = notes.groupBy("workspace_id").agg(
        F.min("user_id").alias("user_id"), F.max("updated_at").alias("updated_at"), F.max("deleted_at").alias("deleted_at"))
    access = lib.table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 0, "approved").otherwise("pending").alias("status"))
    return catalog.usage_dashboard(
        access, spaces, notes.withColumn("kind", F.when(F.col("pinned"), "post_it").otherwise("quote")),
        lib.usage(spark, d).select(F.when(F.col("kind") == "rerank", "export").otherwise("other").alias("kind")),
        lib.table(spark, d, "conversations").where("role = 'user'"), lib.documents(spark, d), lib.jobs(spark, d),
        notes.agg(F.max("updated_at").alias("now")).scalar())
