"""Incremental and stateful steps, batch and streaming."""

from pyspark.sql import functions as F

from folioworks.functions import text as t, urls
from folioworks.operators import incremental as inc
from folioworks.registry import query
from folioworks.registry.joins import HASH_SQL
from folioworks.registry.prelude import LIBRARY, SOURCES, using
from folioworks.sources import library as lib, seeds
from folioworks.streaming import windows as stream


def _stored(spark, d):
    """Older half of the corpus, some of it with another text."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" older"))).otherwise(F.col("text"))
    return lib.table(spark, d, "documents").where("doc_id % 3 <> 0").select(
        "doc_id", F.concat(F.lit("https://x.org/"), "doc_id").alias("canonical_url"), t.content_hash(text).alias("content_hash"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("version"), F.lit(True).alias("is_indexed"),
        F.create_map(F.lit("kept"), F.lit("yes")).alias("raw_metadata"))


def _incoming(spark, d):
    return lib.table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("https://x.org/"), "doc_id").alias("canonical_url"),
        t.content_hash(F.col("text")).alias("content_hash"),
        F.create_map(F.lit("source_type"), F.col("source")).alias("raw_metadata"))


@query("document_actions", "I1 X1", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'created' WHEN doc_id % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS action,
  CAST(CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 4 = 0 THEN doc_id % 5 + 2 ELSE doc_id % 5 + 1 END AS INTEGER) AS version FROM documents""")
def document_actions(spark, d):
    return inc.document_actions(_stored(spark, d), _incoming(spark, d)).select("doc_id", "action", "version")


@query("upserted_documents", "I1 X50", """
SELECT 'https://x.org/' || doc_id AS canonical_url, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 4 = 0 THEN doc_id % 5 + 2 ELSE doc_id % 5 + 1 END AS INTEGER) AS version,
  doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS is_indexed, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS kept_metadata FROM documents""")
def upserted_documents(spark, d):
    merged = inc.upsert_documents(_stored(spark, d), _incoming(spark, d))
    return merged.select("canonical_url", "version", "is_indexed",
                         F.map_contains_key("raw_metadata", F.lit("kept")).alias("kept_metadata"))


@query("upserted_urls", "I2", """
SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 10 IN (2, 4) THEN 'fetched' ELSE 'queued' END AS status,
  CASE WHEN page_id % 2 = 0 AND page_id % 10 IN (2, 4) THEN 1 ELSE 3 END AS depth FROM pages""")
def upserted_urls(spark, d):
    pages = lib.table(spark, d, "pages")
    known = F.when(F.col("page_id") % 10 == 0, "failed").when(F.col("page_id") % 10 == 6, "discovered").when(
        F.col("page_id") % 10 == 8, "queued").otherwise("fetched")
    row = lambda df, status, depth: df.select(
        F.lit("s").alias("source_key"), F.col("page_id").cast("string").alias("normalized_url"), "url",
        status.alias("status"), F.lit(depth).alias("depth"))
    merged = inc.upsert_urls(row(pages.where("page_id % 2 = 0"), known, 1), row(pages, F.lit("queued"), 3))
    return merged.select(F.col("normalized_url").cast("bigint").alias("page_id"), "status", "depth")


@query("inserted_assets", "I3 R29 R2", """
SELECT url, min(page_id) AS page_id FROM (SELECT page_id, 'https://cdn/' || (page_id % 40) AS url FROM pages) GROUP BY url""")
def inserted_assets(spark, d):
    assets = lib.table(spark, d, "pages").select(F.concat(F.lit("https://cdn/"), F.col("page_id") % 40).alias("url"), "page_id")
    stored = assets.where("page_id < 15")
    return inc.insert_absent(stored, assets, ["url"], F.col("page_id"))


@query("upserted_sources", "I4 S9", using(SOURCES) + """
SELECT source_key, source_name AS source_name, coalesce(rate_limit, 30) AS rate_limit, cfg_language AS language, true AS observed FROM sources
UNION ALL SELECT k, n, r, l, false FROM (VALUES ('byu_speeches_es', 'BYU Speeches Espanol', 30, 'es'), ('byu_speeches', 'BYU Speeches English', 30, 'en'),
  ('discursos_sud', 'Discursos SUD', 20, 'es'), ('general_conference', 'Conferencia General', 20, 'es'), ('church_manuals', 'Manuales de la Iglesia', 20, 'es'),
  ('joseph_smith_papers', 'Joseph Smith Papers', 20, 'en'), ('byu_rsc', 'BYU Religious Studies Center', 20, 'en'), ('come_follow_me', 'Come, Follow Me', 20, 'es'),
  ('teachings_presidents', 'Teachings of Presidents of the Church', 20, 'en'), ('scriptures', 'Escrituras', 20, 'es')) v(k, n, r, l)""")
def upserted_sources(spark, d):
    stored = lib.sources(spark, d).select(
        "source_key", "source_name", F.col("config")["language"].alias("language"),
        F.coalesce("rate_limit", F.lit(30)).alias("rate_limit"), "config").withColumn("base_url", F.lit(None).cast("string"))
    given = seeds.seed_sources(spark).withColumn("config", F.create_map(F.lit("seed"), F.lit("true")))
    merged = inc.upsert_sources(stored, given)
    return merged.select("source_key", "source_name", "rate_limit", "language",
                         (~F.map_contains_key("config", F.lit("seed"))).alias("observed"))


@query("upserted_access", "I7 R13 R14", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_mktsegment END AS name FROM customer""")
def upserted_access(spark, d):
    base = lib.table(spark, d, "customer").select("c_custkey", F.lit("pending").alias("status"), F.col("c_mktsegment").alias("name"))
    patch = base.where("c_custkey % 2 = 0").select(
        "c_custkey", F.lit("approved").alias("status"), F.when(F.col("c_custkey") % 3 == 0, "new").alias("name"))
    return inc.upsert_excluded(base, patch, "c_custkey", ["status"], ["name"])


@query("ingest_outcomes", "I8 R28 R29", rf"""
WITH items AS (SELECT doc_id, 'u' || (doc_id // 3) AS url, 's' || (doc_id % 300) AS src, {HASH_SQL} AS h, lang = 'es' OR doc_id < 100 AS stored FROM documents),
asked AS (SELECT doc_id + 1000000 AS item_id, 'u' || (doc_id // 3 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 5000 END) AS url, 'q' || (doc_id % 400) AS src, {HASH_SQL} AS h FROM documents),
old AS (SELECT a.item_id, min(s.doc_id) AS existing_id FROM asked a JOIN items s ON s.stored AND (s.url IN (a.url, a.src) OR s.src IN (a.url, a.src) OR s.h = a.h) GROUP BY 1),
fresh AS (SELECT * FROM asked WHERE item_id NOT IN (SELECT item_id FROM old)),
own AS (SELECT a.item_id, min(b.item_id) AS existing_id FROM fresh a JOIN fresh b ON b.url IN (a.url, a.src) OR b.src IN (a.url, a.src) OR a.h = b.h GROUP BY 1)
SELECT item_id, 'verified_existing' AS status, existing_id FROM old UNION ALL
SELECT item_id, CASE WHEN existing_id = item_id THEN 'created' ELSE 'verified_existing' END, existing_id FROM own""")
def ingest_outcomes(spark, d):
    docs = lib.table(spark, d, "documents").withColumn("content_hash", t.content_hash(F.col("text")))
    doc = F.col("doc_id")
    third = F.floor(doc / 3)
    stored = docs.where("lang = 'es' OR doc_id < 100").select(
        "doc_id", doc.alias("created_at"), F.concat(F.lit("u"), third).alias("canonical_url"), "content_hash",
        F.create_map(F.lit("source_url"), F.concat(F.lit("s"), doc % 300)).alias("raw_metadata"))
    incoming = docs.select(
        (doc + 1000000).alias("item_id"), F.concat(F.lit("u"), third + F.when(doc % 2 == 0, 0).otherwise(5000)).alias("canonical_url"),
        F.concat(F.lit("q"), doc % 400).alias("source_url"), "content_hash")
    return inc.ingest_first_wins(incoming, stored)


@query("index_work", "I9 J7 I17 R35", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'create' WHEN doc_id % 7 = 0 THEN 'rebuild' WHEN doc_id % 3 = 0 THEN 'none' ELSE 'embed_missing' END AS work,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 0 ELSE 2 END AS missing FROM documents""")
def index_work(spark, d):
    docs = lib.table(spark, d, "documents").select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))
    chunks = docs.where("doc_id % 5 <> 0").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("content_hash")).alias("document_content_hash"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("ix")).withColumn(
        "chunk_id", F.col("doc_id") * 10 + F.col("ix")).withColumn("text_hash", F.sha2(F.col("chunk_id").cast("string"), 256))
    return inc.index_work(docs, chunks, chunks.where("doc_id % 3 = 0")).select(
        "doc_id", "work", F.col("missing").cast("int").alias("missing"))


@query("patched_orders", "R3 R4", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS server_rev FROM orders""")
def patched_orders(spark, d):
    orders = lib.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("server_rev", F.lit(1))
    patch = orders.where("o_orderkey % 2 = 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return inc.update_non_null(orders, patch, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("sync_page", "I18", """
SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 1000""")
def sync_page(spark, d):
    log = lib.table(spark, d, "events").select(
        "event_id", "user_id", F.col("ts").alias("created_at"), F.col("event_id").alias("server_rev"))
    return inc.sync_page(log, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id")


@query("job_runs", "I12", """
WITH log AS (SELECT user_id AS job_id, ts AS moment, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retry' ELSE 'note' END AS event,
  CAST(json_extract(props, '$.k') AS BIGINT) AS found FROM events),
r AS (SELECT job_id, max(moment) AS since FROM log WHERE event = 'retry' GROUP BY 1),
live AS (SELECT l.* FROM log l LEFT JOIN r USING (job_id) WHERE since IS NULL OR moment >= since)
SELECT job_id, arg_max(event, moment) AS last_event, count(*) FILTER (WHERE event = 'start') AS attempts, CAST(sum(found) AS BIGINT) AS found,
  epoch_us(max(moment) FILTER (WHERE event IN ('done', 'failed'))) AS finished_us FROM live GROUP BY 1""")
def job_runs(spark, d):
    kind = (F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done")
            .when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "retry").otherwise("note"))
    log = lib.table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("event"),
        F.get_json_object("props", "$.k").cast("bigint").alias("found"), F.lit("boom").alias("error"))
    return inc.job_runs(log).select("job_id", "last_event", "attempts", "found", F.unix_micros("finished_at").alias("finished_us"))


@query("rate_limit_windows", "I13", """
SELECT user_id, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS window_us, count(*) AS hits, greatest(count(*) - 1, 0) AS rejected FROM events GROUP BY 1, 2""")
def rate_limit_windows(spark, d):
    events = lib.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return inc.rate_limited(events, "1 minute", 1, ["user_id"]).select(
        "user_id", F.unix_micros("window_start").alias("window_us"), "hits", "rejected")


@query("daily_quota_windows", "I14 R36", """
SELECT event_type, user_id, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, count(*) AS hits, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2, 3""")
def daily_quota_windows(spark, d):
    events = lib.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return inc.rate_limited(events, "1 day", 2, ["event_type", "user_id"]).select(
        "event_type", "user_id", F.to_date("window_start").cast("string").alias("day"), "hits", "rejected")


@query("accepted_requests", "I13", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 40""")
def accepted_requests(spark, d):
    events = lib.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return inc.accepted(events, "1 day", 40, ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_id")


_SECONDS = "s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS lookups FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY second) AS rn FROM s)"
_TTL = using(_SECONDS) + """,
w AS (SELECT user_id, rn, second, lookups, true AS miss, second + {ttl} AS expires FROM o WHERE rn = 1 UNION ALL
  SELECT o.user_id, o.rn, o.second, o.lookups, o.second >= w.expires, CASE WHEN o.second >= w.expires THEN o.second + {ttl} ELSE w.expires END
  FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, second, lookups, miss FROM w"""


@query("cache_lookups", "I15 R11", _TTL.format(ttl=40000))
def cache_lookups(spark, d):
    return inc.cache_hits(lib.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", 40000)


@query("streamed_quota_windows", "I14 I16", """
SELECT event_type, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, count(*) AS hits, greatest(count(*) - 60, 0) AS rejected FROM events GROUP BY 1, 2""")
def streamed_quota_windows(spark, d):
    schema = lib.table(spark, d, "events").schema
    events = stream.event_stream(spark, d, "events.parquet", schema)
    counted = stream.rate_windows(events, "1 day", 60, ["event_type"], "10 minutes")
    return stream.latest_windows(counted, "quota", ["event_type", "window_start"]).select("event_type", F.to_date("window_start").cast("string").alias("day"), "hits", "rejected")


@query("streamed_cache_lookups", "I15", _TTL.format(ttl=40000))
def streamed_cache_lookups(spark, d):
    schema = lib.table(spark, d, "events").schema
    events = stream.event_stream(spark, d, "events.parquet", schema)
    return stream.materialize(stream.ttl_lookups(events, "user_id", 40000, "10 minutes"), "ttl")


@query("requeued_urls", "I2 X11 X11c", using(LIBRARY) + """
SELECT source_key, count(DISTINCT regexp_replace(lower(regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*')) || regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*([^?#]*)', 1), '/$', '')
  || CASE WHEN canonical_url LIKE '%?%' THEN '?' || regexp_replace(split_part(split_part(canonical_url, '?', 2), '#', 1), '&utm_source=feed', '') ELSE '' END) AS urls FROM library GROUP BY 1""")
def requeued_urls(spark, d):
    return lib.documents(spark, d).groupBy("source_key").agg(
        F.countDistinct(urls.canonical(F.col("canonical_url"))).alias("urls"))


@query("prioritized_lookup", "R30", using(LIBRARY) + """
SELECT source_key, doc_id FROM (SELECT source_key, doc_id, row_number() OVER (PARTITION BY source_key ORDER BY CASE WHEN coalesce(author, '') = 'José Núñez' THEN 0 ELSE 1 END, doc_id) AS rn FROM library) WHERE rn = 1""")
def prioritized_lookup(spark, d):
    docs = lib.documents(spark, d).select("source_key", "doc_id", "author")
    exact = F.coalesce("author", F.lit("")) == "José Núñez"
    return inc.prioritized(docs, "source_key", exact, "doc_id").select("source_key", "doc_id")


@query("sources_patched_by_id_or_key", "R17", using(SOURCES) + """
SELECT source_key, CASE WHEN num % 2 = 0 OR num % 3 = 0 THEN false ELSE enabled END AS enabled,
  CASE WHEN num % 2 = 0 THEN 10 + num WHEN num % 3 = 0 THEN 20 + num ELSE rate_limit END AS rate_limit
FROM (SELECT *, CAST(substr(source_key, 4) AS INTEGER) AS num FROM sources)""")
def sources_patched_by_id_or_key(spark, d):
    num = F.substr("source_key", F.lit(4)).cast("int")
    stored = lib.sources(spark, d).select(num.alias("source_id"), "source_key", "enabled", "rate_limit")
    off = F.lit(False).alias("enabled")
    patch = stored.where("source_id % 2 = 0").select(
        F.col("source_id").cast("string").alias("target"), off, (F.lit(10) + F.col("source_id")).alias("rate_limit")).unionByName(
        stored.where("source_id % 3 = 0").select(F.col("source_key").alias("target"), off, (F.lit(20) + F.col("source_id")).alias("rate_limit")))
    return inc.update_by_id_or_key(stored, patch, "source_id", "source_key", ["enabled", "rate_limit"]).select(
        "source_key", "enabled", "rate_limit")
