"""Chunkers."""

from pyspark.sql import functions as F

from folioworks.functions import text as t
from folioworks.operators import chunking, usage
from folioworks.plans import index_run, pipelines
from folioworks.registry import query
from folioworks.registry.prelude import PARAGRAPHS, USAGE, using
from folioworks.session import scratch_path
from folioworks.sources import library as lib


@query("smart_chunks", "T1 W5 X2 R35")
def smart_chunks(spark, d):
    return chunking.smart_chunks(lib.table(spark, d, "documents")).select(
        "doc_id", "chunk_index", "section_title", "start_char", "end_char", "token_count", "text_hash")


def _nearest(pattern: str, text: str, width: int) -> str:
    """The end of the separator nearest to the goal: the last one before it or the first one after it."""
    before = f"nullif(length(regexp_extract(ahead, '(?s)^.*{pattern}')), 0) + start + 800"
    after = f"nullif(instr(behind, {text}), 0) + start + 999 + {width}"
    return f"CASE WHEN abs({before} - start - 1000) > abs({after} - start - 1000) THEN {after} ELSE coalesce({before}, {after}) END"


_ENDS = ", ".join(_nearest(*mark) for mark in (
    (r"\n\n", "chr(10) || chr(10)", 2), (r"\. ", "'. '", 2), ("; ", "'; '", 2), (", ", "', '", 2), (" ", "' '", 1)))
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FIXED_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
cuts AS (
  SELECT doc_id, 0 AS chunk_index, n, n - length(ltrim(text, {_BLANK})) AS start,
    substr(text, n - length(ltrim(text, {_BLANK})) + 801, 201) AS ahead, substr(text, n - length(ltrim(text, {_BLANK})) + 1001, 201) AS behind
  FROM d WHERE ltrim(text, {_BLANK}) <> ''
  UNION ALL
  SELECT doc_id, chunk_index + 1, n, start, substr(text, start + 801, 201), substr(text, start + 1001, 201) FROM (
    SELECT c.doc_id, c.chunk_index, c.n, d.text, c.n - length(ltrim(substr(d.text, c.stop + 1), {_BLANK})) AS start
    FROM (SELECT *, CASE WHEN n - start <= 1200 THEN n ELSE coalesce({_ENDS}, start + 1200) END AS stop FROM cuts) c JOIN d USING (doc_id))
  WHERE start < n),
spans AS (SELECT c.doc_id, chunk_index, start, rtrim(substr(d.text, start + 1, coalesce(lead(start) OVER (PARTITION BY c.doc_id ORDER BY chunk_index), c.n) - start), {_BLANK}) AS body
  FROM cuts c JOIN d USING (doc_id))
SELECT doc_id, chunk_index, CAST(start AS INTEGER) AS start_char, CAST(start + length(body) AS INTEGER) AS end_char,
  CAST(len(regexp_extract_all(body, '[^ \\t\\n\\x0b\\f\\r]+')) AS INTEGER) AS token_count, sha256(body) AS text_hash FROM spans"""


@query("fixed_chunks", "T2", _FIXED_SQL)
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(lib.table(spark, d, "documents")).select(
        "doc_id", "chunk_index", "start_char", "end_char", "token_count", "text_hash")


@query("embedding_plan", "I10 A8 R36")
def embedding_plan(spark, d):
    chunks = chunking.smart_chunks(lib.table(spark, d, "documents"))
    return usage.embedding_plan(chunks, daily_limit=100_000, batch_size=64)


@query("budgeted_batches", "I10 A8 R36", using(PARAGRAPHS, USAGE) + r""",
chunks AS (SELECT doc_id, chunk_index // 4 AS batch, sha256(trim(regexp_replace(chunk_text, '\s+', ' ', 'g'))) AS h,
  len(regexp_extract_all(chunk_text, '[\p{L}\p{N}_]+|[^\t\n\f\r\x0B \p{L}\p{N}_]')) AS tokens FROM paragraphs),
first AS (SELECT h, min((doc_id, batch)) AS f, bool_or(doc_id % 5 = 0) AS stored FROM chunks GROUP BY h),
batches AS (SELECT doc_id, batch, count(*) AS chunks, count(*) FILTER (WHERE stored OR f <> (doc_id, batch)) AS cached,
  CAST(coalesce(sum(tokens) FILTER (WHERE NOT stored AND f = (doc_id, batch)), 0) AS BIGINT) AS tokens FROM chunks JOIN first USING (h) GROUP BY 1, 2),
used AS (SELECT coalesce(sum(input_tokens), 0) AS n FROM usage WHERE kind = 'embedding' AND status = 'ok'
  AND created_at >= (SELECT date_trunc('day', max(created_at)) FROM usage))
SELECT doc_id, batch, chunks, cached, tokens, CAST(sum(tokens) OVER w AS BIGINT) AS total_tokens,
  sum(tokens) OVER w + (SELECT n FROM used) <= 400000 AS admitted FROM batches WINDOW w AS (ORDER BY doc_id, batch)""")
def budgeted_batches(spark, d):
    chunks = lib.paragraphs(spark, d).select(
        "doc_id", "chunk_index", t.content_hash(F.col("chunk_text")).alias("text_hash"),
        t.token_count(F.col("chunk_text")).cast("bigint").alias("token_count"))
    events = lib.usage(spark, d)
    used = usage.budget_state(events, events.agg(F.max("created_at").alias("now")).scalar()).select("used_today").scalar()
    return usage.embedding_plan(chunks, 400_000, 4, cache=chunks.where("doc_id % 5 = 0"), used_today=used)


@query("crawl_to_index", "I17 L1 T1 I9 I10 R42")
def crawl_to_index(spark, d):
    records = pipelines.crawl_to_documents(lib.table(spark, d, "pages"))
    documents = records.select(F.col("page_id").alias("doc_id"), "text", "language")
    return pipelines.documents_to_index(documents, "quality")[1]


@query("resumed_index_run", "I17 R35 I9", """
WITH now AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, doc_id % 3 <> 0 AS early, doc_id % 5 = 0 AS drafted FROM documents),
first_lines AS (SELECT DISTINCT line FROM (SELECT unnest(lines) AS line FROM now WHERE early UNION ALL SELECT 'Draft') WHERE line <> ''),
passages AS (SELECT n.doc_id, n.early AND NOT n.drafted AS settled, f.line IS NOT NULL AS known
  FROM (SELECT doc_id, early, drafted, unnest(lines) AS line FROM now) n LEFT JOIN first_lines f USING (line) WHERE n.line <> '')
SELECT n.doc_id, CASE WHEN n.early AND NOT n.drafted THEN 1 ELSE 2 END AS run, count(p.doc_id) AS passages,
  count(*) FILTER (WHERE NOT p.settled AND p.known) AS reused FROM now n LEFT JOIN passages p USING (doc_id) GROUP BY ALL""")
def resumed_index_run(spark, d):
    docs = lib.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    draft = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Draft\n"), "text")).otherwise(F.col("text"))
    run = index_run.IndexRun(spark, scratch_path(spark, "index"), index_run.line_passages, index_run.profile_vectors, parts=8)
    run.run(docs.where("doc_id % 3 <> 0").withColumn("text", draft), 1)
    run.run(docs, 2)
    return run.state()
