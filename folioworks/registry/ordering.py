"""Windows, budgets, sorts and top-k."""

from pyspark.sql import Window, functions as F

from folioworks import fixed_values as fv
from folioworks.functions import text as t
from folioworks.operators import catalog, ranking, study
from folioworks.operators.filters import source_type_of
from folioworks.registry import query
from folioworks.registry.prelude import LIBRARY, NOTES, PARAGRAPHS, SOURCES, using
from folioworks.sources import library as lib

TOKENS_SQL = r"len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\t\n\f\r\x0B \p{{L}}\p{{N}}_]'))"


def _turns(spark, d):
    return lib.table(spark, d, "conversations").select(
        "conv_id", F.col("turn") + 1, "role",
        t.token_count(F.col("text")).cast("bigint").alias("tokens")).toDF("conv_id", "rank", "role", "tokens")


_TURNS = f"turns AS (SELECT conv_id, turn + 1 AS rank, role, CAST({TOKENS_SQL.format(c='text')} AS BIGINT) AS tokens FROM conversations)"


@query("context_skipping_budget", "W3 X2", using(_TURNS) + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS rn FROM turns),
walk AS (
  SELECT conv_id, rn, rank, tokens, tokens <= 160 AS kept, CASE WHEN tokens <= 160 THEN tokens ELSE 0 END AS used FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.conv_id, o.rn, o.rank, o.tokens, w.used + o.tokens <= 160, CASE WHEN w.used + o.tokens <= 160 THEN w.used + o.tokens ELSE w.used END
  FROM walk w JOIN ordered o ON o.conv_id = w.conv_id AND o.rn = w.rn + 1)
SELECT conv_id, rank, tokens FROM walk WHERE kept""")
def context_skipping_budget(spark, d):
    return ranking.fit_skipping(_turns(spark, d), ["conv_id"], "rank", "tokens", 160).select(
        "conv_id", "rank", "tokens")


@query("candidate_prefix_budget", "W4 X2", using(_TURNS) + """
SELECT conv_id, rank, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) AS used FROM turns) WHERE used <= 200""")
def candidate_prefix_budget(spark, d):
    return ranking.fit_prefix(_turns(spark, d), ["conv_id"], "rank", "tokens", 200, bucket_rows=4).select(
        "conv_id", "rank", "tokens")


@query("overlap_tail", "W5", using(PARAGRAPHS) + f"""
SELECT doc_id, count(*) AS passages, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT doc_id, tokens, sum(tokens) OVER (PARTITION BY doc_id ORDER BY chunk_index DESC) AS tail
  FROM (SELECT doc_id, chunk_index, {TOKENS_SQL.format(c='chunk_text')} AS tokens FROM paragraphs)) WHERE tail <= 120 GROUP BY doc_id""")
def overlap_tail(spark, d):
    # One document is the unit of work, so the window never exceeds one text.
    from_end = Window.partitionBy("doc_id").orderBy(F.desc("chunk_index"))
    return (lib.paragraphs(spark, d).withColumn("tokens", t.token_count(F.col("chunk_text")))
            .withColumn("tail", F.sum("tokens").over(from_end)).where("tail <= 120").groupBy("doc_id")
            .agg(F.count("*").alias("passages"), F.sum("tokens").alias("tokens")))


@query("normalized_scores", "W6", using(_TURNS) + """
SELECT conv_id, rank, round(CASE WHEN lo = hi THEN CASE WHEN tokens > 0 THEN 1.0 ELSE 0.0 END ELSE (tokens - lo) / (hi - lo) END, 9) AS score
FROM (SELECT *, min(tokens) OVER (PARTITION BY conv_id) AS lo, max(tokens) OVER (PARTITION BY conv_id) AS hi FROM turns)""")
def normalized_scores(spark, d):
    score = ranking.min_max(F.col("tokens").cast("double"), Window.partitionBy("conv_id"))
    return _turns(spark, d).select("conv_id", "rank", F.round(score, 9).alias("score"))


@query("recent_messages", "W7 R38", """
SELECT conv_id, turn, role, left((SELECT text FROM conversations f WHERE f.conv_id = c.conv_id AND f.turn = 0), 80) AS title
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) c WHERE back <= 5""")
def recent_messages(spark, d):
    return study.session_window(lib.table(spark, d, "conversations"), 5)


@query("diversified_passages", "W2", using(LIBRARY, PARAGRAPHS) + """,
scored AS (SELECT p.doc_id, p.chunk_index, l.source_key, length(p.chunk_text) AS score FROM paragraphs p JOIN library l USING (doc_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY score DESC, doc_id, chunk_index) AS rn FROM scored) WHERE rn <= 40)
SELECT source_key, doc_id, chunk_index, row_number() OVER (PARTITION BY source_key ORDER BY over3, score DESC, doc_id, chunk_index) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY source_key, doc_id ORDER BY score DESC, chunk_index) > 3 AS over3 FROM top)""")
def diversified_passages(spark, d):
    docs = lib.documents(spark, d).select("doc_id", "source_key")
    scored = lib.paragraphs(spark, d).select("doc_id", "chunk_index", F.length("chunk_text").alias("score")).join(
        docs, "doc_id")
    order = [F.desc("score"), F.col("doc_id"), F.col("chunk_index")]
    top = ranking.top_per_group(scored, ["source_key"], order, 40)
    return ranking.diversify(top, ["source_key"], "doc_id", order).select(
        "source_key", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("position").cast("bigint").alias("position"))


@query("recent_documents", "O7 O8", using(LIBRARY) + """
SELECT doc_id, updated_s, left(text, 900) AS excerpt FROM library WHERE deleted_s IS NULL ORDER BY updated_s DESC, doc_id LIMIT 5""")
def recent_documents(spark, d):
    return (catalog.active(lib.documents(spark, d))
            .select("doc_id", F.unix_seconds("updated_at").alias("updated_s"), F.left("text", F.lit(900)).alias("excerpt"))
            .orderBy(F.desc("updated_s"), "doc_id").limit(5))


@query("pinned_first", "O9 R1", using(NOTES) + """
SELECT note_id, pinned, updated_s FROM notes WHERE deleted_s IS NULL ORDER BY pinned DESC, updated_s DESC, note_id LIMIT 100""")
def pinned_first(spark, d):
    return (lib.notes(spark, d).where("deleted_at IS NULL")
            .select("note_id", "pinned", F.unix_seconds("updated_at").alias("updated_s"))
            .orderBy(F.desc("pinned"), F.desc("updated_s"), "note_id").limit(100))


@query("workspace_blocks", "O10 R6", using(NOTES) + """,
blocks AS (SELECT workspace_id, note_id AS block_id, 'note' AS kind, turn * 10 AS sort_order, updated_s FROM notes WHERE NOT pinned AND deleted_s IS NULL
  UNION ALL SELECT workspace_id, note_id + 500, 'post_it', (turn % 2) * 10, updated_s FROM notes WHERE pinned AND deleted_s IS NULL)
SELECT workspace_id, block_id, kind, row_number() OVER (PARTITION BY workspace_id ORDER BY sort_order, updated_s, block_id) AS position FROM blocks""")
def workspace_blocks(spark, d):
    live = lib.notes(spark, d).where("deleted_at IS NULL")
    return study.ordered_blocks(
        live.where("NOT pinned").withColumn("sort_order", F.col("turn") * 10),
        live.where("pinned").withColumn("note_id", F.col("note_id") + 500)
        .withColumn("sort_order", F.col("turn") % 2 * 10))


_RELATED = ["thest", "tion", "que", "ander"]


@query("related_by_terms", "O5 R9 R7 X38", using(LIBRARY, SOURCES) + f"""
SELECT doc_id, source_name, score FROM (SELECT doc_id, source_key, updated_s,
    CAST({' + '.join(f"CASE WHEN title ILIKE '%{x}%' OR coalesce(text, '') ILIKE '%{x}%' THEN 1 ELSE 0 END" for x in _RELATED)} AS DOUBLE) AS score
  FROM library WHERE deleted_s IS NULL AND ({' OR '.join(f"title ILIKE '%{x}%' OR coalesce(text, '') ILIKE '%{x}%' OR coalesce(author, '') ILIKE '%{x}%'" for x in _RELATED)}))
JOIN sources USING (source_key) ORDER BY score DESC, updated_s DESC, doc_id LIMIT 20""")
def related_by_terms(spark, d):
    return study.related_documents(
        lib.documents(spark, d), lib.sources(spark, d), "thest, tion; que an ander", 20)


_TALK = ["tion", "inthe", "nsh"]
_TALK_SCORE = " + ".join(
    f"CASE WHEN title ILIKE '%{x}%' THEN 3 WHEN coalesce(text, '') ILIKE '%{x}%' THEN 1 ELSE 0 END" for x in _TALK)
_TALK_MATCH = " OR ".join(
    f"title ILIKE '%{x}%' OR coalesce(text, '') ILIKE '%{x}%' OR coalesce(author, '') ILIKE '%{x}%' OR coalesce(category, '') ILIKE '%{x}%' OR CAST(to_json(tags) AS VARCHAR) ILIKE '%{x}%'"
    for x in _TALK)


@query("talk_documents", "O6 L7 F15", using(LIBRARY) + f"""
SELECT doc_id, score, source_type FROM (SELECT doc_id, coalesce(meta_source_type, source_key) AS source_type, updated_s, CAST({_TALK_SCORE} AS BIGINT) AS score
  FROM library WHERE deleted_s IS NULL AND (language = 'en' OR language IS NULL) AND ({_TALK_MATCH}))
ORDER BY score DESC, updated_s DESC, doc_id LIMIT 15""")
def talk_documents(spark, d):
    docs = lib.documents(spark, d)
    return study.talk_documents(docs, "Tion inthe about (nsh)", [], 15, language="en").select(
        "doc_id", F.col("match_score").cast("bigint").alias("score"), source_type_of(docs).alias("source_type"))


@query("saved_quotes", "R23 O7", using(NOTES) + """
SELECT note_id, updated_s FROM notes WHERE user_id = 3 AND deleted_s IS NULL AND (content ILIKE '%tion%' OR content ILIKE '%mateo%')
ORDER BY updated_s DESC, note_id LIMIT 12""")
def saved_quotes(spark, d):
    like = [f"%{x}%" for x in ("tion", "mateo")]
    hit = t.either([F.ilike("content", F.lit(p)) for p in like])
    return (lib.notes(spark, d).where((F.col("user_id") == 3) & F.col("deleted_at").isNull() & hit)
            .select("note_id", F.unix_seconds("updated_at").alias("updated_s"))
            .orderBy(F.desc("updated_s"), "note_id").limit(12))
