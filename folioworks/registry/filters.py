"""Filters and predicates."""

from datetime import date

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import text as t, urls
from folioworks.operators import catalog, filters as flt
from folioworks.registry import query
from folioworks.registry.prelude import JOBS, LIBRARY, NOTES, SOURCES, using
from folioworks.sources import library as lib


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query("metadata_filter", "F1 F2 F3 F8 F9 F13", using(LIBRARY) + """
SELECT doc_id FROM library
WHERE (coalesce(meta_source_type, source_key) IN ('byu', 'byu_speeches', 'byu_speeches_en', 'speeches_byu', 'src2', 'src3')
    OR source_key IN ('byu', 'byu_speeches', 'byu_speeches_en', 'speeches_byu', 'src2', 'src3'))
  AND language IN ('en', 'es') AND author IN ('Ana B. Reyes', 'José Núñez', 'Luis Mora Jr.')
  AND category IN ('Talks', 'Discursos') AND CAST(to_json(tags) AS VARCHAR) ILIKE '%fai%'
  AND published_on >= DATE '2000-02-01' AND published_on <= DATE '2021-06-30'
  AND coalesce(meta_is_seed, 'false') <> 'true'""")
def metadata_filter(spark, d):
    docs = lib.documents(spark, d)
    want = flt.MetadataFilter(
        source_keys=["BYU", "src2", "src3"], languages=["en", "es"],
        authors=["Ana B. Reyes", "José Núñez", "Luis Mora Jr."], categories=["Talks", "Discursos"], tags=["fai"],
        published_after=date(2000, 2, 1), published_before=date(2021, 6, 30), include_seed=False)
    return docs.where(flt.metadata_predicate(docs, want)).select("doc_id")


@query("payload_filter", "F4", using(LIBRARY) + """
SELECT doc_id, source_key FROM library WHERE language IN ('es', 'fr') AND source_key IN ('src1', 'src7', 'src12', 'src18')
  AND list_has_any(tags, ['Faith', 'temple'])""")
def payload_filter(spark, d):
    docs = lib.documents(spark, d)
    accepted = {"language": ["es", "fr"], "source_key": ["src1", "src7", "src12", "src18"],
                "tags": ["Faith", "temple"], "author": []}
    return docs.where(flt.payload_predicate(docs, accepted)).select("doc_id", "source_key")


@query("artifact_filter", "F5 J3", using(LIBRARY, NOTES) + """
SELECT n.note_id, n.doc_id FROM notes n JOIN library l USING (doc_id)
WHERE (l.category ILIKE '%talk%' OR CAST(to_json(l.tags) AS VARCHAR) ILIKE '%talk%'
    OR coalesce(l.meta_summary, '') ILIKE '%talk%' OR coalesce(l.meta_source_type, '') ILIKE '%talk%')
  AND (coalesce(l.meta_source_type, l.source_key) IN ('jsp', 'joseph_smith_papers', 'josephsmithpapers')
    OR l.source_key IN ('jsp', 'joseph_smith_papers', 'josephsmithpapers'))""")
def artifact_filter(spark, d):
    return flt.artifact_filter(lib.notes(spark, d), lib.documents(spark, d), source="jsp", topic="talk").select(
        "note_id", "doc_id")


@query("substring_any", "F6 F7 U3", """
SELECT doc_id, text ILIKE '%nthe on%' AS whole, (text ILIKE '%de la%' OR text ILIKE '%und%' OR text ILIKE '%LES%') AS any_of
FROM documents WHERE text ILIKE '%nthe on%' OR text ILIKE '%de la%' OR text ILIKE '%und%' OR text ILIKE '%LES%'""")
def substring_any(spark, d):
    whole = flt.ilike_any(F.col("text"), ["%nthe on%"])
    several = flt.ilike_any(F.col("text"), ["%de la%", "%und%", "%LES%"])
    return lib.table(spark, d, "documents").where(whole | several).select(
        "doc_id", whole.alias("whole"), several.alias("any_of"))


@query("failed_jobs", "F11 O8 R16", using(JOBS) + """
SELECT job_id, status, epoch_us(coalesce(finished_at, started_at, created_at)) AS at_us, CAST(len(errors) AS BIGINT) AS n_errors
FROM jobs WHERE lower(status) IN ('failed', 'error') OR len(errors) > 0
ORDER BY coalesce(finished_at, started_at, created_at) DESC, job_id LIMIT 100""")
def failed_jobs(spark, d):
    at = F.coalesce("finished_at", "started_at", "created_at")
    return (lib.jobs(spark, d).where(F.lower("status").isin("failed", "error") | (F.size("errors") > 0))
            .select("job_id", "status", F.unix_micros(at).alias("at_us"),
                    F.size("errors").cast("bigint").alias("n_errors"))
            .orderBy(F.desc("at_us"), "job_id").limit(100))


@query("failed_documents", "F10 R16 O7", using(LIBRARY) + """
SELECT doc_id, status, meta_error AS error, updated_s FROM library
WHERE upper(coalesce(status, '')) = 'FAILED' OR meta_error IS NOT NULL ORDER BY updated_s DESC, doc_id LIMIT 100""")
def failed_documents(spark, d):
    return (lib.documents(spark, d)
            .where((F.upper(F.coalesce("status", F.lit(""))) == "FAILED")
                   | F.map_contains_key("raw_metadata", F.lit("error")))
            .select("doc_id", "status", F.col("raw_metadata")["error"].alias("error"),
                    F.unix_seconds("updated_at").alias("updated_s"))
            .orderBy(F.desc("updated_s"), "doc_id").limit(100))


@query("distinct_from", "F12 R21", using(LIBRARY) + """
SELECT doc_id, author FROM library WHERE author IS DISTINCT FROM 'Ana B. Reyes' AND status IS DISTINCT FROM 'ready'""")
def distinct_from(spark, d):
    return lib.documents(spark, d).where(
        ~F.col("author").eqNullSafe("Ana B. Reyes") & ~F.col("status").eqNullSafe("ready")).select("doc_id", "author")


@query("private_source_search", "F14 R12", using(LIBRARY) + """
SELECT doc_id FROM library WHERE concat_ws(' ', title, author, source_key, language, category, meta_summary,
  CAST(to_json(tags) AS VARCHAR)) ILIKE '%mora jr. src%'""")
def private_source_search(spark, d):
    docs = lib.documents(spark, d)
    joined = F.concat_ws(" ", "title", "author", "source_key", "language", "category",
                         F.col("raw_metadata")["summary"], F.to_json("tags"))
    return docs.where(F.ilike(joined, F.lit("%mora jr. src%"))).select("doc_id")


@query("language_or_null", "F15", using(LIBRARY) + """
SELECT doc_id, lang FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE language END AS lang FROM library)
WHERE lang = 'fr' OR lang IS NULL""")
def language_or_null(spark, d):
    docs = lib.documents(spark, d).withColumn(
        "language", F.when(F.col("doc_id") % 6 != 0, F.col("language")))
    return docs.where(flt.language_or_null("fr")).select("doc_id", F.col("language").alias("lang"))


@query("fuzzy_suggestions", "F17", r"""
SELECT c_custkey AS key, round(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))), 6) AS score
FROM (SELECT c_custkey, list_distinct(flatten(list_transform(
    list_filter(string_split(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g,
    ['  b', ' bu', 'bui', 'uil', 'ild', 'ldi', 'din', 'ing', 'ng ', '  0', ' 00', '000', '001', '012', '12 '] AS q
  FROM (SELECT c_custkey, c_mktsegment || ' ' || substr(c_name, 14) AS name FROM customer))
WHERE len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) > 0.3
ORDER BY len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) DESC, c_custkey LIMIT 10""")
def fuzzy_suggestions(spark, d):
    name = F.concat("c_mktsegment", F.lit(" "), F.substr("c_name", F.lit(14)))
    score = t.trigram_similarity(t.trigrams(name), t.trigrams(F.lit("building 00012")))
    return (lib.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), score.alias("raw"))
            .where(F.col("raw") > 0.3).orderBy(F.desc("raw"), "key").limit(10)
            .select("key", F.round("raw", 6).alias("score")))


@query("row_ownership", "F18", using(LIBRARY, NOTES) + """
SELECT 'own' AS policy, count(*) AS n FROM notes WHERE user_id = 5 UNION ALL
SELECT 'parent', count(*) FROM notes WHERE workspace_id IN (SELECT c FROM
  (SELECT workspace_id AS c, min(user_id) AS u FROM notes GROUP BY 1) WHERE u = 5) UNION ALL
SELECT 'public', count(*) FROM library WHERE upper(status) = 'READY' AND deleted_s IS NULL""")
def row_ownership(spark, d):
    notes = lib.notes(spark, d)
    workspaces = notes.groupBy("workspace_id").agg(F.min("user_id").alias("user_id"))
    counted = lambda df, label: df.agg(F.count("*").alias("n")).select(F.lit(label).alias("policy"), "n")
    return (counted(flt.owned_by(notes, 5), "own")
            .unionAll(counted(flt.owned_through_parent(notes.drop("user_id"), workspaces, "workspace_id", 5), "parent"))
            .unionAll(counted(flt.publicly_readable(lib.documents(spark, d)), "public")))


_BLOCK_SQL = " ".join(f"WHEN contains(head, '{p}') THEN '{p}'" for p in fv.BLOCK_PHRASES)


@query("block_detection", "F19", f"""
SELECT page_id, CASE WHEN status IN (403, 429, 503) THEN 'http_status_' || status {_BLOCK_SQL} END AS reason
FROM (SELECT page_id, CASE page_id % 12 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS status,
  lower(left(CASE WHEN page_id % 5 = 0 THEN 'Please verify you are Human ' WHEN page_id % 7 = 0 THEN 'Access DENIED '
    ELSE '' END || html, 8000)) AS head FROM pages)""")
def block_detection(spark, d):
    page = F.col("page_id")
    status = F.when(page % 12 == 0, 403).when(page % 12 == 1, 429).when(page % 12 == 2, 503).otherwise(200)
    shown = F.when(page % 5 == 0, "Please verify you are Human ").when(page % 7 == 0, "Access DENIED ").otherwise("")
    return lib.table(spark, d, "pages").select(
        "page_id", t.block_reason(F.concat(shown, "html"), status).alias("reason"))


@query("asset_validation", "F20", """
SELECT page_id, CASE WHEN status >= 400 THEN 'Asset returned HTTP ' || status WHEN body = '' THEN 'Asset response was empty'
  WHEN kind LIKE '%text/html%' OR kind LIKE '%application/xhtml%' OR lower(url) LIKE '%/study/login%'
    THEN 'Asset URL resolved to HTML/login content (' || url || ')'
  WHEN asset = 'pdf' AND NOT contains(left(body, 1024), '%PDF-')
    THEN 'PDF signature missing (content-type: ' || coalesce(nullif(kind, ''), 'unknown') || ')' END AS error
FROM (SELECT page_id, url, CASE page_id % 9 WHEN 0 THEN 404 ELSE 200 END AS status,
  CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1.7 ' || html ELSE html END AS body,
  CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' ELSE '' END AS kind,
  CASE WHEN page_id % 2 = 0 THEN 'mp3' ELSE 'pdf' END AS asset FROM pages)""")
def asset_validation(spark, d):
    from folioworks.operators.assets import response_error

    page = F.col("page_id")
    return lib.table(spark, d, "pages").select("page_id", response_error(
        asset_type=F.when(page % 2 == 0, "mp3").otherwise("pdf"), url=F.col("url"),
        status=F.when(page % 9 == 0, 404).otherwise(200),
        content=F.when(page % 8 == 0, "").when(page % 8 == 1, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html")),
        content_type=F.when(page % 3 == 0, "text/html").when(page % 3 == 1, "application/pdf").otherwise(""),
    ).alias("error"))


@query("html_candidates", "F21", r"""
SELECT page_id, NOT regexp_matches(split_part(lower(u), '?', 1), '\.(jpg|jpeg|png|gif|webp|svg|zip|mp4|mov)$')
  AND (k = '' OR k LIKE '%text/html%' OR k LIKE '%text/plain%') AS html_like
FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/cover.JPG' ELSE '' END AS u,
  CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' ELSE '' END AS k
  FROM pages)""")
def html_candidates(spark, d):
    page = F.col("page_id")
    url = F.concat("url", F.when(page % 5 == 0, "/cover.JPG").otherwise(""))
    kind = (F.when(page % 4 == 0, "text/html; charset=utf-8").when(page % 4 == 1, "application/pdf")
            .when(page % 4 == 2, "text/plain").otherwise(""))
    return lib.table(spark, d, "pages").select("page_id", urls.looks_like_html(url, kind).alias("html_like"))


_CLEANUP_SQL = "".join(
    f", CASE WHEN contains(body, '{m}') THEN 'texto placeholder: {m}' END" for m in fv.CLEANUP_PLACEHOLDERS)


@query("cleanup_reasons", "F22 L11", using(LIBRARY) + f"""
SELECT doc_id, array_to_string(reasons, '|') AS reasons FROM (
  SELECT doc_id, list_filter([CASE WHEN lower(language) = 'en' THEN 'language=en' END,
    CASE WHEN contains(lower(source_url), 'lang=eng') THEN 'source_url contiene lang=eng' END,
    CASE WHEN contains(lower(canonical_url), 'lang=eng') THEN 'canonical_url contiene lang=eng' END,
    CASE WHEN contains(lower(coalesce(meta_source_url, '')), 'lang=eng') THEN 'metadata.source_url contiene lang=eng' END,
    CASE WHEN contains(lower(title), 'documento de prueba') THEN 'título de documento de prueba' END,
    CASE WHEN contains(lower(source_url), 'prueba-n8n') OR contains(lower(canonical_url), 'prueba-n8n') THEN 'URL de prueba n8n' END
    {_CLEANUP_SQL}], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, coalesce(meta_source_url, canonical_url) AS source_url,
      lower(CASE WHEN doc_id % 13 = 0 THEN text || ' Placeholder' ELSE text END || chr(10) || coalesce(meta_summary, '')) AS body
    FROM library))
WHERE len(reasons) > 0""")
def cleanup_reasons(spark, d):
    from folioworks.operators.maintenance import cleanup_reasons as reasons

    docs = lib.documents(spark, d)
    docs = docs.withColumn("source_url", catalog.source_url_of(docs)).withColumn(
        "text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" Placeholder"))).otherwise(F.col("text")))
    return (docs.select("doc_id", reasons().alias("reasons")).where(F.size("reasons") > 0)
            .withColumn("reasons", F.array_join("reasons", "|")))


_ES, _EN = _sql_list(fv.SPANISH_MARKERS), _sql_list(fv.ENGLISH_MARKERS)


@query("spanish_gate", "F23", f"""
SELECT doc_id, words, es, en, words > 0 AND es >= 8 AND es / words >= 0.025 AND en <= es AS spanish
FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS words,
    CAST(len(list_filter(w, lambda x: x IN ({_ES}))) AS BIGINT) AS es,
    CAST(len(list_filter(w, lambda x: x IN ({_EN}))) AS BIGINT) AS en
  FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-záéíóúüñ]+') AS w FROM documents))""")
def spanish_gate(spark, d):
    text = F.col("text")
    return lib.table(spark, d, "documents").select(
        "doc_id", t.word_total(text).cast("bigint").alias("words"),
        t.marker_counts(text, fv.SPANISH_MARKERS).cast("bigint").alias("es"),
        t.marker_counts(text, fv.ENGLISH_MARKERS).cast("bigint").alias("en"), t.appears_spanish(text).alias("spanish"))


@query("raw_html_gate", "F25 F26", r"""
SELECT page_id, regexp_matches(lower(c), '<html|<body|<script|<style|<nav|<header|<footer')
    OR len(regexp_extract_all(c, '</?[a-zA-Z][^>]*>')) >= 3 AS raw_html,
  contains(lower(c), 'placeholder') OR contains(lower(c), 'contenido de prueba') AS placeholder
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN regexp_replace(html, '<[^>]*>', '', 'g')
  WHEN 2 THEN '<b>x</b>' || url ELSE 'Contenido de PRUEBA ' || url END AS c FROM pages)""")
def raw_html_gate(spark, d):
    page = F.col("page_id") % 4
    c = (F.when(page == 0, F.col("html")).when(page == 1, F.regexp_replace("html", "<[^>]*>", ""))
         .when(page == 2, F.concat(F.lit("<b>x</b>"), "url")).otherwise(F.concat(F.lit("Contenido de PRUEBA "), "url")))
    return lib.table(spark, d, "pages").select(
        "page_id", t.contains_raw_html(c).alias("raw_html"), t.contains_placeholder(c).alias("placeholder"))


@query("language_parameter", "F27", using(LIBRARY) + """
SELECT doc_id, regexp_matches(canonical_url, '[?&]lang=(deu|eng|fra)(&|#|$)') AS foreign_language FROM library""")
def language_parameter(spark, d):
    return lib.documents(spark, d).select(
        "doc_id", urls.non_spanish_parameter(F.col("canonical_url")).alias("foreign_language"))


_LEAD = " OR ".join(f"contains(lower(q), '{x}')" for x in fv.LEADERSHIP_TERMS)


@query("question_flags", "F29 F30", f"""
SELECT conv_id, turn, {_LEAD} AS leadership,
  contains(lower(q), 'quota') OR contains(lower(q), '429') OR contains(lower(q), 'rate limit') AS quota
FROM (SELECT conv_id, turn, text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' Primera Presidencia?' WHEN 1 THEN ' Current President'
  WHEN 2 THEN ' HTTP 429' WHEN 3 THEN ' insufficient_QUOTA' ELSE '' END AS q FROM conversations)""")
def question_flags(spark, d):
    key = (F.col("conv_id") + F.col("turn")) % 5
    q = F.concat("text", F.when(key == 0, " Primera Presidencia?").when(key == 1, " Current President")
                 .when(key == 2, " HTTP 429").when(key == 3, " insufficient_QUOTA").otherwise(""))
    return lib.table(spark, d, "conversations").select(
        "conv_id", "turn", t.leadership_query(q).alias("leadership"), t.quota_error(q).alias("quota"))


@query("repair_flags", "F31", using(LIBRARY) + r"""
SELECT doc_id,
  trim(title) = '' OR n IN ('untitled document', 'sin titulo', 'blog') OR length(n) > 180 OR starts_with(n, '?m=')
    OR (n LIKE '%:' AND length(n) < 30) OR regexp_full_match(n, 'part\s+\d+') AS bad_title,
  author IS NULL OR trim(author) = '' OR regexp_matches(author, '\d') OR length(trim(author)) > 90
    OR regexp_matches(trim(author), '^[^\p{L}]*\p{Ll}') AS bad_author
FROM (SELECT *, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS n FROM library)""")
def repair_flags(spark, d):
    return lib.documents(spark, d).select(
        "doc_id", t.title_needs_repair(F.col("title")).alias("bad_title"),
        t.author_needs_repair(F.col("author")).alias("bad_author"))


@query("keyset_page", "F32 O7", """
SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-06-15', 9000)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(spark, d):
    anchor = [F.lit("1997-06-15 00:00:00").cast("timestamp_ntz"), 9000]
    return (lib.table(spark, d, "orders").where(flt.keyset_after(["o_orderdate", "o_orderkey"], anchor))
            .orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderdate"))


@query("cursor_page", "F33", using(LIBRARY) + """
SELECT doc_id, updated_s FROM library WHERE CAST(doc_id AS VARCHAR) > '5' ORDER BY updated_s DESC, doc_id LIMIT 30""")
def cursor_page(spark, d):
    return (lib.documents(spark, d).where(F.col("doc_id").cast("string") > "5")
            .select("doc_id", F.unix_seconds("updated_at").alias("updated_s"))
            .orderBy(F.desc("updated_s"), "doc_id").limit(30))
