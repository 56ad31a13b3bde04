"""Projections."""

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import text as t, urls
from folioworks.operators import catalog
from folioworks.operators.filters import source_type_of
from folioworks.registry import query
from folioworks.registry.prelude import DECISIONS, LIBRARY, NOTES, PARAGRAPHS, SOURCES, using
from folioworks.sources import library as lib

STATUS_SQL = "CASE WHEN is_indexed THEN 'INDEXED' ELSE upper(coalesce(status, 'PENDING')) END"


def _listing_sql(condition: str, offset: int) -> str:
    chosen = f"""deleted_s IS NULL AND upper(coalesce(status, 'PENDING')) <> 'FAILED' AND doc_id NOT IN (SELECT duplicate_id FROM confirmed) AND {condition}"""
    return using(LIBRARY, SOURCES, DECISIONS) + f"""
SELECT p.*, s.source_name, (SELECT count(*) FROM library WHERE {chosen}) AS total
FROM (SELECT doc_id, title, author, source_key, coalesce(meta_source_type, source_key) AS source_type, language,
    {STATUS_SQL} AS display_status, canonical_url, coalesce(meta_source_url, canonical_url) AS source_url,
    left(coalesce(text, ''), 360) AS excerpt, updated_s, coalesce(meta_is_seed, 'false') = 'true' AS seed
  FROM library WHERE {chosen}
  ORDER BY CASE WHEN coalesce(meta_is_seed, 'false') = 'true' THEN 1 ELSE 0 END, updated_s DESC, doc_id
  LIMIT 30 OFFSET {offset}) p JOIN sources s USING (source_key)"""


@query("document_listing", "P1 W1 O1 O11 J1 J5 F13",
       _listing_sql("(title ILIKE '%the%' OR text ILIKE '%the%' OR coalesce(author, '') ILIKE '%the%')", 10))
def document_listing(spark, d):
    return catalog.list_documents(lib.documents(spark, d), lib.sources(spark, d), limit=30, offset=10, search="the",
                                  decisions=lib.decisions(spark, d))


@query("documents_of_type", "P1 O1 J5 F8",
       _listing_sql("(meta_source_type = 'discursosud' OR source_key = 'discursosud')", 0))
def documents_of_type(spark, d):
    return catalog.list_documents(lib.documents(spark, d), lib.sources(spark, d), source_type="discursosud",
                                  decisions=lib.decisions(spark, d))


@query("effective_type_and_status", "P2 P3 F8", using(LIBRARY) + f"""
SELECT coalesce(meta_source_type, source_key) AS source_type, {STATUS_SQL} AS display_status, count(*) AS n
FROM library GROUP BY ALL""")
def effective_type_and_status(spark, d):
    docs = lib.documents(spark, d)
    return docs.groupBy(source_type_of(docs).alias("source_type"),
                        catalog.display_status().alias("display_status")).agg(F.count("*").alias("n"))


@query("snippets", "P4 P5", using(LIBRARY, PARAGRAPHS) + """
SELECT l.doc_id, left(coalesce(nullif(c.chunk_text, ''), nullif(l.meta_summary, ''), nullif(l.text, ''), l.title), 520)
  AS snippet
FROM library l LEFT JOIN (SELECT doc_id, min_by(chunk_text, chunk_index) AS chunk_text FROM paragraphs
  WHERE chunk_text ILIKE '%of the%' GROUP BY doc_id) c USING (doc_id)""")
def snippets(spark, d):
    docs = lib.documents(spark, d)
    first = (lib.paragraphs(spark, d).where(F.ilike("chunk_text", F.lit("%of the%")))
             .groupBy("doc_id").agg(F.min_by("chunk_text", "chunk_index").alias("chunk_text")))
    blank = F.lit("")
    snippet = F.coalesce(F.nullif("chunk_text", blank), F.nullif(catalog.description_of(docs), blank),
                         F.nullif("text", blank), F.col("title"))
    return (docs.withColumn("description", catalog.description_of(docs)).join(first, "doc_id", "left")
            .select("doc_id", F.left(snippet, F.lit(520)).alias("snippet")))


@query("vector_payload", "P9 J1", using(LIBRARY) + r"""
SELECT doc_id AS document_id, source_key, title, author, language, category, array_to_string(tags, ',') AS tags,
  canonical_url, CAST(published_on AS VARCHAR) AS published_at, 'Documento' AS section_title, CAST(0 AS BIGINT) AS chunk_index,
  sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash, left(text, 700) AS text_preview,
  array_to_string(list_sort(list_distinct(list_transform(
    regexp_extract_all(text || ' (Mateo ' || (doc_id % 28 + 1) || ':3; Alma 5:1; John 3:16; Juan 1:1)',
      '(Mateo|Alma|John|Juan)\s+\d+:\d+', 1),
    lambda b: CASE b WHEN 'Mateo' THEN 'Matthew' WHEN 'Juan' THEN 'John' ELSE b END))), ',') AS scripture_books
FROM library""")
def vector_payload(spark, d):
    from folioworks.functions.scripture import books_of, extract_refs

    suffix = F.concat(F.lit(" (Mateo "), F.col("doc_id") % 28 + 1, F.lit(":3; Alma 5:1; John 3:16; Juan 1:1)"))
    return lib.documents(spark, d).select(
        F.col("doc_id").alias("document_id"), "source_key", "title", "author", "language", "category",
        F.array_join("tags", ",").alias("tags"), "canonical_url",
        F.col("published_on").cast("string").alias("published_at"), F.lit("Documento").alias("section_title"),
        F.lit(0).cast("bigint").alias("chunk_index"), t.content_hash(F.col("text")).alias("text_hash"),
        F.left("text", F.lit(700)).alias("text_preview"),
        F.array_join(books_of(extract_refs(F.concat("text", suffix))), ",").alias("scripture_books"))


@query("note_payloads", "P10 P11", using(NOTES) + """
SELECT note_id, CAST(json_object('id', CAST(note_id AS VARCHAR), 'workspaceId', workspace_id, 'authorRole', role,
  'pinned', pinned, 'sizeChars', length(content)) AS VARCHAR) AS payload FROM notes""")
def note_payloads(spark, d):
    return lib.notes(spark, d).select("note_id", F.to_json(F.struct(
        F.col("note_id").cast("string").alias("id"), F.col("workspace_id").alias("workspaceId"),
        F.col("role").alias("authorRole"), "pinned", F.length("content").alias("sizeChars"))).alias("payload"))


@query("citation_pool", "P12 U2", using(LIBRARY, NOTES) + """
SELECT 'quote:' || note_id AS id, 'saved_quote' AS type, doc_id, 'Cita guardada' AS title, content AS body,
  0 AS pool_order FROM notes WHERE deleted_s IS NULL
UNION ALL
SELECT 'document:' || doc_id, 'document', doc_id, title, text, 1 FROM library WHERE deleted_s IS NULL""")
def citation_pool(spark, d):
    quotes = lib.notes(spark, d).where("deleted_at IS NULL").select(
        F.concat(F.lit("quote:"), "note_id").alias("id"), F.lit("saved_quote").alias("type"), "doc_id",
        F.lit("Cita guardada").alias("title"), F.col("content").alias("body"),
        F.lit(0).alias("pool_order"))
    docs = catalog.active(lib.documents(spark, d)).select(
        F.concat(F.lit("document:"), "doc_id").alias("id"), F.lit("document").alias("type"), "doc_id", "title",
        F.col("text").alias("body"), F.lit(1).alias("pool_order"))
    return quotes.unionByName(docs)


@query("note_attribution", "P13 J2", using(LIBRARY, SOURCES, NOTES) + """
SELECT n.note_id, l.title, l.author, coalesce(l.meta_source_url, l.canonical_url) AS source_url,
  coalesce(l.meta_source_type, l.source_key) AS source_type, s.source_name
FROM notes n JOIN library l USING (doc_id) JOIN sources s ON s.source_key = l.source_key""")
def note_attribution(spark, d):
    docs = lib.documents(spark, d)
    docs = docs.select("doc_id", "title", "author", catalog.source_url_of(docs).alias("source_url"),
                       source_type_of(docs).alias("source_type"), "source_key")
    return (lib.notes(spark, d).select("note_id", "doc_id").join(docs, "doc_id")
            .join(lib.sources(spark, d), "source_key")
            .select("note_id", "title", "author", "source_url", "source_type", "source_name"))


@query("card_kinds", "P14", using(LIBRARY) + """
SELECT CASE WHEN coalesce(k, '') = '' THEN 'speech' WHEN k LIKE '%manual%' THEN 'manual'
    WHEN k LIKE '%scripture%' THEN 'scripture' WHEN k LIKE '%pdf%' THEN 'pdf' WHEN k LIKE '%audio%' THEN 'audio'
    ELSE 'speech' END AS kind, y AS year, count(*) AS n
FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'church_manuals' WHEN 1 THEN 'scriptures' WHEN 2 THEN 'pdf_' || source_key
        WHEN 3 THEN NULL ELSE meta_source_type END AS k, year(published_on) AS y FROM library)
GROUP BY ALL""")
def card_kinds(spark, d):
    doc = F.col("doc_id") % 5
    kind = (F.when(doc == 0, "church_manuals").when(doc == 1, "scriptures")
            .when(doc == 2, F.concat(F.lit("pdf_"), "source_key")).when(doc == 3, F.lit(None))
            .otherwise(F.col("raw_metadata")["source_type"]))
    return lib.documents(spark, d).groupBy(
        urls.card_kind(kind).alias("kind"), F.year("published_on").cast("bigint").alias("year")
    ).agg(F.count("*").alias("n"))


@query("source_provenance", "R26 P11", using(LIBRARY) + """
SELECT doc_id, title, coalesce(author, '') AS author,
  CASE WHEN meta_source_type IS NULL THEN 'local' WHEN meta_source_type IN ('jsp', 'byu') THEN 'user_private' ELSE 'suggested' END
    AS source_status FROM library""")
def source_provenance(spark, d):
    kind = F.col("raw_metadata")["source_type"]
    return lib.documents(spark, d).select(
        "doc_id", "title", F.coalesce("author", F.lit("")).alias("author"),
        F.when(kind.isNull(), "local").when(kind.isin("jsp", "byu"), "user_private").otherwise("suggested")
        .alias("source_status"))


@query("weighted_fields", "X48 T5", using(LIBRARY) + r"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS BIGINT) AS a_terms,
  CAST(len(regexp_extract_all(lower(coalesce(author, '')), '[\p{L}\p{N}_]+')) AS BIGINT) AS b_terms,
  CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS BIGINT) AS c_terms,
  CASE language WHEN 'es' THEN 'spanish' WHEN 'en' THEN 'english' WHEN 'pt' THEN 'portuguese' ELSE 'simple' END AS config
FROM library""")
def weighted_fields(spark, d):
    from folioworks.operators.lexical import text_config, words

    return lib.documents(spark, d).select(
        "doc_id", *[F.size(words(F.coalesce(F.col(c), F.lit("")))).cast("bigint").alias(f"{label}_terms")
                    for c, label in (("title", "a"), ("author", "b"), ("text", "c"))],
        text_config(F.col("language")).alias("config"))
