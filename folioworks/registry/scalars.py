"""Scalar functions, each run over every row of a table."""

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import privacy, scripture, spanish, text as t, urls
from folioworks.operators import maintenance, ranking, study
from folioworks.registry import query
from folioworks.registry.prelude import LIBRARY, NOTES, using
from folioworks.sources import library as lib

FOLD = r"replace(lower({c}), 'ß', 'ss')"


@query("text_hashes", "X1 X1b", r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normalized_hash, sha256(text) AS raw_hash FROM documents""")
def text_hashes(spark, d):
    return lib.table(spark, d, "documents").select(
        "doc_id", t.content_hash(F.col("text")).alias("normalized_hash"), t.raw_hash(F.col("text")).alias("raw_hash"))


@query("token_counts", "X2", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\t\n\f\r\x0B \p{L}\p{N}_]')) AS BIGINT) AS tokens FROM documents""")
def token_counts(spark, d):
    return lib.table(spark, d, "documents").select("doc_id", t.token_count(F.col("text")).cast("bigint").alias("tokens"))


@query("normalized_lines", "X3", r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\r\n?', chr(10), 'g'), '[ \t\f\v\r]+', ' ', 'g'),
  ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) AS clean_hash
FROM (SELECT doc_id, '  ' || replace(replace(text, '. ', '.  ' || chr(13) || chr(10)), ', ', ',' || chr(9) || ' ') || chr(10) || chr(10) || chr(10) || 'end ' AS s FROM documents)""")
def normalized_lines(spark, d):
    messy = F.concat(
        F.lit("  "), F.replace(F.replace("text", F.lit(". "), F.lit(".  \r\n")), F.lit(", "), F.lit(",\t ")),
        F.lit("\n\n\nend "))
    return lib.table(spark, d, "documents").select("doc_id", F.sha2(t.normalize_lines(messy), 256).alias("clean_hash"))


@query("repaired_text", "X4 X5 R31 R33", r"""
SELECT conv_id, turn, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_hash, conv_id % 2 = 0 AND text <> strip_accents(replace(text, 'ß', 's')) AS damaged
FROM conversations""")
def repaired_text(spark, d):
    broken = F.when(F.col("conv_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return lib.table(spark, d, "conversations").withColumn("broken", broken).select(
        "conv_id", "turn", F.sha2(spanish.normalize(F.col("broken")), 256).alias("clean_hash"),
        spanish.looks_damaged(F.col("broken")).alias("damaged"))


@query("cleaned_json", "X7 X50", r"""
SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS title, 'doc-' || conv_id || '  ' AS document_id,
  'https://x.example.org/?q=%C3%AD' AS source_url FROM conversations""")
def cleaned_json(spark, d):
    broken = F.decode(F.encode(F.replace("text", F.lit("\n"), F.lit(" ")), "UTF-8"), "ISO-8859-1")
    body = F.to_json(F.struct(
        broken.alias("title"), F.struct(F.concat(F.lit("doc-"), "conv_id", F.lit("  ")).alias("document_id"),
                                        F.lit(" https://x.example.org/?q=%C3%AD ").alias("source_url")).alias("nested")))
    clean = lib.table(spark, d, "conversations").select("conv_id", "turn", spanish.normalize_json(body).alias("j"))
    return clean.select("conv_id", "turn", *[
        F.get_json_object("j", path).alias(name) for name, path in (
            ("title", "$.title"), ("document_id", "$.nested.document_id"), ("source_url", "$.nested.source_url"))])


@query("slugs", "X8 R34", r"""
SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(replace(head, 'ß', 'ss'))), '\s+', ' ', 'g')) AS name,
  trim(regexp_replace(lower(strip_accents(replace(head, 'ß', 'ss'))), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM (SELECT conv_id, turn, text AS head FROM conversations)""")
def slugs(spark, d):
    head = F.col("text")
    return lib.table(spark, d, "conversations").select(
        "conv_id", "turn", spanish.normalized_name(head).alias("name"), spanish.slug(head).alias("slug"))


@query("normalized_titles", "X9 X23", using(LIBRARY) + rf"""
SELECT doc_id, trim(regexp_replace({FOLD.format(c='title')}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS title_key,
  trim(regexp_replace({FOLD.format(c="coalesce(author, '')")}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS author_key FROM library""")
def normalized_titles(spark, d):
    return lib.documents(spark, d).select(
        "doc_id", t.normalize_title(F.col("title")).alias("title_key"), t.normalize_title(F.col("author")).alias("author_key"))


@query("url_identities", "X10", using(LIBRARY) + r"""
SELECT doc_id, lower(regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*')) ||
  regexp_replace(regexp_replace(url_decode(regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*([^?#]*)', 1)), '/+', '/', 'g'), '/$', '') AS identity
FROM library""")
def url_identities(spark, d):
    return lib.documents(spark, d).select("doc_id", urls.identity(F.col("canonical_url")).alias("identity"))


@query("canonical_urls", "X11 X11b X11c", using(LIBRARY) + r""",
parts AS (SELECT doc_id, lower(regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*')) AS root, regexp_extract(canonical_url, '^[a-zA-Z]+://[^/]*([^?#]*)', 1) AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(canonical_url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS q FROM library)
SELECT doc_id, regexp_replace(root || path || CASE WHEN q = '' THEN '' ELSE '?' || q END, '/$', '') AS crawl_url, curated AS curated_url,
  CASE WHEN root IN ('https://speeches.byu.edu', 'https://www.speeches.byu.edu', 'https://www.churchofjesuschrist.org') THEN curated END AS allowed_url
FROM (SELECT *, root || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS curated FROM parts)""")
def canonical_urls(spark, d):
    url = F.col("canonical_url")
    return lib.documents(spark, d).select(
        "doc_id", urls.canonical(url).alias("crawl_url"), urls.curated_canonical(url).alias("curated_url"),
        urls.allowlisted_canonical(url).alias("allowed_url"))


@query("url_languages", "X12 X13", using(LIBRARY) + r"""
SELECT doc_id, CASE l WHEN 'eng' THEN 'en' WHEN 'spa' THEN 'es' WHEN 'fra' THEN 'fr' WHEN 'deu' THEN 'de' WHEN '' THEN language ELSE l END AS url_language,
  contains(canonical_url, 'imageView=') AS media FROM (SELECT *, regexp_extract(canonical_url, '[?&]lang(?:uage)?=([a-z]+)', 1) AS l FROM library)""")
def url_languages(spark, d):
    return lib.documents(spark, d).select(
        "doc_id", urls.language(F.col("canonical_url"), F.col("language")).alias("url_language"),
        urls.media_variant(F.col("canonical_url"), F.col("title")).alias("media"))


@query("page_hosts", "X14", r"""
SELECT page_id, host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, host = 'example.com' OR host LIKE '%.example.com' OR host = 'ththin.example.org' AS allowed
FROM (SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host FROM pages)""")
def page_hosts(spark, d):
    url = F.col("url")
    return lib.table(spark, d, "pages").select(
        "page_id", urls.host(url).alias("host"), urls.registered_domain(url).alias("domain"),
        urls.host_allowed(url, ["Example.com", "ththin.example.org:443"]).alias("allowed"))


@query("curated_sources", "X17 S5", using(LIBRARY) + r"""
SELECT doc_id, CASE WHEN canonical_url LIKE 'https://www.speeches.byu.edu/spa/talks/%/%' THEN 'byu_speeches_es'
  WHEN canonical_url LIKE 'https://www.churchofjesuschrist.org/study/%lang=spa%' THEN 'church_official_es' END AS curated FROM library""")
def curated_sources(spark, d):
    return lib.documents(spark, d).select("doc_id", urls.curated_source(F.col("canonical_url")).alias("curated"))


@query("scripture_references", "X18", using(NOTES) + r""",
m AS (SELECT note_id, unnest(regexp_extract_all(content, '(?i)\b(?:1\s*Nephi|2\s*Nephi|3\s*Nephi|Alma|D&C|DyC|Mateo|Matthew|John|Juan|Romans|Romanos)\s+\d{1,3}:\d{1,3}(?:\s*[-–]\s*\d{1,3})?\b')) AS raw FROM notes),
n AS (SELECT note_id, CASE regexp_replace(lower(regexp_extract(raw, '^(.*?)\s+\d+:', 1)), '\s+', ' ', 'g') WHEN '1 nephi' THEN '1 Nephi' WHEN '2 nephi' THEN '2 Nephi'
    WHEN 'alma' THEN 'Alma' WHEN 'd&c' THEN 'Doctrine and Covenants' WHEN 'dyc' THEN 'Doctrine and Covenants' WHEN 'mateo' THEN 'Matthew' WHEN 'juan' THEN 'John'
    WHEN 'romanos' THEN 'Romans' END AS book, CAST(regexp_extract(raw, '\s(\d+):', 1) AS INT) AS chapter, CAST(regexp_extract(raw, ':(\d+)', 1) AS INT) AS verse_start,
    CAST(coalesce(nullif(regexp_extract(raw, '-(\d+)$', 1), ''), regexp_extract(raw, ':(\d+)', 1)) AS INT) AS verse_end FROM m)
SELECT DISTINCT note_id, book, chapter, verse_start, verse_end FROM n WHERE book IS NOT NULL""")
def scripture_references(spark, d):
    refs = scripture.extract_refs(F.col("content"))
    return lib.notes(spark, d).select("note_id", F.inline(scripture.structured(refs))).drop("display")


@query("curated_references", "X18b R27", using(NOTES) + r"""
SELECT note_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content,
  '(?i)\b(?:1|2|3)?\s?(?:Nephi|Alma|Mosiah|Moroni|Matthew|John|Romans)\s+\d{1,3}:\d{1,3}(?:-\d{1,3})?\b|\b(?:Doctrine and Covenants|D&C)\s+\d{1,3}:\d{1,3}(?:-\d{1,3})?\b'))), '|') AS refs FROM notes""")
def curated_references(spark, d):
    return lib.notes(spark, d).select("note_id", F.array_join(scripture.curated_refs(F.col("content")), "|").alias("refs"))


@query("expanded_queries", "X53 U6", using(NOTES) + r"""
SELECT note_id, CASE WHEN k % 3 = 0 THEN q ELSE q || ' Alma ' || (k % 50 + 1) || ':7 scripture reference doctrinal citation' END AS expanded
FROM (SELECT note_id, k, regexp_replace(content, '\d', '', 'g') || CASE WHEN k % 3 = 0 THEN '' ELSE ' alma  ' || (k % 50 + 1) || ':7' END AS q
  FROM (SELECT note_id, content, note_id % 1000 + workspace_id AS k FROM notes))""")
def expanded_queries(spark, d):
    k = F.col("note_id") % 1000 + F.col("workspace_id")
    q = F.concat(F.regexp_replace("content", r"\d", ""),
                 F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" alma  "), k % 50 + 1, F.lit(":7"))))
    none = F.array().cast("array<string>")
    return lib.notes(spark, d).select("note_id", scripture.expand_query(q, none).alias("expanded"))


@query("meaningful_documents", "X20", using(LIBRARY) + r"""
SELECT doc_id, length(trim(text)) >= 500 AS meaningful FROM library""")
def meaningful_documents(spark, d):
    from folioworks.operators.duplicates import meaningful

    docs = lib.documents(spark, d).withColumn("content_hash", t.content_hash(F.col("text")))
    return docs.select("doc_id", meaningful().alias("meaningful"))


@query("metadata_from_url", "X22 X23", using(LIBRARY) + r"""
SELECT doc_id, CASE WHEN canonical_url LIKE '%/talk-number-%' THEN 'Talk Number ' || b WHEN canonical_url LIKE '%/discurso_%' THEN 'Discurso ' || b
    WHEN canonical_url LIKE '%/mensaje_%' THEN 'Mensaje ' || b WHEN canonical_url LIKE '%/paper-summary/%' THEN 'History Revised Edition ' || b END AS url_title,
  CASE WHEN canonical_url LIKE '%speeches.byu.edu%' THEN CASE (doc_id // 40) % 4 WHEN 0 THEN 'Ana B. Reyes' WHEN 1 THEN 'Luis Mora Jr.' WHEN 3 THEN 'John Taylor' END END AS url_author,
  CASE WHEN canonical_url LIKE '%/general-conference/%' THEN CAST(epoch(strptime(regexp_extract(canonical_url, '/(\d{4}/\d{2})/', 1) || '/01', '%Y/%m/%d')) AS BIGINT) END AS url_published,
  coalesce(canonical_url LIKE '%speeches.byu.edu%' AND ((author = 'Ana B. Reyes' AND (doc_id // 40) % 4 = 0) OR (author = 'Luis Mora Jr.' AND (doc_id // 40) % 4 = 1)), false) AS same_author
FROM (SELECT *, CAST(doc_id // 40 AS VARCHAR) AS b FROM library)""")
def metadata_from_url(spark, d):
    url = F.col("canonical_url")
    kind = urls.source_type(F.col("source_key"), url)
    author = urls.author_from_url(url)
    return lib.documents(spark, d).select(
        "doc_id", urls.title_from_url(url, kind).alias("url_title"), author.alias("url_author"),
        urls.published_from_url(url, kind).alias("url_published"), t.authors_match(author, F.col("author")).alias("same_author"))


@query("asset_titles", "R42", r"""
SELECT page_id, CASE WHEN w = '' THEN 'Downloaded asset' ELSE array_to_string(list_transform(string_split(lower(w), ' '), lambda x: upper(x[1]) || x[2:]), ' ') END AS title
FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\.[^.]*$', ''), '[-_]', ' ', 'g'), '\s+', ' ', 'g')) AS w FROM pages)""")
def asset_titles(spark, d):
    return lib.table(spark, d, "pages").select("page_id", urls.asset_title(F.col("url")).alias("title"))


@query("redacted_metadata", "X36 X37", using(LIBRARY) + r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '[REDACTED]' WHEN doc_id % 4 = 1 THEN '[REDACTED]' ELSE title END AS note,
  CASE WHEN meta_api_token IS NOT NULL THEN '[REDACTED]' END AS api_token, meta_summary IS NOT NULL AS keeps_summary FROM library""")
def redacted_metadata(spark, d):
    note = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("key sk-ABC123 "), "title"))
            .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Authorization: Basic "), "title"))
            .otherwise(F.col("title")))
    hidden, kept = privacy.redact_map(F.col("raw_metadata")), privacy.without_sensitive(F.col("raw_metadata"))
    return lib.documents(spark, d).select(
        "doc_id", privacy.redact_inline(note).alias("note"), hidden["api_token"].alias("api_token"),
        (F.map_contains_key(kept, F.lit("summary")) & ~F.map_contains_key(kept, F.lit("api_token"))).alias("keeps_summary"))


_STOP = "', '".join(fv.SEARCH_STOPWORDS)
_STUDY = "', '".join(fv.STUDY_STOPWORDS)
_TALK = "', '".join(fv.TALK_STOPWORDS)


@query("search_terms", "X38", rf"""
SELECT item_id, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[?,.]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
    lambda w: length(w) > 2 AND lower(w) NOT IN ('{_STOP}'))[1:8], lambda w: {FOLD.format(c='w')}), ' ') AS library_terms,
  array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[,;.:]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
    lambda w: length(w) > 2 AND lower(w) NOT IN ('{_STUDY}'))[1:8], ' ') AS study_terms,
  array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[,;]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
    lambda w: length(w) > 2)[1:8], ' ') AS related_terms,
  array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '),
      lambda w: lower(trim(w, '.,;:!?()[]{{}}"'''))), lambda w: length(w) > 2 AND w NOT IN ('{_TALK}'))[1:8], ' ') AS talk_terms
FROM benchmark""")
def search_terms(spark, d):
    c = F.col("text")
    return lib.table(spark, d, "benchmark").select("item_id", *[
        F.array_join(terms, " ").alias(name) for name, terms in (
            ("library_terms", t.library_terms(c)), ("study_terms", t.study_terms(c)),
            ("related_terms", t.related_terms(c)), ("talk_terms", t.talk_terms(c)))])


@query("prompt_hashes", "X39 R11", r"""
SELECT conv_id, turn, sha256('{"maxSuggestions": "5", "mode": "' || role || '", "userPrompt": "' || regexp_replace(text, '[^a-zA-Z ]', '', 'g') || '"}') AS prompt_hash FROM conversations""")
def prompt_hashes(spark, d):
    payload = F.create_map(F.lit("mode"), F.col("role"), F.lit("userPrompt"), F.regexp_replace("text", "[^a-zA-Z ]", ""),
                           F.lit("maxSuggestions"), F.lit("5"))
    return lib.table(spark, d, "conversations").select("conv_id", "turn", privacy.prompt_hash(payload).alias("prompt_hash"))


@query("user_ids", "X40", """
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS user_id
FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('library:user:' || trim(c_name))) AS h FROM customer)""")
def user_ids(spark, d):
    return (lib.table(spark, d, "customer")
            .select("c_custkey", privacy.user_id(F.col("c_name"), "library:user:").alias("user_id")))


@query("model_json", "X41", """
SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE CAST(conv_id AS VARCHAR) END AS n FROM conversations""")
def model_json(spark, d):
    body = F.concat(F.lit('{"n": '), "conv_id", F.lit(', "s": "a } \\" { b"}'))
    answer = (F.when(F.col("turn") % 4 == 0, body)
              .when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(F.col("turn") % 4 == 2, F.concat(F.lit("Here you go: "), body, F.lit(" hope {it} helps")))
              .otherwise(F.concat(F.lit("no object, "), F.replace("text", F.lit("{"), F.lit("")))))
    return lib.table(spark, d, "conversations").select(
        "conv_id", "turn", F.get_json_object(spanish.extract_json_object(answer), "$.n").alias("n"))


@query("suggestion_clamps", "X42 X43 X54", r"""
SELECT conv_id, turn, CASE WHEN k IN ('quote', 'reflection') THEN k ELSE 'doctrinal_analysis' END AS type,
  CASE WHEN s IN ('local', 'none') THEN s ELSE 'suggested' END AS source_status,
  CASE WHEN s = 'local' THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 60) ELSE '' END AS quote_text,
  CASE b WHEN 'ai_quote' THEN 'quote' WHEN 'reflection_question' THEN 'reflection' WHEN 'post_it' THEN 'post_it' ELSE 'personal_note' END AS block_type
FROM (SELECT conv_id, turn, text, ['quote', 'poem', 'reflection'][turn % 3 + 1] AS k, ['local', 'web', 'none'][conv_id % 3 + 1] AS s,
  ['ai_quote', 'post_it', 'reflection_question', 'other'][(conv_id + turn) % 4 + 1] AS b FROM conversations)""")
def suggestion_clamps(spark, d):
    pick = lambda at, names: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    kind = pick(F.col("turn") % 3, ["quote", "poem", "reflection"])
    status = pick(F.col("conv_id") % 3, ["local", "web", "none"])
    block = pick((F.col("conv_id") + F.col("turn")) % 4, ["ai_quote", "post_it", "reflection_question", "other"])
    shown = F.when(status.isin("local", "suggested", "user_private", "none"), status).otherwise("suggested")
    return lib.table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.when(kind.isin("quote", "reflection", "doctrinal_analysis"), kind).otherwise("doctrinal_analysis").alias("type"),
        shown.alias("source_status"),
        F.when(shown == "local", t.limit_text(F.col("text"), 60)).otherwise("").alias("quote_text"),
        t.block_type(block).alias("block_type"))


@query("calling_guidance", "X44 R39", """
SELECT conv_id, turn, shown AS display_name, CASE WHEN coalesce(shown, '') = '' THEN 'general_discipleship' WHEN n LIKE '%obispo%' THEN 'bishop'
  WHEN n LIKE '%presidente de estaca%' THEN 'stake_president' WHEN n LIKE '%sociedad de socorro%' THEN 'relief_society' WHEN n LIKE '%maestro%' THEN 'teacher'
  WHEN n LIKE '%joven%' THEN 'youth' ELSE 'calling_duties' END AS emphasis
FROM (SELECT conv_id, turn, shown, lower(shown) AS n FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN 'Obispo' WHEN 1 THEN 'Presidente de Estaca'
  WHEN 2 THEN 'Sociedad de Socorro' WHEN 3 THEN 'Maestro de Instituto' WHEN 4 THEN 'Mujeres Jovenes' WHEN 5 THEN role WHEN 6 THEN NULL ELSE NULL END AS shown FROM conversations))""")
def calling_guidance(spark, d):
    key = (F.col("conv_id") + F.col("turn")) % 8
    name = (F.when(key == 0, "Obispo").when(key == 1, "Presidente de Estaca").when(key == 2, "Sociedad de Socorro")
            .when(key == 3, "Maestro de Instituto").when(key == 4, "Mujeres Jovenes").when(key == 5, "Otro llamamiento")
            .when(key == 7, "Obispo"))
    shown = study.calling_display_name(key != 7, name, F.when(key == 5, F.col("role")))
    named = lib.table(spark, d, "conversations").select("conv_id", "turn", shown.alias("display_name"))
    return named.withColumn("emphasis", study.calling_emphasis(F.col("display_name")))


@query("grounded_answers", "X45 P7", r"""
SELECT conv_id, turn, contains(a, '[1]') OR contains(a, '[2]') OR contains(a, '[3]') AS grounded
FROM (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' [2]' WHEN 1 THEN ' [7]' ELSE '' END AS a FROM conversations)""")
def grounded_answers(spark, d):
    answer = F.concat("text", F.when(F.col("turn") % 3 == 0, " [2]").when(F.col("turn") % 3 == 1, " [7]").otherwise(""))
    ids = F.array(F.lit(1), F.lit(2), F.lit(3))
    marked = F.exists(ids, lambda i: F.contains(answer, F.concat(F.lit("["), i.cast("string"), F.lit("]"))))
    return lib.table(spark, d, "conversations").select("conv_id", "turn", marked.alias("grounded"))


@query("export_filenames", "X46", r"""
SELECT DISTINCT p_partkey, trim(regexp_replace(lower(p_name || ' #' || p_size || '!'), '[^\p{L}\p{N}]', '-', 'g'), '-') || '-all.md' AS filename FROM part""")
def export_filenames(spark, d):
    name = F.concat("p_name", F.lit(" #"), "p_size", F.lit("!"))
    return lib.table(spark, d, "part").select("p_partkey", t.filename_slug(name, "all", "md").alias("filename"))


@query("merged_metadata", "X50 R8 I4", using(LIBRARY) + """
SELECT doc_id, 'v1' AS quality, coalesce(meta_source_type, 'unset') AS source_type, meta_error IS NULL AND true AS error_removed FROM library""")
def merged_metadata(spark, d):
    base = F.map_filter("raw_metadata", lambda k, v: k != "error")
    merged = maintenance.merge_maps(base, F.create_map(F.lit("quality"), F.lit("v1")))
    return lib.documents(spark, d).select(
        "doc_id", merged["quality"].alias("quality"), F.coalesce(merged["source_type"], F.lit("unset")).alias("source_type"),
        F.col("raw_metadata")["error"].isNull().alias("error_removed"))


@query("rerank_blend", "X52", """
SELECT doc_id, CAST(0.7 AS DOUBLE) * CAST(coalesce(quality, 0) AS DOUBLE) + CAST(0.3 AS DOUBLE) * (n_chars / CAST(40000 AS DOUBLE)) AS blended FROM documents LEFT JOIN labels USING (doc_id)""")
def rerank_blend(spark, d):
    scores = lib.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("rerank"))
    return lib.table(spark, d, "documents").join(scores, "doc_id", "left").select(
        "doc_id", ranking.rerank_blend(F.col("rerank"), F.col("n_chars") / 40000.0).alias("blended"))


@query("repair_candidates", "X24 L9 F31", using(LIBRARY) + r""",
k AS (SELECT *, CAST(doc_id // 40 AS VARCHAR) AS b, coalesce(meta_source_type, CASE WHEN canonical_url LIKE '%/spa/%' THEN 'byu_speeches_es' WHEN canonical_url LIKE '%speeches%' THEN 'byu_speeches_en'
    WHEN canonical_url LIKE '%/general-conference/%' THEN 'general_conference' WHEN canonical_url LIKE '%josephsmith%' THEN 'joseph_smith_papers' END) AS kind,
  title = '' OR regexp_full_match(lower(title), 'part\s+\d+') OR (title LIKE '%:' AND length(title) < 30) AS bad_title,
  author IS NULL OR trim(author) = '' OR regexp_matches(author, '\d') OR regexp_matches(author, '^[a-z]') AS bad_author FROM library),
t AS (SELECT *, CASE WHEN canonical_url LIKE '%/talk-number-%' THEN 'Talk Number ' || b WHEN canonical_url LIKE '%/discurso_%' THEN 'Discurso ' || b
    WHEN kind = 'general_conference' THEN 'Mensaje ' || b WHEN kind = 'joseph_smith_papers' THEN 'History Revised Edition ' || b END AS new_title,
  CASE WHEN kind IN ('byu_speeches_en', 'byu_speeches_es') AND canonical_url LIKE '%speeches%' THEN CASE (doc_id // 40) % 4 WHEN 0 THEN 'Ana B. Reyes' WHEN 1 THEN 'Luis Mora Jr.' WHEN 3 THEN 'John Taylor' END END AS new_author FROM k)
SELECT doc_id, 'title' AS field, title AS previous, new_title AS repaired FROM t WHERE bad_title AND new_title IS NOT NULL
UNION ALL SELECT doc_id, 'author', author, new_author FROM t WHERE bad_author AND new_author IS NOT NULL
UNION ALL SELECT doc_id, 'published_at', NULL, CAST(CAST(epoch(strptime(regexp_extract(canonical_url, '/(\d{4}/\d{2})/', 1) || '/01', '%Y/%m/%d')) AS BIGINT) AS VARCHAR)
  FROM t WHERE kind = 'general_conference' AND published_on IS NULL""")
def repair_candidates(spark, d):
    return maintenance.repair_candidates(lib.documents(spark, d)).select("doc_id", "field", "previous", "repaired")
