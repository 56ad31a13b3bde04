"""The same derived tables as ``sources.library``, as common table expressions
for the SQL oracle.  Written separately so that the two check each other."""

LIBRARY = r"""
library AS (
  SELECT doc_id, text, lang AS language, source AS source_key, n_chars,
    CASE WHEN doc_id % 23 = 0 THEN 'Part ' || (doc_id % 9)
         WHEN doc_id % 29 = 0 THEN ''
         ELSE left(split_part(text, chr(10), 1), 160) END AS title,
    CASE doc_id % 7 WHEN 0 THEN 'Ana B. Reyes' WHEN 1 THEN 'Luis Mora Jr.' WHEN 2 THEN 'José Núñez'
      WHEN 3 THEN 'maria lower' WHEN 4 THEN 'Autor 12' WHEN 5 THEN '  ' END AS author,
    CASE lang WHEN 'es' THEN 'Discursos' WHEN 'en' THEN 'Talks' WHEN 'fr' THEN 'Manuels' END AS category,
    list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Faith' END, CASE WHEN doc_id % 3 = 0 THEN 'temple' END,
                 CASE WHEN doc_id % 7 = 0 THEN source END], lambda x: x IS NOT NULL) AS tags,
    CASE num % 6
      WHEN 0 THEN 'https://speeches.byu.edu/talks/' || slug || '/talk-number-' || b || '/?lang=' || lang3 || '&utm_source=feed'
      WHEN 1 THEN 'https://www.speeches.byu.edu/spa/talks/' || slug || '/discurso_' || b || '/?lang=' || lang3
      WHEN 2 THEN 'http://DiscursoSUD.com//articulo-' || b || '?language=' || lang || '#top'
      WHEN 3 THEN 'https://www.churchofjesuschrist.org/study/general-conference/' || (b % 30 + 1990) || '/'
           || CASE WHEN b % 2 = 0 THEN '04' ELSE '10' END || '/mensaje_' || b || '?lang=' || lang3
           || CASE WHEN b % 7 = 0 THEN '&imageView=1' ELSE '' END
      WHEN 4 THEN 'https://www.josephsmithpapers.org/paper-summary/history-revised-edition-' || b
      WHEN 5 THEN 'https://rsc.byu.edu:8080/book-' || num || '/chapter%20' || b || '/?b=2&a=1' END AS canonical_url,
    CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'archived'
      ELSE 'ready' END AS status,
    doc_id % 4 = 1 AS is_indexed,
    1704067200 + doc_id * 3600 AS created_s,
    1704067200 + doc_id * 3600 + (doc_id * 7919) % 100000 AS updated_s,
    CASE WHEN doc_id % 6 <> 0 THEN DATE '2000-01-01' + CAST(doc_id % 8000 AS INTEGER) END AS published_on,
    CASE WHEN doc_id % 19 = 0 THEN 1735689600 END AS deleted_s,
    CASE WHEN doc_id % 3 = 0 THEN CASE num % 6 WHEN 0 THEN 'byu' WHEN 1 THEN 'speeches_byu_es' WHEN 2 THEN 'discursosud'
      WHEN 3 THEN 'Conferencia-General' WHEN 4 THEN 'jsp' WHEN 5 THEN 'custom src' END END AS meta_source_type,
    CASE WHEN doc_id % 8 = 0 THEN 'https://mirror.example.org/' || doc_id END AS meta_source_url,
    CASE WHEN doc_id % 4 = 0 THEN left(split_part(text, chr(10), 1), 40) END AS meta_summary,
    CASE WHEN doc_id % 50 = 0 THEN 'true' END AS meta_is_seed,
    CASE WHEN doc_id % 31 = 0 THEN 'HTTP 500' END AS meta_error,
    CASE WHEN doc_id % 5 = 0 THEN 't0k3n' END AS meta_api_token
  FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS num, doc_id // 40 AS b,
          CASE (doc_id // 40) % 4 WHEN 0 THEN 'ana-b-reyes' WHEN 1 THEN 'luis-mora-jr' WHEN 2 THEN 'speakers'
            ELSE 'john-taylor' END AS slug,
          CASE lang WHEN 'es' THEN 'spa' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' END AS lang3
        FROM documents))
"""

SOURCES = r"""
sources AS (
  SELECT source_key, 'Source ' || num AS source_name,
    CASE WHEN num % 5 = 0 THEN 99 END AS rate_limit,
    CASE WHEN num % 3 = 0 THEN '' WHEN num % 3 = 1 THEN '15' END AS cfg_rate,
    CASE WHEN num % 4 = 0 THEN '40' END AS cfg_pages,
    CASE WHEN num % 2 = 0 THEN 'es' END AS cfg_language,
    num % 7 <> 0 AS enabled
  FROM (SELECT DISTINCT source AS source_key, CAST(substr(source, 4) AS INTEGER) AS num FROM documents))
"""

JOBS = r"""
jobs AS (
  SELECT event_id AS job_id, CASE WHEN user_id % 9 <> 0 THEN 'src' || (user_id % 20) END AS source_key,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running'
      WHEN 'view' THEN 'done' ELSE 'Error' END AS status,
    ts AS created_at,
    CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 5 SECOND END AS started_at,
    CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 60 SECOND END AS finished_at,
    CASE WHEN event_id % 11 = 0 THEN ['timeout'] ELSE [] END AS errors,
    CAST(json_extract(props, '$.k') AS INTEGER) AS documents_found
  FROM events)
"""

USAGE = r"""
usage AS (
  SELECT event_id, user_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'embedding' WHEN event_type = 'signup' THEN 'chat'
      ELSE 'rerank' END AS kind,
    CAST(floor(value * 100) AS BIGINT) AS input_tokens,
    CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END AS status, ts AS created_at
  FROM events)
"""

PARAGRAPHS = r"""
paragraphs AS (
  SELECT doc_id, i - 1 AS chunk_index, parts[i] AS chunk_text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE parts[i] <> '')
"""

NOTES = r"""
notes AS (
  SELECT conv_id * 1000 + turn AS note_id, conv_id AS workspace_id, turn, role, conv_id % 17 AS user_id,
    conv_id * 3 + turn AS doc_id,
    text || ' (' || ['1 Nephi', 'alma', 'D&C', 'DyC', 'Mateo', 'Juan', 'Romanos', '2  nephi', '1Nephi'][k % 9 + 1]
      || ' ' || (k % 40 + 1) || ':' || (k % 25 + 1)
      || CASE WHEN k % 4 = 0 THEN '-' || (k % 25 + 3) ELSE '' END || '; Alma 32:21)' AS content,
    1706745600 + conv_id * 86400 + turn * 60 AS updated_s, turn % 3 = 1 AS pinned,
    CASE WHEN conv_id % 10 = 3 THEN 1735689600 END AS deleted_s
  FROM (SELECT *, conv_id * 7 + turn AS k FROM conversations))
"""

DECISIONS = r"""
decisions AS (
  SELECT doc_id AS duplicate_id, CASE WHEN toxic = 1 THEN 'exact_duplicate' WHEN quality = 0 THEN 'probable_duplicate' ELSE 'translation' END AS classification,
    CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'confirmed' END AS review_status FROM labels),
confirmed AS (SELECT DISTINCT duplicate_id FROM decisions WHERE review_status = 'confirmed' AND classification IN ('exact_duplicate', 'probable_duplicate'))
"""

# Exact copies of an earlier text (live ones come before deleted ones), with the confirmed verdict that hides them.
DUPLICATES = r"""
hidden AS (
  SELECT doc_id AS duplicate_id
  FROM (SELECT doc_id, n_chars, count(*) OVER (PARTITION BY h, language, t) AS n,
          row_number() OVER (PARTITION BY h, language, t ORDER BY deleted_s IS NOT NULL, doc_id) AS rn
        FROM (SELECT doc_id, language, n_chars, deleted_s, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h,
                trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t FROM library))
  WHERE rn > 1)
"""


def using(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)
