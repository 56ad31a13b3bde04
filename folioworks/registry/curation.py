"""Curated intake."""

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.operators import curation as cur
from folioworks.registry import query
from folioworks.registry.prelude import LIBRARY, using
from folioworks.sources import library as lib


def _pick(at, names):
    return F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))


def _items(spark, d):
    page = F.col("page_id")
    url = F.concat(_pick(page % 5, [
        "https://www.churchofjesuschrist.org/study/manual/a/", "https://speeches.byu.edu/spa/talks/a/", "https://discursosud.com/a-",
        "https://speeches.byu.edu/talks/a/", "http://example.com/"]), page,
        _pick(page % 5, ["?lang=spa", "", "", "", ""]), F.when(page % 25 == 0, "&x=.pdf").when(page % 35 == 11, "x.pdf").otherwise(""))
    return lib.table(spark, d, "pages").select(
        page.alias("item_id"), url.alias("url"), F.when(page % 17 == 0, "eng").otherwise("es").alias("language"),
        F.when(page % 13 == 0, 404).otherwise(200).alias("http_status"),
        F.when(page % 3 == 0, "text/plain").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(page % 11 == 0, "").otherwise(F.col("html")).alias("body"), F.array(F.lit("Faith")).alias("tags"))


_ITEMS_SQL = """
items AS (SELECT page_id AS item_id, ['https://www.churchofjesuschrist.org/study/manual/a/', 'https://speeches.byu.edu/spa/talks/a/', 'https://discursosud.com/a-',
    'https://speeches.byu.edu/talks/a/', 'http://example.com/'][page_id % 5 + 1] || page_id || CASE WHEN page_id % 5 = 0 THEN '?lang=spa' ELSE '' END
    || CASE WHEN page_id % 25 = 0 THEN '&x=.pdf' WHEN page_id % 35 = 11 THEN 'x.pdf' ELSE '' END AS url, CASE WHEN page_id % 17 = 0 THEN 'eng' ELSE 'es' END AS language,
  CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS http_status, CASE WHEN page_id % 3 = 0 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 11 = 0 THEN '' ELSE html END AS body FROM pages),
judged AS (SELECT item_id, CASE WHEN item_id % 5 = 4 THEN 'La URL de origen no es valida.' WHEN language = 'eng' THEN 'El idioma declarado no es espanol.'
  WHEN item_id % 5 = 3 THEN 'BYU Speeches solo admite discursos bajo /spa/.' WHEN http_status <> 200 THEN 'La fuente no respondio HTTP 200.'
  WHEN url LIKE '%.pdf' THEN 'skipped_pdf_pending: la extraccion de PDF no esta habilitada en este workflow.'
  WHEN content_type = 'text/plain' AND body = '' THEN 'El recurso no parece HTML ni texto limpio.' END AS reason,
  CASE WHEN content_type = 'text/plain' THEN 'text' ELSE 'html' END AS ok_kind FROM items)
"""


@query("resource_types", "F28 S16", using(_ITEMS_SQL) + """
SELECT item_id, reason, CASE WHEN reason IS NULL THEN ok_kind WHEN reason LIKE 'La fuente no resp%' OR reason LIKE 'El recurso%' THEN 'desconocido' WHEN reason LIKE 'skipped%' THEN 'pdf' END AS kind FROM judged""")
def resource_types(spark, d):
    r = cur.resource(F.col("url"), F.col("language"), F.col("http_status"), F.col("content_type"), F.col("body"))
    return _items(spark, d).select("item_id", r.alias("r")).select("item_id", "r.reason", "r.kind")


_ES = ", ".join(f"'{m}'" for m in fv.SPANISH_MARKERS)
_EN = ", ".join(f"'{m}'" for m in fv.WORKFLOW_ENGLISH_MARKERS)


@query("quality_reasons", "F24 F26", using(LIBRARY) + rf"""
SELECT doc_id, CASE WHEN canonical_url NOT LIKE 'https://%' THEN 'La URL de origen no es valida.' WHEN regexp_matches(canonical_url, '[?&]lang=(eng|fra|deu)') AND NOT regexp_matches(canonical_url, '[?&]lang=spa')
    AND regexp_extract(canonical_url, '[?&]lang=([^&#]+)', 1) IN ('de', 'deu', 'en', 'eng', 'fr', 'fra', 'it', 'ita', 'por', 'pt') THEN 'La URL declara un idioma no espanol.'
  WHEN length(trim(title)) < 3 THEN 'No se pudo extraer un titulo confiable.' WHEN length(trim(text)) < 300 THEN 'El texto limpio tiene menos de 300 caracteres.'
  WHEN len(w) < 60 THEN 'El documento contiene muy pocas palabras utiles.'
  WHEN es < 8 OR es / len(w) < 0.025 OR en > es THEN 'La heuristica no pudo confirmar que el contenido este en espanol.' END AS reason
FROM (SELECT *, len(list_filter(w, lambda x: x IN ({_ES}))) AS es, len(list_filter(w, lambda x: x IN ({_EN}))) AS en FROM (SELECT *, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') AS w FROM library))""")
def quality_reasons(spark, d):
    return lib.documents(spark, d).select("doc_id", cur.quality_reason(
        F.col("title"), F.col("text"), F.col("canonical_url"), F.col("canonical_url"), F.lit("es")).alias("reason"))


@query("intake", "L8 F24 F28 X34 I8 R31")
def intake(spark, d):
    done = cur.intake(_items(spark, d))
    return done.select("item_id", "kind", "status", "reason", "title", F.length("content").alias("characters"),
                       F.array_join("tags", ",").alias("tags"))


@query("submission_errors", "R47 F23 F25 F26 F27", using(LIBRARY) + rf"""
SELECT doc_id, CASE WHEN curated IS NULL THEN 'source_url is not an authorized Spanish document URL' WHEN regexp_matches(canonical_url, '[?&]lang=(eng|fra|deu)(&|#|$)') THEN 'source_url contains a non-Spanish language parameter'
  WHEN lower(language) <> 'es' THEN 'language must be es' WHEN NOT spanish THEN 'content is not predominantly Spanish' END AS error
FROM (SELECT *, CASE WHEN canonical_url LIKE 'https://www.speeches.byu.edu/spa/talks/%/%' THEN 'b' WHEN canonical_url LIKE 'https://www.churchofjesuschrist.org/study/%lang=spa%' THEN 'c' END AS curated,
  es >= 8 AND es / len(w) >= 0.025 AND en <= es AS spanish FROM (SELECT *, len(list_filter(w, lambda x: x IN ({_ES}))) AS es, len(list_filter(w, lambda x: x IN ({_EN}, 'come'))) AS en
  FROM (SELECT *, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-záéíóúüñ]+') AS w FROM library)))""")
def submission_errors(spark, d):
    return lib.documents(spark, d).select("doc_id", cur.validation_errors(
        F.col("title"), F.col("text"), F.col("canonical_url"), F.lit(None).cast("string"), F.col("language")).alias("error"))


def _results(spark, d):
    order = F.col("o_orderkey") % 7
    status = _pick(order, ["created", "verified_existing", "skipped", "rejected", "odd", "created", "created"])
    http = F.when(F.col("o_orderkey") % 50 == 0, 500).otherwise(200)
    r = cur.api_result(http, status, F.lit(None).cast("string"))
    return lib.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("title"), r.alias("r")).select(
        "item_id", "title", "r.result", "r.message")


_RESULTS_SQL = """
res AS (SELECT o_orderkey AS item_id, o_orderpriority AS title, CASE WHEN o_orderkey % 50 = 0 THEN 'error' ELSE ['created', 'verified_existing', 'skipped', 'rejected', 'error', 'created', 'created'][o_orderkey % 7 + 1] END AS result,
  CASE WHEN o_orderkey % 50 = 0 THEN 'La API respondio HTTP 500.' WHEN o_orderkey % 7 = 3 THEN 'La API rechazo el documento.' ELSE 'La API respondio HTTP 200 pero no devolvio un status reconocible.' END AS message FROM orders)
"""


@query("batch_summary", "A20 S16", using(_RESULTS_SQL) + """
SELECT *, 'Procesados: ' || processed || '; creados: ' || created || '; existentes: ' || existing || '; omitidos: ' || skipped || '; rechazados: ' || rejected || '; errores: ' || errors AS message
FROM (SELECT count(*) AS processed, count(*) FILTER (WHERE result = 'created') AS created, count(*) FILTER (WHERE result = 'verified_existing') AS existing,
  count(*) FILTER (WHERE result = 'skipped') AS skipped, count(*) FILTER (WHERE result = 'rejected') AS rejected, count(*) FILTER (WHERE result = 'error') AS errors FROM res)""")
def batch_summary(spark, d):
    return cur.batch_summary(_results(spark, d))


@query("batch_listing", "A20 S16", using(_RESULTS_SQL) + """
SELECT 'created' AS list, item_id, title AS entry FROM res WHERE result = 'created' UNION ALL SELECT 'refused', item_id, message FROM res WHERE result IN ('rejected', 'error')""")
def batch_listing(spark, d):
    return cur.batch_listing(_results(spark, d))
