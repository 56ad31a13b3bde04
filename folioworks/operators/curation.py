"""Curated intake: resource detection, quality gate, payload, batch report.

Each step turns into one ordered ``when`` chain that yields the first reason to
skip an item, so a whole batch passes through in a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioworks import fixed_values as fv
from folioworks.functions import urls
from folioworks.functions.text import appears_spanish, bind, casefold, contains_any, contains_placeholder, contains_raw_html
from folioworks.operators import pages
from folioworks.operators.sets import unique_tags

# Hosts, markers, messages and base tags of the intake.
HOSTS = ["churchofjesuschrist.org", "discursosud.com", "speeches.byu.edu"]
MIN_CHARS, MIN_WORDS, MAX_NAVIGATION, MIN_TITLE = 300, 60, 12, 3
BAD_URL = "La URL de origen no es valida."
NOT_ALLOWED = "La fuente no esta autorizada para esta ingesta."
DECLARED_LANGUAGE = "El idioma declarado no es espanol."
URL_LANGUAGE = "La URL declara un idioma no espanol."
OFFICIAL_LANGUAGE = "La pagina oficial no declara lang=spa."
SPEECHES_PATH = "BYU Speeches solo admite discursos bajo /spa/."
NOT_200 = "La fuente no respondio HTTP 200."
PDF_PENDING = "skipped_pdf_pending: la extraccion de PDF no esta habilitada en este workflow."
NOT_READABLE = "El recurso no parece HTML ni texto limpio."
TEST_URL = "La URL corresponde a una prueba n8n."
PLACEHOLDER = "El documento contiene texto de prueba o placeholder."
NO_TITLE = "No se pudo extraer un titulo confiable."
TOO_SHORT = "El texto limpio tiene menos de 300 caracteres."
TOO_FEW_WORDS = "El documento contiene muy pocas palabras utiles."
NOT_SPANISH = "La heuristica no pudo confirmar que el contenido este en espanol."
NAVIGATION = "El contenido parece contener navegacion o texto repetido."
BASE_TAGS = {
    "discursosud.com": ["Discursos SUD", "Doctrina"],
    "speeches.byu.edu": ["BYU Speeches", "Devocional"],
    "churchofjesuschrist.org": ["Iglesia de Jesucristo", "Fuente oficial"],
}


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https://(?:www\.)?([^/?#]+)", 1))


def _lang(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)[?&]lang=([^&#]+)", 1))


def resource(url: Column, language: Column, http_status: Column, content_type: Column, body: Column) -> Column:
    """(kind, reason); a reason means the item is skipped."""
    def judge(host: Column, lang: Column) -> Column:
        kind_text = F.lower(F.coalesce(content_type, F.lit("")))
        pdf = (F.contains(kind_text, F.lit("application/pdf")) | F.rlike(url, F.lit(r"(?i)\.pdf(?:$|[?#])"))
               | F.startswith(body, F.lit("%PDF-")))
        html = F.contains(kind_text, F.lit("text/html")) | F.rlike(body, F.lit(r"(?i)<(?:html|body|main|article|h1|p)\b"))
        plain = F.contains(kind_text, F.lit("text/plain")) & (F.trim(body) != "")
        out = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
        return (
            F.when(host == "", out(None, BAD_URL))
            .when(~host.isin(*HOSTS), out(None, NOT_ALLOWED))
            .when(F.lower(F.coalesce(language, F.lit(""))).isin(*fv.NON_SPANISH_CODES), out(None, DECLARED_LANGUAGE))
            .when(lang.isin(*fv.NON_SPANISH_CODES), out(None, URL_LANGUAGE))
            .when((host == "churchofjesuschrist.org") & (lang != "spa"), out(None, OFFICIAL_LANGUAGE))
            .when((host == "speeches.byu.edu") & ~F.startswith(urls.path(url), F.lit("/spa/")), out(None, SPEECHES_PATH))
            .when(http_status != 200, out("desconocido", NOT_200))
            .when(pdf, out("pdf", PDF_PENDING))
            .when(~html & ~plain, out("desconocido", NOT_READABLE))
            .when(plain, out("text", None))
            .otherwise(out("html", None)))

    return bind(_host(url), lambda host: bind(_lang(url), lambda lang: judge(host, lang)))


def quality_reason(title: Column, text: Column, url: Column, canonical: Column, language: Column,
                   summary: Column | None = None) -> Column:
    """the first failed quality rule, NULL when the text is ready."""
    audited = casefold(F.concat_ws("\n", title, text, summary if summary is not None else F.lit("")))
    declared = F.lower(F.trim(F.coalesce(language, F.lit("es"))))
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({fv.WORD_PATTERN})"), 1)
    counted = lambda w, markers: F.size(F.filter(w, lambda x: x.isin(*markers)))
    navigation = F.regexp_count(text, F.lit("(?i)" + fv.NAVIGATION_WORDS))

    def by_words(w: Column) -> Column:
        spanish, english = counted(w, fv.SPANISH_MARKERS), counted(w, fv.WORKFLOW_ENGLISH_MARKERS)
        return (F.when(F.size(w) < MIN_WORDS, TOO_FEW_WORDS)
                .when((spanish < 8) | (spanish / F.size(w) < 0.025) | (english > spanish), NOT_SPANISH))

    return F.coalesce(
        F.when(~F.rlike(url, F.lit("(?i)^https://")), BAD_URL)
        .when(F.contains(F.lower(url), F.lit("prueba-n8n")), TEST_URL)
        .when(~declared.isin("", "es", "spa"), DECLARED_LANGUAGE)
        .when(_lang(url).isin(*fv.NON_SPANISH_CODES) | _lang(F.coalesce(canonical, F.lit(""))).isin(*fv.NON_SPANISH_CODES),
              URL_LANGUAGE)
        .when(contains_any(audited, fv.PLACEHOLDERS), PLACEHOLDER)
        .when(F.length(F.trim(title)) < MIN_TITLE, NO_TITLE)
        .when(F.length(F.trim(text)) < MIN_CHARS, TOO_SHORT),
        bind(words, by_words),
        F.when(navigation > MAX_NAVIGATION, NAVIGATION))


def base_tags(url: Column) -> Column:
    host = _host(url)
    result = None
    for name, tags in BASE_TAGS.items():
        values = F.array(*[F.lit(x) for x in tags])
        result = F.when(host == name, values) if result is None else result.when(host == name, values)
    return F.coalesce(result, F.array().cast("array<string>"))


def intake(items: DataFrame) -> DataFrame:
    """Detect, extract, check, prepare; one row per item with status and reason.

    ``items`` has (item_id, url, language, http_status, content_type, body, tags).
    """
    found = items.withColumn("r", resource(F.col("url"), F.col("language"), F.col("http_status"),
                                           F.col("content_type"), F.col("body")))
    is_text = F.col("r.kind") == "text"
    content = F.when(F.col("r.reason").isNull(), F.when(is_text, pages.page_text(F.col("body")))
                     .otherwise(pages.regex_content(F.col("body"))))
    title = F.when(F.col("r.reason").isNull(), pages.regex_title(F.col("body")))
    read = found.withColumn("content", content).withColumn("title", title)
    reason = F.coalesce(F.col("r.reason"), quality_reason(
        F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.col("url"), F.col("url"), F.lit("es")))
    judged = read.withColumn("reason", reason)
    ready = F.col("reason").isNull()
    return judged.select(
        "item_id", "url", F.col("r.kind").alias("kind"), F.when(ready, "ready").otherwise("skipped").alias("status"),
        "reason", F.when(ready, F.col("title")).alias("title"), F.when(ready, F.col("content")).alias("content"),
        F.when(ready, unique_tags(F.concat("tags", base_tags(F.col("url"))))).alias("tags"))


def validation_errors(title: Column, content: Column, url: Column, canonical: Column, language: Column) -> Column:
    """The first rule a submitted document breaks, in the order they are checked."""
    source = urls.curated_source(url)
    return (
        F.when(source.isNull(), "source_url is not an authorized Spanish document URL")
        .when(urls.non_spanish_parameter(url), "source_url contains a non-Spanish language parameter")
        .when(canonical.isNotNull() & urls.non_spanish_parameter(canonical),
              "canonical_url contains a non-Spanish language parameter")
        .when(canonical.isNotNull() & ~urls.curated_source(canonical).eqNullSafe(source),
              "canonical_url must belong to the same authorized source")
        .when(contains_raw_html(content), "content must be cleaned text, not raw HTML")
        .when(contains_placeholder(title) | contains_placeholder(content), "test or placeholder content is not accepted")
        .when(F.lower(F.trim(F.coalesce(language, F.lit("")))) != "es", "language must be es")
        .when(~appears_spanish(content), "content is not predominantly Spanish"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Counters of a batch; the listed titles and rejections stay rows (see below)."""
    n = lambda name: F.count_if(F.col("result") == name)
    counted = results.agg(
        F.count("*").alias("processed"), n("created").alias("created"), n("verified_existing").alias("existing"),
        n("skipped").alias("skipped"), n("rejected").alias("rejected"), n("error").alias("errors"))
    text = F.concat(
        F.lit("Procesados: "), "processed", F.lit("; creados: "), "created", F.lit("; existentes: "), "existing",
        F.lit("; omitidos: "), "skipped", F.lit("; rechazados: "), "rejected", F.lit("; errores: "), "errors")
    return counted.withColumn("message", text)


def batch_listing(results: DataFrame) -> DataFrame:
    """Created titles and rejected URLs, one row each, so a batch may be of any size."""
    created = results.where("result = 'created' AND title IS NOT NULL").select(
        F.lit("created").alias("list"), "item_id", F.col("title").alias("entry"))
    refused = results.where("result IN ('rejected', 'error')").select(
        F.lit("refused").alias("list"), "item_id", F.coalesce(
            "message", F.when(F.col("result") == "rejected", "Documento rechazado.").otherwise("Error durante la ingesta."))
        .alias("entry"))
    return created.unionByName(refused)


def api_result(http_status: Column, status: Column, message: Column) -> Column:
    """How the answer to one submission is recorded."""
    row = lambda result, text: F.struct(F.lit(result).alias("result"), text.alias("message"))
    return (
        F.when(http_status >= 400, row("error", F.concat(F.lit("La API respondio HTTP "), http_status.cast("string"), F.lit("."))))
        .when(status == "created", row("created", F.lit("Documento creado correctamente.")))
        .when(status == "verified_existing", row("verified_existing", F.lit("El documento ya existia y fue verificado.")))
        .when(status == "skipped", row("skipped", F.coalesce(message, F.lit("La API omitio el documento."))))
        .when(status == "rejected", row("rejected", F.coalesce(message, F.lit("La API rechazo el documento."))))
        .otherwise(row("error", F.concat(F.lit("La API respondio HTTP "), http_status.cast("string"),
                                         F.lit(" pero no devolvio un status reconocible.")))))
