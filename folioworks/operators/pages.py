"""From raw pages to document records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioworks import fixed_values as fv
from folioworks.functions import markup, scripture, urls
from folioworks.functions.text import bind, casefold, collapse_ws, contains_any, distinct_by, strip_ws
from folioworks.session import cut_lineage, spread

# Site suffixes and words that end or disqualify a title or an author.
_SITE_SUFFIX = r"(?i)\s*(?:\||-|--)\s*(BYU Speeches|Church Newsroom|The Church of Jesus Christ.*)$"
_AUTHOR_SUFFIX = r"(?i)\s*(?:\||-|--)\s*(BYU Speeches|The Church of Jesus Christ.*)$"
_AUTHOR_PREFIX = r"(?i)^(By|Por|Speaker|Orador|Author|Autor)\s*[:\-]?\s+"
_AUTHOR_END = (
    r"(?i)\s+(?:Las revistas|Ensign|Liahona|New Era|Friend|The author|La autora|El autor|Of the|De la|Del|De los"
    r"|Primer|Segundo|Presidente|Apostol|Apostoles|Setenta|Obispado|Cuorum|Quorum|Consejo|Gracias|Como|Al igual"
    r"|Mientras|Quizas|Dediquemos)\b.*$"
)
_NOT_AUTHORS = ["church news", "byu speeches", "joseph smith papers", "the church of jesus christ",
                "the church of jesus christ of latter-day saints"]
_NOT_TITLES = ["untitled document", "home", "speeches"]
_NOT_FIRST_LINES = ["skip to main content", "main content", "menu", "navigation"]
_TEXT_BYLINES = [r"\b(?:By|Por)\s+([^\n|]{2,100})", r"\b(?:Speaker|Orador)\s*[:\-]\s*([^\n|]{2,100})",
                 r"\b(?:Author|Autor)\s*[:\-]\s*([^\n|]{2,100})"]
_SLUG_SKIPS = ["spa", "eng", "por", "bofm", "talks", "study"]
_SPANISH_HINTS = [" el ", " la ", " que ", " de jesucristo", "alma "]
_HISTORICAL_NOTE = "Fuente historica/documental; no es manual doctrinal oficial de la Iglesia."
_PARSERS = [
    ("discursosud.com", "discursos_sud", "Discursos SUD"),
    ("speeches.byu.edu/spa/", "byu_speeches_es", "BYU Speeches Espanol"),
    ("speeches.byu.edu", "byu_speeches_en", "BYU Speeches"),
    ("churchofjesuschrist.org", "church_library", None),
    ("josephsmithpapers.org", "joseph_smith_papers", "Documento historico"),
    ("rsc.byu.edu", "byu_rsc", "BYU Religious Studies Center"),
]


def tidy(c: Column) -> Column:
    """Collapsed whitespace, separators stripped from the ends, NULL when nothing is left."""
    return F.nullif(F.btrim(collapse_ws(c), F.lit(" -|")), F.lit(""))


def page_text(raw: Column) -> Column:
    """Blank runs, line ends and empty-line runs reduced."""
    c = F.regexp_replace(F.regexp_replace(raw, r"[\t\r\f\x0B]", " "), "  +", " ")
    c = F.replace(F.replace(c, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return strip_ws(F.regexp_replace(c, "\n\n\n+", "\n\n"))


def url_headline(url: Column) -> Column:
    """Title from the last path segment, or the one before for language and section slugs."""
    def pick(parts: Column) -> Column:
        before = F.try_element_at(parts, F.lit(-2))
        last = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(?i)\.pdf$", "")
        named = bind(last, lambda x: F.when(F.lower(x).isin(*_SLUG_SKIPS) & before.isNotNull(), before).otherwise(x))
        return bind(named, lambda x: F.when(F.rlike(x, F.lit(r"^\d+$")) & before.isNotNull(),
                                            F.concat(before, F.lit(" "), x)).otherwise(x))

    slug = bind(F.transform(urls.segments(url), urls.unquote), pick)
    return F.nullif(F.initcap(collapse_ws(F.regexp_replace(slug, "[-_]+", " "))), F.lit(""))


def first_line(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), tidy)
    good = F.filter(lines, lambda x: x.isNotNull() & ~F.lower(x).isin(*_NOT_FIRST_LINES) & (F.length(x) > 2))
    return F.left(F.get(good, F.lit(0)), F.lit(300))


def choose_title(candidates: Column) -> Column:
    """The first candidate that survives cleaning."""
    cleaned = F.transform(candidates, lambda c: tidy(F.regexp_replace(tidy(c), _SITE_SUFFIX, "")))
    good = F.filter(cleaned, lambda c: c.isNotNull() & ~F.lower(c).isin(*_NOT_TITLES))
    return F.coalesce(F.left(F.get(good, F.lit(0)), F.lit(300)), F.lit("Untitled document"))


def clean_author(c: Column) -> Column:
    """Prefixes, site names and trailing biography removed; implausible names dropped."""
    c = F.regexp_replace(F.regexp_replace(tidy(c), _AUTHOR_PREFIX, ""), _AUTHOR_SUFFIX, "")
    c = tidy(F.regexp_replace(c, _AUTHOR_END, ""))
    c = F.regexp_replace(c, r"(?i)^el\s+(elder|presidente|obispo)\s+", "")
    return bind(c, lambda x: F.when((x != "") & (F.length(x) <= 90) & (F.size(F.split(x, " ")) <= 8)
                                    & ~F.lower(x).isin(*_NOT_AUTHORS), x))


def choose_author(candidates: Column, url: Column, text: Column) -> Column:
    """Page metadata, then the URL, then bylines, then the text.

    ``candidates`` marks the URL's turn with a NULL that is not the first entry.
    """
    tried = bind(urls.author_from_url(url), lambda named: F.transform(
        candidates, lambda c, i: F.when(c.isNull() & (i > 0), named).otherwise(clean_author(c))))
    in_text = F.array(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in _TEXT_BYLINES])
    known = lambda values: F.get(F.filter(values, lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(known(tried), known(F.transform(in_text, clean_author)))


# Shapes are told apart by pattern first, so that only a fitting format is tried.
_DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mmXXX"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
    (r"^(?:19|20)\d{2}$", "yyyy"),
]


def parse_date(c: Column) -> Column:
    """ISO forms, a bare year, or an English day-month-year."""
    def shaped(x: Column) -> Column:
        result = None
        for shape, layout in _DATE_SHAPES:
            hit, value = F.rlike(x, F.lit(shape)), F.try_to_timestamp(x, F.lit(layout))
            result = F.when(hit, value) if result is None else result.when(hit, value)
        return result

    return bind(F.trim(c), shaped)


def choose_date(candidates: Column, text: Column, url: Column) -> Column:
    in_text = F.regexp_extract(text, r"\b(\d{1,2}\s+\p{L}+\s+\d{4}|\p{L}+\s+\d{1,2},\s+\d{4})\b", 1)
    in_url = F.regexp_extract(url, r"/((?:19|20)\d{2})(?:/|$)", 1)
    every = F.concat(candidates, F.array(in_text, in_url))
    return F.get(F.filter(F.transform(every, parse_date), lambda d: d.isNotNull()), F.lit(0))


def detect_language(text: Column, url: Column) -> Column:
    """The URL path first, then Spanish hints in the opening of the text."""
    route = F.lower(urls.path(url))
    return (F.when(contains_any(route, ["/spa/", "/es/"]), "es").when(contains_any(route, ["/por/", "/pt/"]), "pt")
            .when(contains_any(F.lower(F.left(text, F.lit(5000))), _SPANISH_HINTS), "es").when(F.trim(text) != "", "en"))


def absolute(links: Column, base: Column) -> Column:
    """Links against their page: absolute, scheme-relative, rooted, query-only or relative."""
    page = F.regexp_replace(base, r"[?#].*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    parts = F.struct(
        page.alias("page"), root.alias("root"), F.regexp_replace(base, "#.*$", "").alias("whole"),
        F.concat(root, F.regexp_extract(F.concat(page, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/(?:.*/)?)?", 1))
        .alias("folder"))
    rooted = lambda b: F.when(F.endswith(b["folder"], F.lit("/")), b["folder"]).otherwise(
        F.concat(b["folder"], F.lit("/")))
    return bind(parts, lambda b: F.transform(links, lambda link: (
        F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(b["root"], "^([^:]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(b["root"], link))
        .when(F.startswith(link, F.lit("#")), F.concat(b["whole"], link))
        .when(F.startswith(link, F.lit("?")), F.concat(b["page"], link))
        .otherwise(F.concat(rooted(b), link)))))


def assets(links: Column, media: Column, base: Column) -> Column:
    """Files a page points at, one entry per URL."""
    entry = lambda url, kind, mime: F.struct(url.alias("url"), F.lit(kind).alias("asset_type"), F.lit(mime).alias("mime_type"))
    bare = lambda u: F.regexp_replace(F.lower(u), r"\?.*$", "")
    listed = F.transform(absolute(links, base), lambda u: F.when(
        F.endswith(bare(u), F.lit(".pdf")), entry(u, "pdf", "application/pdf")
    ).when(F.endswith(bare(u), F.lit(".mp3")), entry(u, "mp3", "audio/mpeg")))
    played = F.transform(
        F.arrays_zip(absolute(F.transform(media, lambda m: m["src"]), base).alias("src"),
                     F.transform(media, lambda m: m["tag"]).alias("tag")),
        lambda m: F.when((m["tag"] != "iframe") & F.contains(F.lower(m["src"]), F.lit(".mp3")),
                         entry(m["src"], "mp3", "audio/mpeg"))
        .when((m["tag"] == "iframe") & contains_any(m["src"], ["youtube", "vimeo", "churchofjesuschrist"]),
              entry(m["src"], "video", None)))
    return distinct_by(F.array_compact(F.concat(listed, played)), lambda a: a["url"])


def default_category(url: Column) -> Column:
    church = F.contains(url, F.lit("churchofjesuschrist.org"))
    result = F.when(F.contains(url, F.lit("discursosud.com")), "Discursos SUD")
    for host, _, category in _PARSERS[1:3]:
        result = result.when(F.contains(url, F.lit(host)), category)
    result = (result.when(church & F.contains(url, F.lit("/study/scriptures")), "Escrituras")
              .when(church & F.contains(url, F.lit("/study/manual")), "Manuales de la Iglesia")
              .when(church, "Conferencia General"))
    for host, _, category in _PARSERS[4:]:
        result = result.when(F.contains(url, F.lit(host)), category)
    return result


def parser_name(url: Column) -> Column:
    result = None
    for host, name, _ in _PARSERS:
        hit = F.contains(url, F.lit(host))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


def parse(pages: DataFrame, source_key: Column | None = None) -> DataFrame:
    """L1: document records from (page_id, url, html)."""
    found = spread(pages).withColumn("f", markup.findings(F.col("html"))).drop("html")
    found = found.withColumn("text", page_text(F.col("f.text")))
    url, text = F.col("url"), F.col("text")
    keywords = F.filter(F.transform(F.split(F.coalesce("f.keywords", F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")
    linked = F.filter(F.col("f.tag_links"), lambda k: F.length(k).between(2, 80))
    category = F.coalesce(
        F.get(F.filter(F.col("f.categories"), lambda c: (c != "") & (F.length(c) < 120)), F.lit(0)), F.col("f.section"))
    staged = found.select(
        "page_id", "url", "text",
        choose_title(F.concat(F.col("f.titles"), F.array(url_headline(url), first_line(text)))).alias("title"),
        choose_author(F.col("f.authors"), url, F.col("f.full_text")).alias("author"),
        choose_date(F.col("f.dates"), text, url).alias("published_at"),
        detect_language(text, url).alias("language"),
        F.coalesce(category, default_category(url)).alias("category"),
        F.array_sort(F.array_distinct(F.concat(keywords, linked))).alias("tags"),
        scripture.extract_refs(text).alias("scripture_refs"),
        assets(F.col("f.links"), F.col("f.media"), url).alias("assets"),
        F.transform(absolute(F.col("f.links"), url), urls.canonical).alias("links"),
        urls.source_type(F.lit(None).cast("string") if source_key is None else source_key, url).alias("source_type"),
        parser_name(url).alias("parser"), urls.canonical(url).alias("canonical_url"),
        F.when(F.contains(url, F.lit("josephsmithpapers.org")), _HISTORICAL_NOTE).alias("source_note"))
    return staged


def frontier(links: DataFrame, seeds: DataFrame, max_depth: int = 4, max_pages: int | None = None) -> DataFrame:
    """Breadth-first discovery over (src, dst), each URL at its smallest depth.

    Every round joins only the newest URLs, and is checkpointed, so a lost
    executor never restarts the crawl.  ``max_pages`` keeps the first URLs in
    (depth, url) order.
    """
    seen = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    newest = seen
    for depth in range(1, max_depth + 1):
        reached = links.join(newest.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        newest = cut_lineage(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def allowed_links(links: DataFrame, start_url: str, domains: list[str]) -> DataFrame:
    """Stay on allowed hosts and below the start path."""
    start = start_url.split("://", 1)[1]
    host, _, prefix = start.partition("/")
    prefix = ("/" + prefix).rstrip("/")
    route = F.regexp_replace(urls.path(F.col("dst")), "/+$", "")
    inside = (route == prefix) | F.startswith(route, F.lit(prefix + "/")) if prefix else F.lit(True)
    return links.where(F.rlike("dst", F.lit("^https?://")) & urls.host_allowed(F.col("dst"), domains)
                       & urls.host_allowed(F.col("dst"), [host.split(":")[0]]) & inside)


_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&ldquo;": '"', "&rdquo;": '"',
             "&lsquo;": "'", "&rsquo;": "'", "&ndash;": "-", "&mdash;": "-", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    """Numeric references first, then the named ones; odd blanks become plain or vanish."""
    def numbered(text: Column, pattern: str, base: int) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
        code = lambda r: F.conv(F.regexp_extract(r, pattern, 1), base, 16)
        char = lambda r: F.decode(F.unhex(F.lpad(code(r), 8, "0")), "UTF-32")
        return F.aggregate(refs, text, lambda acc, r: F.replace(acc, r, char(r)))

    def named(text: Column) -> Column:
        text = numbered(text, r"&#(\d{1,6});", 10)
        text = numbered(text, r"(?i)&#x([0-9a-f]{1,5});", 16)
        for name, char in _ENTITIES.items():
            text = F.regexp_replace(text, "(?i)" + name, char)
        return text

    c = bind(c, lambda text: F.when(F.contains(text, F.lit("&")), named(text)).otherwise(text))
    return F.replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))


def regex_content(html: Column) -> Column:
    """Main block by regular expressions, lines of 20 characters and more, each once."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(
        c, r"(?is)<(script|style|nav|footer|header|aside|noscript|form|svg|button|iframe)\b[^>]*>.*?</\1>", " ")
    block = lambda x, name: F.nullif(F.regexp_extract(x, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), F.lit(""))
    main = bind(c, lambda x: F.coalesce(block(x, "article"), block(x, "main"), block(x, "body"), x))
    lined = F.regexp_replace(main, r"(?i)<(br|/p|/li|/h[1-6]|/blockquote|/section|/div)>", "\n")
    lines = F.transform(F.split(decode_entities(F.regexp_replace(lined, "<[^>]+>", " ")), "\n+"), collapse_ws)
    kept = F.filter(lines, lambda x: (F.length(x) >= 20) & ~F.rlike(x, F.lit("(?i)" + fv.NAVIGATION_LINES)))
    return F.array_join(distinct_by(kept, F.lower), "\n\n")


def regex_title(html: Column) -> Column:
    hit = lambda name: F.nullif(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), F.lit(""))
    return collapse_ws(decode_entities(F.regexp_replace(F.coalesce(hit("h1"), hit("title")), "<[^>]+>", " ")))


def curated_text(blocks: Column) -> Column:
    """Blocks of 20 characters and more, each once; at least four and 800 characters in all."""
    clean = F.filter(F.transform(blocks, collapse_ws), lambda b: F.length(b) >= 20)
    return bind(distinct_by(clean, casefold), lambda once: bind(
        F.array_join(once, "\n\n"), lambda joined: F.when((F.length(joined) >= 800) & (F.size(once) >= 4), joined)))
