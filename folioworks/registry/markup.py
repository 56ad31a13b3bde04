"""HTML pages and the crawl."""

from pyspark.sql import functions as F

from folioworks.functions import markup, urls
from folioworks.operators import pages
from folioworks.registry import query
from folioworks.session import spread
from folioworks.sources import library as lib


@query("parsed_pages", "L1 X25 X26 X27 X28 X29 X30 X31 X32 X33")
def parsed_pages(spark, d):
    parsed = pages.parse(lib.table(spark, d, "pages"))
    return parsed.select(
        "page_id", "title", "author", "language", "category", F.array_join("tags", ",").alias("tags"),
        F.size("assets").alias("assets"), F.size("links").alias("links"), "source_type", "canonical_url",
        F.length("text").alias("characters"), F.sha2("text", 256).alias("content_hash"))


@query("page_titles", "X27", r"""
SELECT page_id, left(trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&'), '\s+', ' ', 'g'), ' -|'), 300) AS title FROM pages""")
def page_titles(spark, d):
    found = lib.table(spark, d, "pages").select("page_id", markup.findings(F.col("html")).alias("f"))
    return found.select("page_id", pages.choose_title(F.col("f.titles")).alias("title"))


@query("page_links", "S4 X11", r"""
SELECT page_id, link, count(*) AS n FROM (SELECT page_id, regexp_extract(lower(url), '^https?://[^/?#]+') || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def page_links(spark, d):
    found = lib.table(spark, d, "pages").select("page_id", "url", markup.findings(F.col("html")).alias("f"))
    links = found.select("page_id", F.explode(pages.absolute(F.col("f.links"), F.lower("url"))).alias("link"))
    return links.groupBy(
        "page_id", "link").agg(F.count("*").alias("n"))


@query("crawl_frontier", "S4 I2 I16", """
WITH RECURSIVE edges AS (SELECT page_id AS src, unnest([page_id * 2 + 1, page_id * 3 + 2, (page_id * 7) % 50]) AS dst FROM pages),
walk AS (SELECT 0 AS page_id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.page_id WHERE w.depth < 4)
SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id""")
def crawl_frontier(spark, d):
    page = F.col("page_id")
    links = lib.table(spark, d, "pages").select(page.alias("src"), F.explode(F.array(
        page * 2 + 1, page * 3 + 2, (page * 7) % 50)).alias("dst"))
    seeds = lib.table(spark, d, "pages").agg(F.min("page_id").alias("url"))
    return pages.frontier(links, seeds, 4).select(F.col("url").alias("page_id"), "depth")


@query("allowed_links", "S4 X14", r"""
SELECT page_id, count(*) AS links FROM (SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host FROM pages WHERE lower(url) LIKE 'http%'
  AND regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) LIKE '/en/%') WHERE host = 'example.com' OR host LIKE '%.example.com' GROUP BY 1""")
def allowed_links(spark, d):
    links = lib.table(spark, d, "pages").select("page_id", F.lit("x").alias("src"), F.col("url").alias("dst"))
    return pages.allowed_links(links, "https://example.com/en", ["example.com"]).groupBy("page_id").agg(
        F.count("*").alias("links"))


@query("page_languages", "X31", r"""
SELECT page_id, CASE WHEN contains(route, '/spa/') OR contains(route, '/es/') THEN 'es' WHEN contains(route, '/por/') OR contains(route, '/pt/') THEN 'pt'
  WHEN contains(head, ' el ') OR contains(head, ' la ') OR contains(head, ' que ') OR contains(head, ' de jesucristo') OR contains(head, 'alma ') THEN 'es'
  WHEN trim(html) <> '' THEN 'en' END AS language
FROM (SELECT page_id, html, lower(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)) AS route, lower(left(html, 5000)) AS head FROM pages)""")
def page_languages(spark, d):
    return lib.table(spark, d, "pages").select(
        "page_id", pages.detect_language(F.col("html"), F.col("url")).alias("language"))


_STRIP = "".join(rf"<{x}\b[^>]*>[\s\S]*?</{x}>|" for x in
                 "script style nav footer header aside noscript form svg button iframe".split()).rstrip("|")


@query("regex_content", "X34 L8", rf"""
SELECT page_id, title, len(list_distinct(list_transform(lines, lambda x: lower(x)))) AS lines, sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1),
    lambda i: list_position(list_transform(lines, lambda x: lower(x)), lower(lines[i])) = i), lambda i: lines[i]), chr(10) || chr(10))) AS content_hash
FROM (SELECT page_id, title, list_filter(list_transform(list_transform(string_split_regex(replace(replace(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(c, '<article\b[^>]*>([\s\S]*?)</article>', 1, 'i'), ''), c),
      '<(br|/p|/li|/h[1-6]|/blockquote|/section|/div)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\n+'), lambda x: replace(replace(x, chr(160), ' '), chr(8203), '')), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
    lambda x: length(x) >= 20 AND NOT regexp_matches(x, '^(inicio|menu|buscar|compartir|descargar|siguiente|anterior|todos los derechos|privacy|cookies?)\b', 'i')) AS lines
  FROM (SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1\b[^>]*>([\s\S]*?)</h1>', 1, 'i'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
    regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', ' ', 'g'), '{_STRIP}', ' ', 'gi') AS c FROM pages))""")
def regex_content(spark, d):
    text = pages.regex_content(F.col("html"))
    found = spread(lib.table(spark, d, "pages")).select(
        "page_id", pages.regex_title(F.col("html")).alias("title"), text.alias("c"))
    return found.select("page_id", "title", F.when(F.col("c") == "", 0).otherwise(F.size(F.split("c", "\n\n"))).cast("bigint").alias("lines"),
                        F.sha2("c", 256).alias("content_hash"))


@query("curated_text", "X35 R27")
def curated_text(spark, d):
    found = lib.table(spark, d, "pages").select("page_id", markup.findings(F.col("html")).alias("f"))
    return found.select("page_id", pages.curated_text(F.col("f.main_blocks")).alias("content"), F.size("f.main_blocks").alias("blocks"))


@query("direct_assets", "R42 X11 F21", r"""
SELECT page_id, CASE WHEN kind LIKE '%pdf%' THEN 'document' ELSE 'page' END AS route FROM (SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'application/pdf' ELSE 'text/html' END AS kind FROM pages)""")
def direct_assets(spark, d):
    kind = F.when(F.col("page_id") % 4 == 1, "application/pdf").otherwise("text/html")
    return lib.table(spark, d, "pages").select(
        "page_id", F.when(urls.looks_like_html(F.col("url"), kind), "page").otherwise("document").alias("route"))
