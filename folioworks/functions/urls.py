"""URL expressions.  Regular expressions are used for the parts because the
built-in parser rejects the sloppy URLs a crawl produces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from folioworks import fixed_values as fv
from folioworks.functions.text import bind, collapse_ws, either, literal_map, strip_ws

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 2))


def host(url: Column) -> Column:
    """Host without credentials and port."""
    bare = F.regexp_replace(authority(url), "^.*@", "")
    return F.regexp_replace(bare, r":\d*$", "")


def port(url: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(authority(url), r":(\d+)$", 1), F.lit("")), F.lit("99999"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def unquote(c: Column) -> Column:
    """Percent-decoding; a plus sign in a path stays a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _decode_query_part(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_pairs(url: Column) -> Column:
    """Array of (key, value) in order, without blank values."""
    parts = F.filter(F.split(query(url), "&"), lambda p: F.rlike(p, F.lit("^[^=]*=.")))
    return F.transform(
        parts,
        lambda p: F.struct(
            _decode_query_part(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"),
            _decode_query_part(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )


def query_value(url: Column, key: str) -> Column:
    """First value of an exactly named parameter, else NULL."""
    return F.get(F.filter(query_pairs(url), lambda p: p["key"] == key), F.lit(0))["value"]


def query_values(url: Column, key: str) -> Column:
    return F.transform(F.filter(query_pairs(url), lambda p: p["key"] == key), lambda p: p["value"])


def segments(c: Column) -> Column:
    return F.filter(F.split(path(c), "/"), lambda s: s != "")


def _squeeze_slashes(c: Column) -> Column:
    return F.regexp_replace(c, "/+", "/")


def _place(url: Column) -> Column:
    """Host with any port that is not a default one."""
    return bind(port(url), lambda p: F.concat(host(url), F.when(
        p.isNotNull() & ~p.isin(80, 443), F.concat(F.lit(":"), p.cast("string"))).otherwise("")))


def identity(url: Column) -> Column:
    """Scheme, host and decoded path; the query and fragment do not count."""
    def build(u: Column) -> Column:
        kind = bind(scheme(u), lambda k: F.when(k == "", "https").otherwise(k))
        clean = bind(F.regexp_replace(_squeeze_slashes(unquote(path(u))), "/$", ""),
                     lambda c: F.when(c == "", "/").otherwise(c))
        return F.concat(kind, F.lit("://"), _place(u), clean)

    return bind(F.trim(url), build)


def _encode_pair(pair: Column) -> Column:
    encode = lambda c: F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A"))
    return F.concat(encode(pair["key"]), F.lit("="), encode(pair["value"]))


def _sorted_query(url: Column, dropped) -> Column:
    kept = F.array_sort(F.filter(query_pairs(url), lambda p: ~dropped(p["key"])))
    return F.array_join(F.transform(kept, _encode_pair), "&")


def _with_query(base: Column, q: Column) -> Column:
    return bind(q, lambda x: F.when(x == "", base).otherwise(F.concat(base, F.lit("?"), x)))


def canonical(url: Column) -> Column:
    """X11: lower-case host, no tracking parameters, sorted query, no fragment."""
    def build(u: Column) -> Column:
        q = _sorted_query(u, lambda k: k.isin(*fv.TRACKING_KEYS) | F.startswith(k, F.lit(fv.TRACKING_PREFIX)))
        kind = bind(scheme(u), lambda k: F.when(k == "", "https").otherwise(k))
        return F.regexp_replace(_with_query(F.concat(kind, F.lit("://"), authority(u), path(u)), q), "/$", "")

    return bind(url, build)


def curated_canonical(url: Column) -> Column:
    """As above, but default ports vanish, slashes collapse and a bare path stays '/'."""
    def build(u: Column) -> Column:
        route = bind(F.regexp_replace(path(u), "/{2,}", "/"),
                     lambda r: F.when(r.isin("", "/"), "/").otherwise(F.regexp_replace(r, "/+$", "")))
        q = _sorted_query(u, lambda k: F.lower(k).isin(*fv.CURATED_TRACKING_KEYS))
        return _with_query(F.concat(scheme(u), F.lit("://"), _place(u), route), q)

    return bind(strip_ws(url), build)


def allowlisted_canonical(url: Column) -> Column:
    """The curated form for HTTPS URLs on an allowed host, NULL for all others."""
    return bind(strip_ws(url), lambda u: F.when(
        (scheme(u) == "https") & host(u).isin(*fv.CURATED_HOSTS), curated_canonical(u)))


def language(url: Column, fallback: Column) -> Column:
    """The URL's own language parameter, with three-letter codes mapped."""
    named = lambda pairs, key: F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))["value"]
    own = bind(query_pairs(url), lambda pairs: F.coalesce(named(pairs, "lang"), named(pairs, "language")))
    value = F.lower(F.coalesce(own, fallback, F.lit("")))
    return bind(value, lambda v: F.coalesce(literal_map(fv.URL_LANGUAGE_ALIASES)[v], v))


def media_variant(url: Column, title: Column) -> Column:
    """A media query key, or a title that is really a file name."""
    keys = F.transform(query_pairs(url), lambda p: F.lower(p["key"]))
    by_key = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in fv.MEDIA_QUERY_KEYS]))
    by_title = F.rlike(strip_ws(F.coalesce(title, F.lit(""))), F.lit(r"(?i)\.(?:jpe?g|png|gif|webp|mp3|mp4|pdf)$"))
    return F.coalesce(by_key, F.lit(False)) | by_title


def host_allowed(url: Column, domains: Sequence[str]) -> Column:
    """Equal to, or below, one of the domains."""
    bare = [domain.lower().split(":")[0] for domain in domains]
    return bind(host(url), lambda name: either([(name == d) | F.endswith(name, F.lit(f".{d}")) for d in bare]))


def registered_domain(url: Column) -> Column:
    """The last two labels; no public-suffix list is consulted."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def official(url: Column) -> Column:
    return host_allowed(url, fv.OFFICIAL_HOST_SUFFIXES)


def source_type(key: Column, url: Column) -> Column:
    """Host first, then path, then the legacy key."""
    return bind(authority(url), lambda where: bind(F.lower(path(url)), lambda route: _source_type(key, where, route)))


def _source_type(key: Column, where: Column, route: Column) -> Column:
    church = F.contains(where, F.lit("churchofjesuschrist.org"))
    return (
        F.when(F.contains(where, F.lit("speeches.byu.edu")),
               F.when(F.contains(route, F.lit("/spa/")), "byu_speeches_es").otherwise("byu_speeches_en"))
        .when(F.contains(where, F.lit("discursosud.com")), "discursos_sud")
        .when(F.contains(where, F.lit("josephsmithpapers.org")), "joseph_smith_papers")
        .when(F.contains(where, F.lit("rsc.byu.edu")), "byu_rsc")
        .when(church & F.contains(route, F.lit("/general-conference")), "general_conference")
        .when(church & F.contains(route, F.lit("/manual")), "church_manuals")
        .when(church & F.contains(route, F.lit("/scriptures")), "scriptures")
        .when(church & (F.contains(where, F.lit("news")) | F.contains(route, F.lit("/news"))), "church_news")
        .when(church & key.isin("general_conference", "church_manuals", "scriptures"), key)
        .when(church, "churchofjesuschrist")
        .otherwise(F.coalesce(literal_map(fv.LEGACY_SOURCE_TYPES)[key], F.nullif(key, F.lit("")), F.lit("custom")))
    )


def normalize_source_type(value: Column) -> Column:
    """Trim, fold, unify separators, map every alias to its canonical type."""
    folded = F.replace(F.replace(F.lower(strip_ws(value)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    reverse = {alias: name for name, aliases in fv.SOURCE_ALIASES.items() for alias in aliases}
    return F.when(value != "", bind(folded, lambda f: F.coalesce(literal_map(reverse)[f], f)))


def source_type_aliases(value: str) -> list[str]:
    folded = value.strip().lower().replace("-", "_").replace(" ", "_")
    for name, aliases in fv.SOURCE_ALIASES.items():
        if folded == name or folded in aliases:
            return sorted({*aliases, name})
    return [folded] if folded else []


def curated_source(url: Column) -> Column:
    """Host plus path shape; each of the three sites has its own rule."""
    return bind(literal_map(fv.CURATED_HOSTS)[host(url)], lambda key: bind(
        segments(url), lambda parts: _curated(url, key, parts)))


def _curated(url: Column, key: Column, parts: Column) -> Column:
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    fits = (
        F.when(key == "discursos_sud_es", first.isNotNull() & ~F.lower(first).isin(*fv.CURATED_NAVIGATION))
        .when(key == "byu_speeches_es", (F.size(parts) >= 4) & (first == "spa") & (second == "talks"))
        .when(key == "church_official_es",
              (F.size(parts) >= 3) & (first == "study") & F.array_contains(query_values(url, "lang"), "spa"))
    )
    return F.when((scheme(url) == "https") & fits, key)


def non_spanish_parameter(url: Column) -> Column:
    """F27."""
    return F.coalesce(
        F.exists(query_values(url, "lang"), lambda v: F.lower(v).isin(*fv.NON_SPANISH_CODES)), F.lit(False))


def looks_like_html(url: Column, content_type: Column) -> Column:
    """F21."""
    bare = F.regexp_extract(F.lower(url), r"^([^?]*)", 1)
    binary = either([F.endswith(bare, F.lit(s)) for s in fv.NON_HTML_SUFFIXES])
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    textual = either([F.contains(kind, F.lit(t)) for t in ("text/html", "application/xhtml", "text/plain")])
    return ~binary & ((kind == "") | textual)


def slug_title(slug: Column) -> Column:
    """A usable title from a slug, or NULL for generic, numeric or odd-sized ones."""
    stem = F.regexp_replace(slug, r"\.[^.]*$", "")
    return bind(F.trim(F.regexp_replace(stem, "[-_]+", " ")), lambda words: F.when(
        (words != "") & ~F.lower(words).isin(*fv.GENERIC_SLUGS) & ~F.rlike(words, F.lit(r"^\d+$"))
        & F.length(words).between(4, 180), F.initcap(words)))


def title_from_url(url: Column, kind: Column) -> Column:
    """Which path segment carries the title depends on the site."""
    def pick(parts: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        return bind(F.array_position(parts, "talks"), lambda at: (
            F.when(at > 0, F.try_element_at(parts, (at + 2).cast("int")))
            .when((kind == "general_conference") & F.array_contains(parts, "general-conference"), last)
            .when((kind == "joseph_smith_papers") & F.array_contains(parts, "paper-summary"), last)))

    return slug_title(bind(F.transform(segments(url), unquote), pick))


def author_from_url(url: Column) -> Column:
    """Two to eight words of the speaker slug, initials dotted."""
    def spell(slug: Column) -> Column:
        words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
        named = lambda w: (F.when(F.length(w) == 1, F.concat(F.upper(w), F.lit(".")))
                           .when(w.isin("jr", "sr"), F.concat(F.initcap(w), F.lit("."))).otherwise(F.initcap(w)))
        return bind(words, lambda ws: F.when(
            ~slug.isin("speakers", "topics", "all") & F.size(ws).between(2, 8),
            F.array_join(F.transform(ws, named), " ")))

    # A speaker slug is followed by at least the talk's own slug.
    speaker = bind(F.transform(segments(url), unquote), lambda parts: bind(
        F.array_position(parts, "talks"), lambda at: F.when(
            (at > 0) & (F.size(parts) > at + 1), F.lower(F.try_element_at(parts, (at + 1).cast("int"))))))
    return F.when(authority(url).isin("speeches.byu.edu", "www.speeches.byu.edu"), bind(speaker, spell))


def published_from_url(url: Column, kind: Column) -> Column:
    """First day of the conference month, as epoch seconds."""
    pattern = r"/general-conference/((?:19|20)\d{2})/(0[1-9]|1[0-2])/"
    year, month = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    stamp = F.unix_seconds(F.try_to_timestamp(F.concat(year, F.lit("-"), month, F.lit("-01")), F.lit("yyyy-MM-dd")))
    return F.when((kind == "general_conference") & (year != ""), stamp)


def asset_title(url: Column) -> Column:
    """Title of a directly linked file, taken from its name."""
    slug = unquote(F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1))
    words = collapse_ws(F.regexp_replace(F.regexp_replace(slug, r"\.[^.]*$", ""), "[-_]", " "))
    return F.when(words == "", "Downloaded asset").otherwise(F.initcap(words))


def asset_key(url: Column, suffix: Column) -> Column:
    """Storage key derived from the URL hash."""
    return F.concat(F.lit("assets/"), F.sha2(url, 256), suffix)


def card_kind(kind: Column) -> Column:
    """P14."""
    rules = [("manual", "manual"), ("scripture", "scripture"), ("pdf", "pdf"), ("audio", "audio")]
    result = F.when(kind.isNull() | (kind == ""), "speech")
    for needle, name in rules:
        result = result.when(F.contains(kind, F.lit(needle)), name)
    return result.otherwise("speech")
