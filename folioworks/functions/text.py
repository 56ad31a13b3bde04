"""Text expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from folioworks import fixed_values as fv

TOKEN = r"[\p{L}\p{N}_]+|[^\t\n\f\r\x0B \p{L}\p{N}_]"
WORD = r"[\p{L}\p{N}_]+"
# The characters that count as whitespace.
_WS_CHARS = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
             "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# All of them but blank and line feed, written as a complement so that ordinary
# letters are settled by the first range.
_ODD_WS = (r"[^\x20-\x84\n\x00-\x08\x0E-\x1B\x86-\x9F\xA1-\u167F\u1681-\u1FFF\u200B-\u2027\u202A-\u202E"
           r"\u2030-\u205E\u2060-\u2FFF\u3001-\x{10FFFF}]")


def either(conditions: Sequence[Column]) -> Column:
    """OR over any number of predicates; false when there are none."""
    result = F.lit(False)
    for position, condition in enumerate(conditions):
        result = condition if position == 0 else result | condition
    return result


def every(conditions: Sequence[Column]) -> Column:
    result = F.lit(True)
    for position, condition in enumerate(conditions):
        result = condition if position == 0 else result & condition
    return result


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used n times in an expression is planned, and often evaluated, n
    times.  A lambda variable is not, so the value is bound to one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_by(values: Column, key) -> Column:
    """Array elements whose ``key`` did not occur before, in order."""
    return bind(values, lambda v: bind(F.transform(v, key), lambda keys: F.filter(
        v, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def literal_map(values: dict[str, str]) -> Column:
    pairs = [F.lit(part) for pair in values.items() for part in pair]
    return F.create_map(*pairs)


def _swap(c: Column, old: Sequence[str], new: str) -> Column:
    for part in old:
        c = F.replace(c, F.lit(part), F.lit(new))
    return c


def _single_blanks(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _ODD_WS, " "), "  +", " ")


def collapse_ws(c: Column) -> Column:
    """Whitespace runs become one blank, ends are stripped."""
    return F.trim(_single_blanks(F.replace(c, F.lit("\n"), F.lit(" "))))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def casefold(c: Column) -> Column:
    """Full case folding: upper case first, which expands ligatures and the sharp s; every sigma becomes the inner one.

    The sigma step also keeps the optimizer from joining the two conversions.
    The dotless i is the one letter that folds further here, to a plain i.
    """
    return F.lower(F.translate(F.upper(c), "Σ", "σ"))


def content_hash(c: Column) -> Column:
    """Hash after whitespace normalisation."""
    return F.sha2(collapse_ws(c), 256)


def raw_hash(c: Column) -> Column:
    """Hash of the text as it stands."""
    return F.sha2(c, 256)


def token_count(c: Column) -> Column:
    """Words and punctuation marks; the stand-in for a subword vocabulary."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(TOKEN))


def normalize_lines(c: Column) -> Column:
    """Unify line ends, collapse blanks inside lines, squeeze empty-line runs."""
    c = _single_blanks(_swap(c, ["\r\n", "\r"], "\n"))
    return strip_ws(F.regexp_replace(_swap(c, [" \n", "\n "], "\n"), "\n\n\n+", "\n\n"))


def normalize_title(c: Column) -> Column:
    """Fold case, everything that is not a word character becomes one blank."""
    return F.trim(F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def limit_text(c: Column, size: int) -> Column:
    """Whitespace-collapsed head of a text."""
    return F.left(collapse_ws(c), F.lit(size))


def alnum_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def authors_match(a: Column, b: Column) -> Column:
    """Equal after dropping case and punctuation, and not empty."""
    return (alnum_only(a) != "") & (alnum_only(a) == alnum_only(b))


def search_terms(c: Column, stopwords: Sequence[str], separators: str, most: int = 8) -> Column:
    """Whitespace tokens over two characters that are not stop words."""
    cleaned = F.regexp_replace(c, separators, " ") if separators else c
    tokens = F.split(collapse_ws(cleaned), " ")
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~casefold(t).isin(*stopwords))
    return F.slice(kept, 1, most)


def library_terms(c: Column) -> Column:
    return F.transform(search_terms(c, fv.SEARCH_STOPWORDS, r"[?,.]"), casefold)


def study_terms(c: Column) -> Column:
    return search_terms(c, fv.STUDY_STOPWORDS, r"[,;.:]")


def related_terms(c: Column) -> Column:
    return F.slice(F.filter(F.split(collapse_ws(F.regexp_replace(c, "[,;]", " ")), " "),
                            lambda t: F.length(t) > 2), 1, 8)


def talk_terms(c: Column) -> Column:
    """Tokens are trimmed of punctuation before the length and stop-word tests."""
    tokens = F.transform(
        F.split(collapse_ws(c), " "),
        lambda t: F.lower(F.regexp_replace(t, r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", "")),
    )
    return F.slice(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*fv.TALK_STOPWORDS)), 1, 8)


def library_terms_of(query: str) -> list[str]:
    """The same rule for a query that is already a Python string."""
    cleaned = query.translate(str.maketrans("?,.", "   "))
    words = (word for word in cleaned.split() if len(word) > 2)
    return [w.casefold() for w in words if w.casefold() not in fv.SEARCH_STOPWORDS][:8]


def search_patterns(query: str) -> list[str]:
    """Whole query first, then its terms, without repeats."""
    query = query.strip()
    terms = [t for t in library_terms_of(query) if len(t) >= 3]
    return list(dict.fromkeys(f"%{part}%" for part in [query, *terms]))


def filename_slug(name: Column, kind: str, extension: str) -> Column:
    """Every character that is not alphanumeric turns into a dash."""
    stem = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "-")
    stem = F.regexp_replace(stem, "^-+|-+$", "")
    stem = F.when(stem == "", "study-export").otherwise(stem)
    return F.concat(stem, F.lit(f"-{kind}.{extension}"))


def initcap_words(c: Column) -> Column:
    """Title case where every letter run starts upper case, as slugs need."""
    return F.initcap(c)


def marker_counts(text: Column, markers: Sequence[str]) -> Column:
    words = F.regexp_extract_all(casefold(text), F.lit(f"({fv.WORD_PATTERN})"), 1)
    return F.size(F.filter(words, lambda w: w.isin(*markers)))


def word_total(text: Column) -> Column:
    return F.regexp_count(casefold(text), F.lit(fv.WORD_PATTERN))


def appears_spanish(text: Column) -> Column:
    """at least 8 Spanish markers, 2.5 % of the words, and no more English ones."""
    words = F.regexp_extract_all(casefold(text), F.lit(f"({fv.WORD_PATTERN})"), 1)

    def judge(w: Column) -> Column:
        spanish = F.size(F.filter(w, lambda x: x.isin(*fv.SPANISH_MARKERS)))
        english = F.size(F.filter(w, lambda x: x.isin(*fv.ENGLISH_MARKERS)))
        return (F.size(w) > 0) & (spanish >= 8) & (spanish / F.size(w) >= 0.025) & (english <= spanish)

    return bind(words, judge)


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    return bind(c, lambda x: either([F.contains(x, F.lit(needle)) for needle in needles]))


def contains_placeholder(c: Column) -> Column:
    """F26."""
    return contains_any(casefold(F.coalesce(c, F.lit(""))), fv.PLACEHOLDERS)


def contains_raw_html(c: Column) -> Column:
    """one structural tag, or three tags of any kind."""
    return contains_any(casefold(c), fv.RAW_HTML_TAGS) | (F.regexp_count(c, F.lit(fv.HTML_TAG_PATTERN)) >= 3)


def leadership_query(c: Column) -> Column:
    """F29."""
    return contains_any(casefold(c), fv.LEADERSHIP_TERMS)


def quota_error(c: Column) -> Column:
    """F30."""
    return contains_any(F.lower(c), ["insufficient_quota", "quota", "429", "rate limit"])


def block_reason(html: Column, status: Column) -> Column:
    """the status decides first, then the earliest listed phrase in the page head."""
    def phrase_in(head: Column) -> Column:
        found = None
        for phrase in fv.BLOCK_PHRASES:
            hit = F.contains(head, F.lit(phrase))
            found = F.when(hit, phrase) if found is None else found.when(hit, phrase)
        return found

    by_status = F.when(status.isin(*fv.BLOCK_STATUSES), F.concat(F.lit("http_status_"), status.cast("string")))
    return F.coalesce(by_status, bind(F.lower(F.left(html, F.lit(fv.BLOCK_SCAN_CHARS))), phrase_in))


def translate_tag(tag: Column) -> Column:
    """Known English tags get their Spanish name."""
    return F.coalesce(literal_map(fv.TAG_TRANSLATIONS)[casefold(tag)], tag)


def trigrams(c: Column) -> Column:
    """padded three-character shingles of every word, as a set."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.flatten(F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    ))
    return F.array_distinct(grams)


def trigram_similarity(left: Column, right: Column) -> Column:
    ratio = lambda a, b, shared: F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(
        shared / (F.size(a) + F.size(b) - shared))
    return bind(left, lambda a: bind(right, lambda b: bind(
        F.size(F.array_intersect(a, b)), lambda shared: ratio(a, b, shared))))


def block_type(c: Column) -> Column:
    """X43."""
    named = F.coalesce(literal_map(fv.BLOCK_TYPE_ALIASES)[c], c)
    return F.when(named.isin(*fv.BLOCK_TYPES), named).otherwise("personal_note")


def title_needs_repair(title: Column) -> Column:
    """F31, title part."""
    return F.coalesce((strip_ws(title) == "") | bind(F.lower(collapse_ws(title)), _odd_title), F.lit(True))


def _odd_title(t: Column) -> Column:
    return (
        t.isin("untitled document", "sin titulo", "sin título")
        | (F.length(t) > 180)
        | either([F.startswith(t, F.lit(p)) for p in fv.BAD_TITLE_PREFIXES])
        | F.startswith(t, F.lit("?m="))
        | (t == "blog")
        | (F.endswith(t, F.lit(":")) & (F.length(t) < 30))
        | F.rlike(t, F.lit(r"^part\s+\d+$"))
    )


def author_needs_repair(author: Column) -> Column:
    """F31, author part: digits, overlong names, or a name that starts in lower case."""
    return F.coalesce(bind(strip_ws(author), lambda value: (
        (value == "")
        | F.rlike(value, F.lit(r"\d"))
        | (F.length(value) > 90)
        | (F.size(F.split(collapse_ws(value), " ")) > 8)
        | F.rlike(value, F.lit(r"^[^\p{L}]*\p{Ll}"))
    )), F.lit(True))
