"""Scripture references: find, normalise, take apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioworks import fixed_values as fv
from folioworks.functions.text import literal_map

_PATTERN = "(?iU)" + fv.SCRIPTURE_PATTERN


def normalize_ref(value: Column) -> Column:
    """Canonical book name and plain numbers; NULL when the book is not in the table."""
    spelled = F.replace(F.lower(F.regexp_extract(value, _PATTERN, 1)), F.lit("dyc"), F.lit("d&c"))
    book = literal_map(fv.SCRIPTURE_BOOKS)[F.trim(F.regexp_replace(spelled, r"\s+", " "))]
    number = lambda group: F.try_to_number(
        F.nullif(F.regexp_extract(value, _PATTERN, group), F.lit("")), F.lit("999")).cast("string")
    until = F.coalesce(F.concat(F.lit("-"), number(4)), F.lit(""))
    return F.concat(book, F.lit(" "), number(2), F.lit(":"), number(3), until)


def extract_refs(c: Column) -> Column:
    """Sorted distinct references; an unmapped spelling is kept as written."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_PATTERN), 0)
    return F.array_sort(F.array_distinct(
        F.transform(found, lambda m: F.coalesce(normalize_ref(m), F.regexp_replace(m, r"^\s+|\s+$", "")))))


def curated_refs(c: Column) -> Column:
    """The narrower pattern, matches kept as written."""
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?iU)" + fv.CURATED_SCRIPTURE_PATTERN), 0)))


def structured(refs: Column) -> Column:
    """Display form, book, chapter and verse range of every mapped reference."""
    named = F.array_distinct(F.array_compact(F.transform(refs, normalize_ref)))
    return F.transform(named, lambda r: F.struct(
        r.alias("display"),
        F.regexp_extract(r, r"^(.*) \d+:", 1).alias("book"),
        F.regexp_extract(r, r" (\d+):", 1).cast("int").alias("chapter"),
        F.regexp_extract(r, r":(\d+)", 1).cast("int").alias("verse_start"),
        F.coalesce(F.nullif(F.regexp_extract(r, r"-(\d+)$", 1), F.lit("")),
                   F.regexp_extract(r, r":(\d+)", 1)).cast("int").alias("verse_end")))


def books_of(refs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(structured(refs), lambda r: r["book"])))


def with_query_refs(wanted: Column, query: Column) -> Column:
    """Explicit references joined with those found in the query."""
    return F.array_sort(F.array_union(F.coalesce(wanted, F.array().cast("array<string>")), extract_refs(query)))


def expand_query(query: Column, refs: Column) -> Column:
    """The deterministic rewrite used when no model is asked."""
    every = with_query_refs(refs, query)
    grown = F.concat(query, F.lit(" "), F.array_join(every, " "), F.lit(" scripture reference doctrinal citation"))
    return F.when(F.size(every) == 0, query).otherwise(F.trim(grown))
