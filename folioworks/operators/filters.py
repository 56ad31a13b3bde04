"""Predicates compiled from request filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from folioworks.functions.text import either, every
from folioworks.functions.urls import source_type_aliases


@dataclass
class MetadataFilter:
    source_keys: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    scripture_refs: list[str] = field(default_factory=list)
    document_ids: list[int] = field(default_factory=list)
    published_after: date | None = None
    published_before: date | None = None
    include_seed: bool = True


def resolve_column(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """First of ``names`` the frame has; the fallback keeps old schemas readable."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast("string") if default is None else default


def ilike_any(c: Column, patterns: Sequence[str]) -> Column:
    """F7."""
    return either([F.ilike(c, F.lit(p)) for p in patterns])


def json_text_ilike(values: Column, patterns: Sequence[str]) -> Column:
    """case-insensitive match over the serialised array."""
    return ilike_any(F.to_json(values), patterns)


def seed_flag(metadata: Column) -> Column:
    """F13."""
    return F.coalesce(metadata["is_seed"], metadata["seed_content"], F.lit("false")) == "true"


def source_type_of(df: DataFrame) -> Column:
    """The metadata's own source type wins over the source key."""
    meta = resolve_column(df, ["raw_metadata", "metadata"])
    return F.coalesce(meta["source_type"], F.col("source_key"))


def source_match(df: DataFrame, values: Sequence[str]) -> Column:
    aliases = sorted({alias for value in values for alias in source_type_aliases(value)})
    return source_type_of(df).isin(*aliases) | F.col("source_key").isin(*aliases)


def metadata_predicate(df: DataFrame, want: MetadataFilter) -> Column:
    """One conjunction; parts whose column is missing are left out."""
    have = set(df.columns)
    parts: list[Column] = []
    if want.source_keys:
        parts.append(source_match(df, want.source_keys))
    if want.languages:
        parts.append(F.col("language").isin(*want.languages))
    if want.authors and "author" in have:
        parts.append(F.col("author").isin(*want.authors))
    if want.categories and "category" in have:
        parts.append(F.col("category").isin(*want.categories))
    if want.tags and "tags" in have:
        parts.append(json_text_ilike(F.col("tags"), [f"%{t}%" for t in want.tags]))
    if want.scripture_refs and "scripture_refs" in have:
        parts.append(json_text_ilike(F.col("scripture_refs"), [f"%{r}%" for r in want.scripture_refs]))
    if want.document_ids:
        parts.append(F.col("doc_id").isin(*want.document_ids))
    if want.published_after and "published_on" in have:
        parts.append(F.col("published_on") >= F.lit(want.published_after))
    if want.published_before and "published_on" in have:
        parts.append(F.col("published_on") <= F.lit(want.published_before))
    if not want.include_seed:
        parts.append(~seed_flag(resolve_column(df, ["raw_metadata", "metadata"])))
    return every(parts)


def payload_predicate(df: DataFrame, accepted: dict[str, Sequence]) -> Column:
    """conjunction of any-of matches; array columns match on overlap."""
    parts = []
    for key, values in accepted.items():
        if not values:
            continue
        if df.schema[key].dataType.typeName() == "array":
            parts.append(F.arrays_overlap(F.col(key), F.array(*[F.lit(v) for v in values])))
        else:
            parts.append(F.col(key).isin(*values))
    return every(parts)


def artifact_filter(items: DataFrame, documents: DataFrame, *, doc_id: int | None = None,
                    source: str | None = None, topic: str | None = None,
                    scripture_ref: str | None = None) -> DataFrame:
    """The documents are joined only when a filter looks at them."""
    if doc_id is not None:
        items = items.where(F.col("doc_id") == doc_id)
    if not (source or topic or scripture_ref):
        return items
    parts = []
    if source:
        parts.append(source_match(documents, [source]))
    if topic:
        like = f"%{topic}%"
        parts.append(F.ilike("category", F.lit(like)) | json_text_ilike(F.col("tags"), [like])
                     | json_text_ilike(F.col("raw_metadata"), [like]))
    wanted = documents.select("doc_id", F.coalesce(every(parts), F.lit(False)).alias("_fits"),
                              resolve_column(documents, ["scripture_refs"]).alias("_doc_refs"))
    joined = items.join(wanted, "doc_id", "left").where(F.col("_fits"))
    if scripture_ref:
        like = f"%{scripture_ref}%"
        joined = joined.where(ilike_any(F.coalesce(F.to_json("scripture_refs"), F.lit("")), [like])
                              | ilike_any(F.coalesce(F.col("_doc_refs").cast("string"), F.lit("")), [like]))
    return joined.drop("_fits", "_doc_refs")


def language_or_null(language: str) -> Column:
    """F15."""
    return (F.col("language") == language) | F.col("language").isNull()


def keyset_after(columns: Sequence[str], values: Sequence) -> Column:
    """F32: rows that sort strictly after ``values`` in descending order."""
    result = F.lit(False)
    for depth, (name, value) in enumerate(zip(columns, values)):
        tied = every([F.col(columns[i]) == F.lit(values[i]) for i in range(depth)])
        result = result | (tied & (F.col(name) < F.lit(value)))
    return result


def owned_by(df: DataFrame, user_id: int) -> DataFrame:
    """F18, own rows."""
    return df.where(F.col("user_id") == user_id)


def owned_through_parent(children: DataFrame, parents: DataFrame, key: str, user_id: int) -> DataFrame:
    """F18, rows whose parent the user owns."""
    return children.join(owned_by(parents, user_id).select(key), key, "left_semi")


def publicly_readable(df: DataFrame) -> DataFrame:
    """F18, rows anyone may read."""
    return df.where((F.upper(F.col("status")) == "READY") & F.col("deleted_at").isNull())
