"""Redaction and removal of secrets, and JSON-object helpers on maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioworks import fixed_values as fv
from folioworks.functions.text import contains_any


def secret_key(key: Column) -> Column:
    name = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return name.isin(*fv.SECRET_KEYS) | F.endswith(name, F.lit("_token")) | F.endswith(name, F.lit("_secret"))


def redact_inline(value: Column) -> Column:
    """X36 for a text: anything that smells of a credential hides the whole value."""
    risky = F.rlike(value, F.lit(fv.INLINE_KEY_PATTERN)) | contains_any(F.lower(value), fv.INLINE_SECRETS)
    return F.when(risky, "[REDACTED]").otherwise(value)


def redact_map(values: Column) -> Column:
    """X36 for an object."""
    return F.transform_values(
        values, lambda k, v: F.when(secret_key(k), "[REDACTED]").otherwise(redact_inline(v)))


def without_sensitive(values: Column) -> Column:
    """Drop keys that contain a sensitive term."""
    return F.map_filter(values, lambda k, v: ~contains_any(F.lower(k), fv.SENSITIVE_TERMS))


def without_ingest_secrets(values: Column) -> Column:
    """X37, ingestion variant: exact key names plus the two storage keys."""
    name = lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_"))
    return F.map_filter(values, lambda k, v: ~(
        name(k).isin(*fv.INGEST_SENSITIVE_KEYS) | F.lower(k).isin("file_url", "storage_path")))


def sorted_json(values: Column) -> Column:
    """Object text with sorted keys, separators as in Python's default dump."""
    pairs = F.array_sort(F.map_entries(values))
    quoted = F.transform(pairs, lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('": '), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))
    return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))


def prompt_hash(values: Column) -> Column:
    """X39."""
    return F.sha2(sorted_json(values), 256)


def user_id(external: Column, prefix: str) -> Column:
    """A UUID passes through, anything else becomes a version-5 name UUID.

    The URL namespace's 16 bytes and the prefixed name are hashed; version and
    variant bits are then set, all without leaving the JVM.
    """
    clean = F.trim(external)
    bare = F.lower(F.regexp_replace(clean, r"^urn:uuid:|[{}-]", ""))
    dashed = lambda h: F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
        F.substring(h, 21, 12))
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    digest = F.sha1(F.concat(namespace, F.encode(F.concat(F.lit(prefix), clean), "UTF-8")))
    variant = F.element_at(
        F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    versioned = F.concat(
        F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    return F.when(F.rlike(bare, F.lit("^[0-9a-f]{32}$")), dashed(bare)).otherwise(dashed(versioned))
