"""Checks on fetched files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def response_error(*, asset_type: Column, url: Column, status: Column, content: Column,
                   content_type: Column) -> Column:
    """the first thing wrong with a downloaded asset, or NULL."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    markup = (F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml"))
              | F.contains(F.lower(url), F.lit("/study/login")))
    unsigned = ~F.contains(F.left(content, F.lit(1024)).cast("string"), F.lit("%PDF-"))
    named = F.coalesce(F.nullif(content_type, F.lit("")), F.lit("unknown"))
    return (
        F.when(status >= 400, F.concat(F.lit("Asset returned HTTP "), status.cast("string")))
        .when(F.length(content) == 0, "Asset response was empty")
        .when(markup, F.concat(F.lit("Asset URL resolved to HTML/login content ("), url, F.lit(")")))
        .when((asset_type == "pdf") & unsigned,
              F.concat(F.lit("PDF signature missing (content-type: "), named, F.lit(")")))
    )


def scanned(page_texts: Column, threshold: int = 80, share: float = 0.35) -> Column:
    """Too many pages with too little text need character recognition."""
    low = F.size(F.filter(page_texts, lambda p: F.length(F.trim(p)) < threshold))
    return low / F.size(page_texts) > share
