"""Compositions of operators: the jobs one would schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioworks import config
from folioworks.functions.text import content_hash
from folioworks.operators import catalog, chunking, incremental, maintenance, pages, usage
from folioworks.session import write_once


def crawl_to_documents(raw_pages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Fetched pages to document records with the action each one needs.

    The parsed records are stored once, because parsing is the costly step and
    both the change detection and the later stages read them.
    """
    parsed = pages.parse(raw_pages)
    records = write_once(parsed.withColumn("content_hash", content_hash(F.col("text"))), "records")
    newest = incremental.last_per_key(records, ["canonical_url"], F.col("page_id"))
    if stored is None:
        return newest.withColumn("action", F.lit("created")).withColumn("version", F.lit(1))
    return incremental.document_actions(stored, newest)


def documents_to_index(documents: DataFrame, mode: str = "balanced", decisions: DataFrame | None = None,
                       daily_limit: int = config.DAILY_TOKEN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Passages of the visible documents and the embedding batches the day still admits."""
    visible = documents if decisions is None else catalog.without_confirmed_duplicates(documents, decisions)
    chunks = write_once(chunking.smart_chunks(visible, mode), "passages")
    return chunks, usage.embedding_plan(chunks, daily_limit)


def repair_run(documents: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs not made before, and the documents after applying them."""
    fresh = write_once(maintenance.new_audits(maintenance.repair_candidates(documents), audit), "repairs")
    return fresh, maintenance.apply_repairs(documents, fresh)


def cleanup_run(documents: DataFrame, now: Column) -> DataFrame:
    """Soft-delete every document the cleanup rules name."""
    source_url = catalog.source_url_of(documents)
    judged = documents.withColumn("source_url", source_url).select("doc_id", maintenance.cleanup_reasons().alias("reasons"))
    return maintenance.soft_delete(documents, judged.where(F.size("reasons") > 0), now)
